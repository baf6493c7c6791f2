"""Training-data operators: toxicity, language id, secret scans, similarity
join, chat formatting, subword encoding, exact dedup, packing, web archives
and fingerprints.  Nothing else in the library imports this subpackage.

Functions that run in tasks are sent by value, so executors need the
libraries but not this repository."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
