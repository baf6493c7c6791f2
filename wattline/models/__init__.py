"""Features, models and explanations.

Functions that run in tasks are sent by value, so executors need the
libraries but not this repository."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
