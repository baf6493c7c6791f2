"""Partition-count invariance: shuffle-heavy queries give the same rows
whatever the number of shuffle partitions (SURVEY 5 (d))."""

import pytest

import __spark_entry__ as E
from tests.test_oracle_parity import _canon

SF = "/root/testdata/sf0.001"
NAMES = ["trace_master", "win_stratified_sample", "agg_box_stats", "set_pairwise_overlap", "topk_per_group_avg",
         "agg_metrics_by_trigger", "win_last_n", "agg_describe"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_for_any_partition_count(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for parts in ("3", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = E.queries()[name](spark, SF)
            out.append(_canon(df.columns, df.collect()))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
