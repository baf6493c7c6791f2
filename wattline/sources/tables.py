"""Parquet test tables and the domain views built over them.

The views give the serverless-trace roles (invocations, per-day durations,
app memory, minute counts, live traffic, attributions) to the generated
TPC-H-like tables.  They are plain DataFrame plans: nothing is cached or
collected, so every query that uses them still prunes columns and pushes
filters into the Parquet scans.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    """Lazy access to the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    # ---- domain views -------------------------------------------------
    @cached_property
    def v_inv(self) -> DataFrame:
        return invocations_view(self.table("lineitem"), self.table("part"))

    @cached_property
    def v_pred(self) -> DataFrame:
        return prediction_view(self.v_inv)

    @cached_property
    def v_fn_day(self) -> DataFrame:
        return function_day_view(self.v_inv)

    @cached_property
    def v_fn_day_basic(self) -> DataFrame:
        """Function days without the percentile columns."""
        return function_day_view(self.v_inv, percentiles=False)

    @cached_property
    def v_app_day(self) -> DataFrame:
        return app_day_view(self.table("supplier"))

    @cached_property
    def v_fn_minutes(self) -> DataFrame:
        return function_minutes_view(self.v_inv)

    @cached_property
    def v_live(self) -> DataFrame:
        return live_view(self.table("events"))

    @cached_property
    def v_source(self) -> DataFrame:
        return source_view(self.table("documents"))

    @cached_property
    def v_attr(self) -> DataFrame:
        return attribution_view(self.table("lineitem"))


def _case(key: Column, values: list, default) -> Column:
    """CASE key WHEN 0 THEN values[0] ... ELSE default (values indexed by key)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr.otherwise(F.lit(default))


def invocations_view(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One row per invocation.  ``part`` is joined on its key; at scale this is
    a sort-merge join that AQE turns into a broadcast when the runtime size
    of ``part`` is under the broadcast threshold (a checked size)."""
    l = lineitem
    p = part.select("p_partkey", "p_size")
    pk = F.col("l_partkey")
    return (l.join(p, l.l_partkey == p.p_partkey, "inner")
            .select(
                F.concat(F.lit("fn-"), pk.cast("string")).alias("function_name"),
                F.concat(F.lit("app-"), (pk % 10).cast("string")).alias("app_id"),
                F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                            pk.cast("string"), F.col("l_suppkey").cast("string"),
                            F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("inv_id"),
                F.col("l_shipdate").alias("ts"),
                F.year("l_shipdate").cast("int").alias("day"),
                _case(pk % 5, ["python3.9", "nodejs14", "java11", "php7"], "go1").alias("runtime"),
                _case(pk % 6, ["http", "timer", "queue", "storage", "event"], "orchestration").alias("trigger_type"),
                _case(F.col("p_size") % 6, [128, 256, 512, 1024, 2048], 3000).alias("memory_mb"),
                (F.col("l_extendedprice") / 10).alias("latency_ms"),
                F.when(F.col("l_linenumber") == 1, 1).otherwise(0).alias("cold_start"),
                F.col("l_quantity").alias("quantity"),
                F.col("l_discount").alias("discount"),
                F.col("l_tax").alias("tax")))


def prediction_view(v_inv: DataFrame) -> DataFrame:
    """Ground truth plus a deterministic stand-in prediction."""
    truth = (10 + F.lit(0.2) * F.col("memory_mb")) * F.col("latency_ms") / 3600000
    return v_inv.select("*", truth.alias("actual_wh"),
                        (truth * (1 + (F.col("discount") - F.lit(0.05)) * 4)).alias("predicted_wh"))


def function_day_view(v_inv: DataFrame, percentiles: bool = True) -> DataFrame:
    """Durations role: per function, app and day summary, with exact p50 / p99
    where asked for (they cost a shuffle of the distinct values)."""
    from wattline.operators.quantiles import grouped_percentiles

    keys = ["function_name", "app_id", "day"]
    summary = [F.avg("latency_ms").alias("average"), F.count(F.lit(1)).alias("cnt"),
               F.min("latency_ms").alias("minimum"), F.max("latency_ms").alias("maximum")]
    if percentiles:
        q = grouped_percentiles(v_inv, keys, "latency_ms", {"p50": 0.5, "p99": 0.99}, extra_aggs=summary)
    else:
        q = v_inv.where(F.col("latency_ms").isNotNull()).groupBy(*keys).agg(*summary)
    return q.withColumnsRenamed({"function_name": "hash_function", "app_id": "hash_app"})


def app_day_view(supplier: DataFrame) -> DataFrame:
    """App memory role: mean, median and 99th percentile of a day."""
    mean = 64 + F.abs(F.col("s_acctbal")) / 6
    return supplier.select(
        F.concat(F.lit("app-"), (F.col("s_suppkey") % 10).cast("string")).alias("hash_app"),
        F.floor(F.col("s_suppkey") / 10).cast("bigint").alias("day"),
        mean.alias("avg_mb"), (mean * 0.9).alias("p50_mb"), (mean * 1.5).alias("p99_mb"))


def function_minutes_view(v_inv: DataFrame) -> DataFrame:
    """Wide invocation role: twelve month columns stand for the minute columns."""
    m = F.month("ts")
    return (v_inv.groupBy(F.col("function_name").alias("hash_function"), "trigger_type", "day")
            .agg(*[F.sum(F.when(m == i, F.col("quantity"))).alias(f"m{i}") for i in range(1, 13)]))


def source_view(documents: DataFrame) -> DataFrame:
    """Source bundle role: one Python file per document, written from its row:
    a handler with nested loops, conditionals and calls, whose numbers follow
    the id and the length of the text; for every third id a second function;
    for every eleventh a line that does not parse.  The text is its data.  Rows
    are dealt over all cores before the files are written and parsed."""
    from wattline.session import spread
    documents = spread(documents.select("doc_id", "source", "text"), "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    loops, ifs, calls = 1 + F.col("doc_id") % 4, F.length(text) % 5, F.col("doc_id") % 7
    indent = lambda n: F.repeat(F.lit("    "), n.cast("int"))
    number = lambda n: F.sequence(F.lit(0), n.cast("int") - 1)
    times = lambda n, line: F.when(n > 0, F.concat(F.repeat(F.lit(line), n.cast("int")))).otherwise("")
    nest = F.array_join(F.transform(number(loops), lambda i: F.concat(indent(i + 1), F.lit("for i"), i.cast("string"), F.lit(" in range(1):\n"))), "")
    content = F.concat(
        F.lit("# document "), F.col("doc_id").cast("string"), F.lit("\nimport json\n\nDATA = \""), F.regexp_replace(F.base64(text.cast("binary")), r"\s", ""),
        F.lit("\"\n\n\ndef handler(event, context):\n    total = len(DATA)\n"), nest, indent(loops + 1), F.lit("total += 1\n"),
        times(ifs, "    if total > 0:\n        total += 1\n"), times(calls, "    total = abs(total)\n"), F.lit("    return total\n"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("\n\ndef check(value):\n    return value > 0 and value < 10 or value == 12\n")).otherwise(""),
        F.when(F.col("doc_id") % 11 == 0, F.lit("def (:\n")).otherwise(""))
    return documents.select("doc_id", F.col("source").alias("bundle"), F.col("doc_id").cast("string").alias("path"), content.alias("content"))


def live_view(events: DataFrame) -> DataFrame:
    """Live traffic role: the event type names the function."""
    return events.select("event_id", F.concat(F.lit("fn-"), F.col("event_type")).alias("function_name"),
                         "ts", F.col("value").alias("duration_ms"), "user_id")


def attribution_view(lineitem: DataFrame) -> DataFrame:
    """Two attribution methods in long form (row_id x feature)."""
    return (lineitem.groupBy((F.col("l_orderkey") % 10).cast("int").alias("row_id"),
                             F.concat(F.lit("f"), (F.col("l_partkey") % 33).cast("string")).alias("feature"))
            .agg((F.avg("l_discount") - F.lit(0.05)).alias("shap_value"),
                 (F.avg("l_tax") - F.lit(0.04)).alias("lime_weight")))
