"""Workload-profile queries: ETL totals, frequencies, rule classes, string,
math, array and JSON functions, hashing, rounding, naive Bayes scoring
(SURVEY 2.4, 2.8, 2.10)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import rounding as R
from wattline.functions import scalar as SC
from wattline.functions.text import loc_count
from wattline.plans.registry import register
from wattline.sources.tables import Catalog


def r6(c, name=None):
    return R.half_up(c, 6).alias(name or c)


@register("agg_etl_category_totals")
def agg_etl_category_totals(cat: Catalog) -> DataFrame:
    o = cat.orders
    active = o.where(F.col("o_orderstatus") == "O").select(
        F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") * 1.12 / 0.95).alias("new_val"))
    totals = active.groupBy("category").agg(F.count(F.lit(1)).alias("transformed_rows"),
                                            R.half_up(F.sum("new_val"), 2).alias("total"))
    processed = o.agg(F.count(F.lit(1)).alias("processed_rows"))
    return totals.select("category", F.upper("category").alias("category_upper"), "transformed_rows", "total") \
        .crossJoin(F.broadcast(processed))


@register("agg_frequency_stats")
def agg_frequency_stats(cat: Catalog) -> DataFrame:
    q = cat.lineitem.select(F.col("l_quantity").alias("x"))
    freq = q.groupBy("x").agg(F.count(F.lit(1)).alias("freq"))
    top = freq.orderBy(F.desc("freq"), F.asc("x")).limit(10)
    # ten rows: a global window is bounded
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("x"))))
    stats = q.agg(R.half_up(F.avg("x"), 9).alias("mean"), R.half_up(F.var_pop("x"), 9).alias("variance"))
    return top.crossJoin(F.broadcast(stats))


@register("agg_count_if")
def agg_count_if(cat: Catalog) -> DataFrame:
    p = cat.part
    return p.agg(F.count_if(F.length("p_name") > 20).alias("long_names"),
                 F.count_if(F.col("p_type").startswith("ECONOMY")).alias("economy_types"),
                 F.sum("p_size").alias("size_sum"))


@register("agg_rule_class_counts")
def agg_rule_class_counts(cat: Catalog) -> DataFrame:
    li = cat.lineitem
    w = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    cls = SC.rule_class(F.col("l_discount") * 10, F.col("l_tax") / 0.08, (F.col("l_quantity") - 1) / 49, w,
                        F.col("l_linenumber"))
    return li.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@register("fn_string_basic")
def fn_string_basic(cat: Catalog) -> DataFrame:
    t = F.col("text")
    return cat.documents.select(
        "doc_id", F.substring(F.upper(t), 1, 10).alias("upper10"), F.substring(F.lower(t), 1, 10).alias("lower10"),
        F.substring(F.replace(F.replace(t, F.lit("e"), F.lit("3")), F.lit("a"), F.lit("4")), 1, 10).alias("replaced10"),
        F.substring(t, 11, 90).alias("sub_10_100"), F.size(F.split(t, "a")).alias("split_len"))


@register("fn_reverse_palindrome")
def fn_reverse_palindrome(cat: Catalog) -> DataFrame:
    # filter inside each document's word array, explode only the palindromes
    pal = F.filter(SC.ascii_words(F.col("text")), lambda w: SC.is_palindrome(w))
    return cat.documents.select(F.explode(pal).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@register("fn_charclass_score")
def fn_charclass_score(cat: Catalog) -> DataFrame:
    return cat.conversations.select("conv_id", "turn", SC.strength_score(F.col("text")).alias("score"))


@register("fn_loc")
def fn_loc(cat: Catalog) -> DataFrame:
    t = F.col("text")
    return cat.documents.select("doc_id", loc_count(t).alias("loc"), loc_count(t, False).alias("loc_gate"))


@register("fn_math")
def fn_math(cat: Catalog) -> DataFrame:
    li = cat.lineitem
    q = F.col("l_quantity")
    a = SC.angle_of(F.col("l_linenumber"), 7)
    return li.groupBy("l_returnflag").agg(
        r6(F.sum(F.sqrt(q) * F.log(q)), "sqrt_log_sum"), r6(F.sum(F.sin(a)), "sin_sum"),
        r6(F.sum(F.cos(a)), "cos_sum"), r6(F.sum(SC.guarded_tan(a)), "tan_sum"))


@register("fn_array_hof")
def fn_array_hof(cat: Catalog) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    return cat.embeddings.select(
        "vec_id", F.size(F.filter(e, lambda x: x > 0)).alias("n_pos"),
        R.half_up(F.aggregate(F.transform(e, lambda x: x * 2.0), F.lit(0.0), lambda acc, x: acc + x), 6)
        .alias("sum_doubled"),
        F.size(F.flatten(F.array(e, F.filter(e, lambda x: x > 0)))).alias("flat_size"))


_REC_SCHEMA = ("id BIGINT, uuid STRING, active BOOLEAN, score DOUBLE, tags ARRAY<STRING>, "
               "metadata STRUCT<env: STRING, region: STRING, latency_limit_ms: INT>")


@register("fn_json_roundtrip")
def fn_json_roundtrip(cat: Catalog) -> DataFrame:
    """Record -> JSON text -> parsed struct -> validated and edited (score
    + 10, metadata.env = staging) -> JSON text again."""
    i = F.col("event_id")
    rec = F.struct(i.alias("id"), F.concat(F.lit("uuid_record_simulated_"), (i * 13).cast("string")).alias("uuid"),
                   (i % 2 == 0).alias("active"), F.col("value").alias("score"),
                   F.array(F.lit("cloud"), F.lit("lambda"), F.lit("green"), F.concat(F.lit("tag_"), (i % 5).cast("string")))
                   .alias("tags"),
                   F.struct(F.lit("production").alias("env"), F.lit("ap-south-1").alias("region"),
                            F.lit(150).alias("latency_limit_ms")).alias("metadata"))
    parsed = cat.events.select(F.from_json(F.to_json(rec), _REC_SCHEMA).alias("r"))
    valid = (F.col("r.id") >= 0) & F.col("r.metadata").isNotNull()
    edited = parsed.select(valid.alias("valid"), F.when(valid, F.col("r").withField("score", F.col("r.score") + 10.0)
                                                        .withField("metadata.env", F.lit("staging")))
                           .otherwise(F.col("r")).alias("r"))
    return edited.select(F.col("r.id").alias("event_id"), "valid", F.col("r.score").alias("score"),
                         F.col("r.metadata.env").alias("env"), F.size("r.tags").alias("n_tags"),
                         F.get_json_object(F.to_json("r"), "$.metadata.region").alias("region"))


def value_leaves(doc):
    """Numeric ``value`` members of a JSON text at any depth.  Inside a string
    the quotes would be escaped, so the pattern can't match there."""
    return F.regexp_extract_all(doc, F.lit(r'"value"\s*:\s*(-?[0-9][0-9.eE+-]*)'), F.lit(1))


@register("fn_json_leaves")
def fn_json_leaves(cat: Catalog) -> DataFrame:
    """Nested JSON per event with ``value`` leaves at two depths; every
    numeric ``value`` leaf, at any depth, is read back and aggregated per user
    (count, sum, mean)."""
    k = F.from_json("props", "k INT")
    doc = F.to_json(F.struct(F.struct(F.col("value").alias("value"),
                                      F.struct(k["k"].alias("value"), F.lit("leaf").alias("label")).alias("meta"))
                             .alias("a"), F.col("event_type").alias("label")))
    leaves = cat.events.select("user_id", doc.alias("doc")).select(
        "user_id", F.explode(value_leaves(F.col("doc"))).alias("leaf"))
    v = F.col("leaf").cast("double")
    return leaves.groupBy("user_id").agg(F.count(v).alias("leaves"), r6(F.sum(v), "leaf_sum"),
                                         R.half_up(F.avg(v), 9).alias("leaf_avg"))


@register("fn_hash_token")
def fn_hash_token(cat: Catalog) -> DataFrame:
    return cat.conversations.select("conv_id", "turn", F.sha2(F.col("text"), 256).alias("token_hash"))


@register("fn_rounding")
def fn_rounding(cat: Catalog) -> DataFrame:
    x = F.col("l_extendedprice") / 7
    return cat.lineitem.select("l_orderkey", "l_linenumber", R.half_even(x, 2).alias("round_half_even"),
                               R.half_up(x, 2).alias("round_half_up"), R.trunc(x).alias("truncated"))


@register("ml_naive_bayes_score")
def ml_naive_bayes_score(cat: Catalog) -> DataFrame:
    """Gaussian naive Bayes: per class and feature the mean and variance
    (+1 smoothing) from the labelled vectors; each vector scored with
    log(0.33) + sum of log(max(1e-9, density)); the best class wins.

    Fitting aggregates (class, dimension) pairs with partial aggregation.
    The fitted model -- classes x dimensions numbers, bounded by the model,
    not the data -- is folded into one row and broadcast; every vector is
    then scored in place with array functions: no shuffle of the vectors."""
    e = cat.embeddings.select("label", F.posexplode("embedding").alias("idx", "x"))
    params = e.groupBy("label", "idx").agg(F.avg(F.col("x").cast("double")).alias("mu"),
                                           (F.var_pop(F.col("x").cast("double")) + 1.0).alias("var"))
    per_class = params.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("idx", "mu", "var"))).alias("p"))
    model = per_class.agg(F.collect_list(F.struct(F.col("label").alias("cls"), "p")).alias("classes"))
    x = F.transform("embedding", lambda v: v.cast("double"))

    def class_score(c):
        terms = F.zip_with(x, c["p"], lambda xv, q: F.log(F.greatest(
            F.lit(1e-9), (1.0 / F.sqrt(2.0 * math.pi * q["var"])) * F.exp(-((xv - q["mu"]) ** 2) / (2.0 * q["var"])))))
        return F.struct(c["cls"].alias("cls"),
                        (F.lit(math.log(0.33)) + F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).alias("score"))

    scored = cat.embeddings.crossJoin(F.broadcast(model)).select(
        "vec_id", F.transform("classes", class_score).alias("s"))
    best = F.array_max(F.transform("s", lambda z: F.struct(z["score"].alias("score"), (-z["cls"]).alias("neg_cls"))))
    return scored.select("vec_id", (-best["neg_cls"]).alias("predicted"), R.half_up(best["score"], 6).alias("best_score"))
