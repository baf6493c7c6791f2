"""Deterministic seeded sampling, plain and stratified.

Random draws are replaced by ranking on ``md5(id | seed)``: the same seed
gives the same sample on any partitioning, and SQL engines reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed_hash(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest seed hash: an ordered take (each task
    keeps its best ``n``, then one merge of at most tasks x n rows)."""
    return df.orderBy(seed_hash(id_col, seed), F.col(id_col)).limit(n)


def stratified_sample(df: DataFrame, id_col: str, stratum: str, n: int, seed: int = 42,
                      materialize_input: bool = True) -> DataFrame:
    """Proportional sample of ``n`` rows.

    quota(s) = min(max(1, round_half_even(count(s) / total * n)), count(s)),
    where total counts every row, null strata included.  Rows with a null
    stratum get no quota but may come back as filler.  The union of quotas
    is trimmed to ``n`` (smallest hash first) or filled up to ``n`` from the
    rows not drawn.  Per-stratum ranking keeps ``row_number <= n`` with a
    literal bound, so Spark applies the group limit on every task before the
    shuffle: a stratum holding most rows sends at most ``n`` rows per task.
    Every window without partition keys runs on at most ``n + #strata`` rows.
    The input is read four times (totals, quotas, ranks, remainder), so it is
    checkpointed once unless ``materialize_input`` is False.
    """
    from wattline.session import materialize
    h = seed_hash(id_col, seed)
    rows = df.withColumn("_h", h)
    if materialize_input:
        rows = materialize(rows)
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    counts = (rows.where(F.col(stratum).isNotNull()).groupBy(stratum)
              .agg(F.count(F.lit(1)).alias("_cnt"))
              .crossJoin(F.broadcast(total))
              .withColumn("_quota", F.least(
                  F.greatest(F.lit(1), F.bround(F.col("_cnt") / F.col("_total") * n, 0).cast("long")),
                  F.col("_cnt"))))
    ranked = (rows.where(F.col(stratum).isNotNull())
              .withColumn("_rk", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col)))
              .where(F.col("_rk") <= n))
    drawn = ranked.join(counts.select(stratum, "_quota"), stratum, "inner") \
        .where(F.col("_rk") <= F.col("_quota")).drop("_rk", "_quota")

    # trim: at most n + #strata rows reach this window
    drawn = drawn.withColumn("_g", F.row_number().over(Window.orderBy("_h", id_col)))
    n_drawn = drawn.agg(F.count(F.lit(1)).alias("_nd"))
    kept = drawn.where(F.col("_g") <= n).drop("_g")

    # fill: best n of the rest by hash (ordered take), then keep what is needed
    rest = rows.join(drawn.select(id_col), id_col, "left_anti")
    cand = rest.orderBy("_h", id_col).limit(n)
    fill = (cand.withColumn("_g", F.row_number().over(Window.orderBy("_h", id_col)))
            .crossJoin(F.broadcast(n_drawn))
            .where(F.col("_g") <= F.lit(n) - F.col("_nd")).drop("_g", "_nd"))
    return kept.unionByName(fill).drop("_h")


def hash_split(df: DataFrame, id_col: str, fractions: dict[str, float], seed: int = 42) -> DataFrame:
    """Assign each row to a named split by a uniform number drawn from its
    seed hash: stable across runs and partitionings, no shuffle."""
    u = hash_uniform(id_col, seed)
    expr, acc = None, 0.0
    for name, f in fractions.items():
        acc += f
        expr = F.when(u < acc, F.lit(name)) if expr is None else expr.when(u < acc, F.lit(name))
    return df.withColumn("split", expr.otherwise(F.lit(list(fractions)[-1])))


def hash_uniform(id_col: str, seed: int) -> Column:
    return F.conv(F.substring(seed_hash(id_col, seed), 1, 12), 16, 10).cast("double") / float(16 ** 12)


def stratified_hash_split(df: DataFrame, id_col: str, stratum: str, fractions: dict[str, float],
                          seed: int = 42) -> DataFrame:
    """Split with the given proportions inside every stratum: each row's
    hash uniform is compared with its stratum's exact quantiles of those
    uniforms at the cumulative fractions (skew-safe grouped percentiles, one
    row per stratum), so every stratum is cut at its own ranks.  Rows with
    a null stratum use the global cut points."""
    from wattline.operators.quantiles import grouped_percentiles
    names = list(fractions)
    cum, acc = [], 0.0
    for n in names[:-1]:
        acc += fractions[n]
        cum.append(acc)
    d = df.withColumn("_u", hash_uniform(id_col, seed))
    th = grouped_percentiles(d.where(F.col(stratum).isNotNull()), [stratum], "_u",
                             {f"_t{i}": c for i, c in enumerate(cum)}, large=True)
    # one row per category, broadcast: a stratum's rows stay where they are
    j = d.join(F.broadcast(th), stratum, "left")
    expr = None
    for i, n in enumerate(names[:-1]):
        t = F.coalesce(F.col(f"_t{i}"), F.lit(cum[i]))
        cond = F.col("_u") <= t
        expr = F.when(cond, F.lit(n)) if expr is None else expr.when(cond, F.lit(n))
    return j.withColumn("split", expr.otherwise(F.lit(names[-1]))).drop("_u", *[f"_t{i}" for i in range(len(cum))])
