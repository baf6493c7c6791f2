"""Exact deduplication by 128-bit content hash, with byte comparison.

Documents are grouped by the MD5 of their normalised text.  Only texts whose
hash occurs more than once are read again: they are grouped by hash *and* by
the text itself, so the aggregation compares bytes and a collision ends up in
two groups.  Copies collapse inside each map task before the shuffle, so a hot
group costs one row per task.

Defined results: null text counts as empty; a null id is a row like any other
and loses against any non-null id; rows repeated under one id count in
``group_size``; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, key_bitmap, maybe_in, save, split_by, whole_rows

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def content_hash(norm: Column) -> Column:
    """128 bits, as binary."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, text_sha256).

    ``digest`` maps the normalised text to the grouping hash (tests pass a
    weak one to force collisions)."""
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    slim = save(rows.select("_id", digest(F.col("_norm")).alias("_digest"),
                            F.unhex(F.sha2("_norm", 256)).alias("_sha")), "dedup")
    repeated = slim.groupBy("_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_digest")
    # a bitmap instead of joins: a hot hash stays in the tasks that read it,
    # and a row too many does no harm, as the grouping below is exact
    ids = maybe_in(slim, "_digest", key_bitmap(repeated, "_digest")).select("_id")
    again = maybe_in(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", key_bitmap(ids, "_id"))
    exact = (again.select("_id", normalised(F.col("_text")).alias("_norm"))
             .select("_id", "_norm", digest(F.col("_norm")).alias("_digest"))
             .groupBy("_digest", "_norm").agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # Two byte-different texts with equal 128-bit hash differ in the 256-bit
    # one; should both agree, the job stops instead of merging them.
    named = (exact.groupBy("_digest", F.unhex(F.sha2("_norm", 256)).alias("_sha"))
             .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
             .where("group_size > 1")
             .withColumn("keep_id", F.when(F.col("texts") == 1, F.col("keep_id"))
                         .otherwise(F.raise_error(F.lit("different texts share both hashes")).cast("long"))))
    named = save(named.drop("texts"), "dedup-groups")
    out = join_groups(slim, named, ["_digest", "_sha"], "group_size")
    keep = F.coalesce(F.col("keep_id"), F.col("_id"))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"),
                      F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
                      F.col("_id").eqNullSafe(keep).alias("kept"),
                      F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns.  Only rows
    that may go are shuffled; of rows repeated under the id that stays, the
    first by its other columns stays."""
    groups = save(exact_groups(docs, id_col, text_col).where("group_size > 1")
                  .select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_sha"), "kept"), "dedup-kept")
    gone = groups.where("not kept").select("_gone", "_sha").distinct()
    repeated = groups.where("kept").groupBy("_gone", "_sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_gone", "_sha")
    rows = whole_rows(docs, (F.col(id_col), "_own"), (F.col(text_col), "_own_text"))
    may, clear = split_by(rows, "_own", key_bitmap(gone.union(repeated).select(F.col("_gone").alias("_own")), "_own"))
    may = may.withColumn("_own_sha", F.sha2(normalised(F.col("_own_text")), 256)).drop("_own_text")
    may = may.join(gone, may["_own"].eqNullSafe(gone["_gone"]) & (may["_own_sha"] == gone["_sha"]), "left_anti")
    first = F.row_number().over(Window.partitionBy("_own", "_own_sha").orderBy("_row"))
    may = may.withColumn("_nth", first).where("_nth = 1")
    return may.select("_row").unionByName(clear.select("_row")).select("_row.*")
