"""Document fingerprints: bottom-k sketches of shingle hashes (built-ins only).

A fingerprint is the sorted array of the k smallest distinct 64-bit hashes of
a text's five-word shingles.  Sketches merge (bottom k of the union) and
estimate resemblance, containment and the number of distinct shingles.

Defined results: null text is empty; a text with fewer than five words has its
whole word sequence as one shingle; a text without words has an empty sketch;
two empty sketches have resemblance 1, an empty and a filled one 0.  Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import key_bitmap, maybe_in, save

K = 128
WORDS = 5
#: Documents with ids equal above the lowest bits form one block: at most 1,024
#: different ids are ordered in one window.
BLOCK_BITS = 10
SPACE_RUN = r"[\x20\x09-\x0D]+"


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, words: int = WORDS) -> DataFrame:
    """Adds the sketch of a text column.  The word hashes are a column of
    their own, so the shingle expression reads them by position."""
    h = f"_h_{out}"
    df = df.withColumn(h, F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE_RUN), lambda w: w != ""),
                                      lambda w: F.xxhash64(w)))
    n = F.size(h)
    many = F.transform(F.slice(F.col(h), F.lit(1), F.greatest(n - (words - 1), F.lit(0))),
                       lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + j) for j in range(1, words)]))
    shingles = F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(F.col(h)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(h)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def merge_parts(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.  The k smallest
    hashes are chosen by rank, so a hot key never gathers more than k of them."""
    hashes = parts.select(key, F.explode(sketch).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_h"))
    top = hashes.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch))
    return parts.select(key).distinct().join(top, key, "left").withColumn(sketch, F.coalesce(sketch, F.array().cast("array<bigint>")))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact when both sketches hold fewer than k hashes."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: (k-1) / (place of the k-th hash in the hash range)."""
    place = (F.element_at(a, -1).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(sketch: Column) -> Column:
    """16 hex digits per hash, joined."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents in id order: (_block, _last, id, text).  Each block
    also gets the first document of the block after it (``_last`` true; after
    the last block, the first of all), so ``lead`` over the block finds the
    next document of every row without a global sort."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_block", F.shiftright("_id", BLOCK_BITS))
    # blocks in order, however sparse the ids are: ranges of blocks by sampled bounds
    blocks = save(rows.groupBy("_block").agg(F.min("_id").alias("_first")).repartitionByRange("_block").withColumn("_part", F.spark_partition_id()), "blocks")
    # one row per partition: the only window without a key
    parts = blocks.groupBy("_part").agg(F.max("_block").alias("_end"))
    order = Window.orderBy("_part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("_part", F.coalesce(F.lag("_end").over(order), F.last("_end").over(whole)).alias("_before"))
    firsts = (blocks.join(parts, "_part")
              .select(F.col("_first").alias("_id"),
                      F.coalesce(F.lag("_block").over(Window.partitionBy("_part").orderBy("_block")), F.col("_before")).alias("_block")))
    ends = maybe_in(rows.drop("_block"), "_id", key_bitmap(firsts.select("_id"), "_id")).join(firsts, "_id")
    return (rows.withColumn("_last", F.lit(False)).select("_block", "_last", "_id", "_text")
            .unionByName(ends.withColumn("_last", F.lit(True)).select("_block", "_last", "_id", "_text")))


def edit_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketch of every text and of its edited text (second half replaced by
    the start of the next document in id order), with their likeness.

    A row with a null id has no place in the order: its edited text is its own
    text and ``near_next`` is null.  Repeated ids are ordered by text hash."""
    block = Window.partitionBy("_block").orderBy("_last", "_id", "_key")
    df = with_next(docs, id_col, text_col).withColumn("_key", F.xxhash64("_text"))
    df = df.withColumn("_next", F.lead("_text").over(block)).withColumn("_n", F.length("_text").cast("long"))
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), (F.col("_n") - half).cast("int")),
                      F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), half))
    df = df.select("_block", "_last", "_id", "_key", "_n", "_text", edited.alias("_edited"))
    df = with_fingerprint(with_fingerprint(df, "_text", "sketch", k), "_edited", "edited_sketch", k)
    df = df.select("_block", "_last", "_id", "_key", "_n", F.sha2("_edited", 256).alias("edited_sha256"), "sketch", "edited_sketch")
    df = df.withColumn("next_sketch", F.lead("sketch").over(block)).where("not _last").drop("_block", "_last", "_key")
    loose = (docs.where(F.col(id_col).isNull())
             .select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
             .withColumn("_n", F.length("_text").cast("long")).withColumn("edited_sha256", F.sha2("_text", 256)))
    loose = with_fingerprint(loose, "_text", "sketch", k).withColumn("edited_sketch", F.col("sketch"))
    loose = loose.withColumn("next_sketch", F.lit(None).cast("array<bigint>")).drop("_text")
    df = df.unionByName(loose)
    return df.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), "edited_sha256", "sketch", "edited_sketch",
                     resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                     F.when(F.col("next_sketch").isNotNull(), resemblance(F.col("sketch"), F.col("next_sketch"), k)).alias("near_next"),
                     distinct_shingles(F.col("sketch"), k).alias("n_shingles_est"))
