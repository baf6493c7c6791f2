"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.session import checkpoint_dir

#: A broadcast key bitmap has 2**KEY_BITS bits in at most 2**(KEY_BITS-6) rows,
#: whatever the number of keys: a proven bound (4 MB of words).
KEY_BITS = 24

#: Bytes of text that one numpy step works on inside a task.
CHUNK_BYTES = 1 << 20

#: A group with more than this part of all rows is joined by broadcast.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/wattline-llm/{name}-{uuid.uuid4().hex}"


#: Rows of a file of a table of which a bound is known.
FILE_ROWS = 1 << 16


def save(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut lineage by a Parquet table in the shared checkpoint folder.  With
    a bound of its ``rows`` (narrow ones), it is written as that many files as
    they fill, not one for each shuffle partition: every file costs the
    storage several calls, whatever it holds."""
    path = scratch_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Remove the files of a table that ``save`` wrote and nobody reads again."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/wattline-llm/" in f:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _slot(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << KEY_BITS))


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """Hashed bitmap of a key column: at most 2**18 rows (word, bits)."""
    slot = _slot(F.col(key))
    return (keys.groupBy(F.shiftright(slot, 6).alias("_word"))
            .agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64L) as int)))").alias("_bits")))


def maybe_in(df: DataFrame, key: str, bitmap: DataFrame) -> DataFrame:
    """Rows whose key may be in the bitmap (no false negatives).  Filters rows
    with wide columns before an exact join, without shuffling the others."""
    slot = _slot(F.col(key))
    hit = F.expr(f"(_bits & shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64L) as int))) != 0")
    return (df.withColumn("_word", F.shiftright(slot, 6))
            .join(F.broadcast(bitmap), "_word").where(hit).drop("_word", "_bits"))


def split_by(df: DataFrame, key: str, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the bitmap, all other rows), unshuffled."""
    hit = F.expr(f"coalesce((_bits & shiftleft(1L, cast(pmod(xxhash64(`{key}`), 64L) as int))) != 0, false)")
    both = df.withColumn("_word", F.shiftright(_slot(F.col(key)), 6)).join(F.broadcast(bitmap), "_word", "left").withColumn("_hit", hit).drop("_word", "_bits")
    return both.where("_hit").drop("_hit"), both.where("not _hit").drop("_hit")


#: Bytes of an Arrow batch.  Rows hold whole texts, and a worker beside a
#: small executor can't hold many copies of Spark's default of 64 MB.
BATCH_BYTES = 4 << 20


def give_back() -> None:
    """Return memory that is no longer used: of a task (workers live on between
    tasks) or, after a fit, of the driver."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):     # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches (a setting of the session) and workers
    that return their memory after each task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def whole_rows(df: DataFrame, *cols: tuple[Column, str]) -> DataFrame:
    """Named working columns, and the row itself as ``_row``: column names of
    the input can't clash with working columns."""
    return df.select(*[c.alias(name) for c, name in cols], F.struct("*").alias("_row"))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(utf-8 bytes, row offsets) of a string column; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into pieces of about CHUNK_BYTES of text (at least one
    row each).  Yields (rows, utf-8 bytes, row offsets)."""
    for batch in batches:
        data, off = text_bytes(batch.column(text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(off, off[start] + CHUNK_BYTES, side="right")) - 1)
            yield batch.slice(start, stop - start), data[off[start]:off[stop]], off[start:stop + 1] - off[start]
            start = stop


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join with one row per group.  ``size`` is a group's number of rows.
    At most HOT_PARTS groups hold 1/HOT_PARTS of all rows or more: these are
    broadcast, so no task gets more than such a share of one key."""
    hot = groups.where(F.col(size) >= F.lit(max(2, rows.count() // HOT_PARTS + 1)))
    return (rows.join(F.broadcast(hot), keys)
            .unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(groups, keys, "left")))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit integers (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
