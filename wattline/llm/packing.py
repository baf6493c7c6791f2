"""Best-fit packing of token sequences by length patterns.

1. A task per partition tokenises texts and cuts them into pieces.
2. The histogram of piece lengths (at most ``max_len`` rows) goes to the
   driver, which plans the whole packing from it: two- and three-piece
   patterns that fill a sequence exactly, repeat counts fitted to the
   histogram by non-negative least squares and rounded, then best-fit
   decreasing over what is left, by counts, not by pieces.
3. A piece's rank among those of its length comes from per-task counts; a
   lookup in the plan gives its sequence and its place there.

Nothing but the histogram reaches the driver, and no window runs over all
pieces of a length.

Defined results: null and empty texts are the end token alone; rows repeated
under one id are packed each; a null id stays null; no rows give no pieces;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import give_back, map_arrow, save

MAX_LEN = 1024
END_ID = 2
FIT_STEPS = 150


# ---- tokens -------------------------------------------------------------

class ByteBpe:
    """Token ids of a byte-level BPE file.

    Where the file's merges are its ids in order, plain Latin texts go through
    tiktoken with the same merges (same ids, several times faster); all other
    texts, and those that hold a special token's string, through tokenizers."""

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")

    def __init__(self, path: str):
        self.path, self.slow, self.fast = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        if (spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                and not spec.get("normalizer") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))):
            import tiktoken
            # byte-level files write a byte as itself where it prints, else as 256, 257, ...
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
            hidden = [b for b in range(256) if b not in set(shown)]
            byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
            ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
            self.fast = tiktoken.Encoding("file", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast and self.PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def cut(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be short."""
    first = (n - 1) % max_len + 1
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece.  ``part`` and ``rank`` number the pieces of one
    length within the task that made them."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    fields = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bpe, part = ByteBpe(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        for batch in batches:
            out, done = [], 0
            for doc_id, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                ids = np.array(bpe.encode(text.as_py() or "") + [end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), max_len)):
                    own = ids[s:s + n]
                    row = (doc_id, k, s, n, zlib.crc32(own.tobytes()), part, int(seen[n]))
                    out.append(row + (own.astype(np.int32),) if with_ids else row)
                    seen[n] += 1
                done += len(ids)
                if with_ids and done > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields)], names=names)
                    out, done = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_arrow(rows, make, schema)


# ---- plan ---------------------------------------------------------------

def patterns(max_len: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, that fill a sequence exactly; c is 0 for pairs."""
    b, c = np.meshgrid(np.arange(1, max_len), np.arange(max_len), indexing="ij")
    a = max_len - b - c
    keep = (a >= b) & (b >= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit(hist: np.ndarray, pats: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, A the length counts of
    the patterns, by multiplicative updates (which keep x non-negative)."""
    size = len(hist)
    used = (pats > 0)

    def spread(x):      # A x
        return sum(np.bincount(pats[:, j], x * used[:, j], size) for j in range(pats.shape[1]))

    def gather(h):      # A' h
        return sum(h[pats[:, j]] * used[:, j] for j in range(pats.shape[1]))

    target = gather(hist)
    x = np.where(target > 0, hist[pats].sum(axis=1) / max(1.0, len(pats) ** 0.5), 0.0)
    for _ in range(steps):
        x *= target / np.maximum(gather(spread(x)), 1e-12)
    return x


class Plan:
    """Runs (length, first rank, sequences, sequence base, offset, per sequence):
    piece r of the run lies in sequence base + r % sequences."""

    def __init__(self, hist: np.ndarray, max_len: int):
        self.left = hist.astype(np.int64).copy()
        self.next_rank = np.zeros(max_len + 1, np.int64)
        self.max_len, self.sequences, self.runs = max_len, 0, []

    def place(self, length: int, count: int, base: int, offset: int, each: int = 1) -> None:
        self.runs.append((length, int(self.next_rank[length]), count, base, offset, each))
        self.next_rank[length] += count * each
        self.left[length] -= count * each

    def open(self, count: int) -> int:
        base, self.sequences = self.sequences, self.sequences + count
        return base

    def use(self, pattern: np.ndarray, count: int) -> None:
        base, offset = self.open(count), 0
        for length in pattern:
            self.place(int(length), count, base, offset)
            offset += int(length)

    def by_patterns(self, pats: np.ndarray) -> None:
        """Fit, round down and place.  Rounding up would use up the short
        pieces that best fit needs to fill what is left."""
        live = pats[((self.left[pats] > 0) | (pats == 0)).all(axis=1)]
        if not len(live):
            return
        x = fit(np.where(np.arange(len(self.left)) == 0, 0, self.left).astype(float), live)
        counts = np.floor(x).astype(np.int64)
        for i in np.argsort(-x, kind="stable"):
            if counts[i] <= 0:
                break
            lengths = live[i][live[i] > 0]
            kinds, times = np.unique(lengths, return_counts=True)
            n = min(int(counts[i]), int((self.left[kinds] // times).min()))
            if n > 0:
                self.use(lengths, n)

    def best_fit(self) -> None:
        """Best-fit decreasing, a run of equal pieces at a time."""
        free: dict[int, list[tuple[int, int]]] = {}    # room -> (base, count)
        for length in range(self.max_len, 0, -1):
            while (n := int(self.left[length])) > 0:
                room = min((r for r in free if r >= length), default=0)
                if room:
                    base, count = free[room].pop()
                    if not free[room]:
                        del free[room]
                else:
                    room = self.max_len
                    count = -(-n // (room // length))
                    base = self.open(count)
                each = room // length
                whole, rest = min(count, n // each), 0
                if whole:
                    self.place(length, whole, base, self.max_len - room, each)
                    self._free(free, room - length * each, base, whole)
                if whole < count and (rest := int(self.left[length])) and rest < each:
                    self.place(length, 1, base + whole, self.max_len - room, rest)
                    self._free(free, room - length * rest, base + whole, 1)
                    whole += 1
                if whole < count:
                    self._free(free, room, base + whole, count - whole)

    @staticmethod
    def _free(free: dict, room: int, base: int, count: int) -> None:
        if room > 0:
            free.setdefault(room, []).append((base, count))


def plan_packing(hist: np.ndarray, max_len: int = MAX_LEN) -> Plan:
    """Full sequences, then patterns, then best fit for what they leave."""
    plan = Plan(hist, max_len)
    if max_len >= 2:
        if plan.left[max_len]:
            plan.use(np.array([max_len]), int(plan.left[max_len]))
        plan.by_patterns(patterns(max_len))
    plan.best_fit()
    return plan


# ---- job ----------------------------------------------------------------

def pack_pieces(cut_pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds (sequence_id, offset) to the rows of ``pieces``."""
    rows = save(cut_pieces, "pieces")
    spark = rows.sparkSession
    counts = save(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    hist = np.zeros(max_len + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():    # at most max_len rows
        hist[length] = n
    plan = plan_packing(hist, max_len)
    give_back()
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6)
    # key of a rank: length and rank in one sortable number
    shift = np.int64(1 << 50)
    table = spark.sparkContext.broadcast((runs[:, 0] * shift + runs[:, 1], runs))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, runs = table.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, length * np.int64(1 << 50) + rank, side="right") - 1]
            at = rank - run[:, 1]
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + [
                pa.array(run[:, 3] + at % run[:, 2]), pa.array(run[:, 4] + at // run[:, 2] * length)], names=kept + ["sequence_id", "offset"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, look_up, kept + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    out = pack_pieces(pieces(docs, tokenizer, id_col, text_col, max_len, end_id, with_ids), max_len)
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    return out.select(*order)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from ``pack(..., with_ids=True)``: a sequence holds at most max_len ids."""
    part = F.struct("offset", "doc_id", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
                       F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
