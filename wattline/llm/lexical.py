"""Ranked lexical search by an Aho-Corasick scan of the documents.

No index of documents is built.  The distinct terms of all items go into one
automaton; each term stands in it with a separator on both sides, so it only
matches whole terms.  Every task runs the automaton over its texts and counts
the hits per document (tf).  An output of the automaton is a term number, and
postings map it to the items that hold it, with their repeats.

1. A first scan counts documents, terms and, per term of an item, the
   documents that hold it.  Tasks return sums, so one row per task and term is
   shuffled.
2. The weights follow, and a second scan scores every document against every
   item that shares a term with it.  A task keeps the best of each item; these
   are merged in two steps, so no task merges the lists of all others.

Items are taken in blocks of a bounded size, and one automaton is broadcast at
a time; each block is compared with all documents.

Defined results: a null text has no term; rows repeated under one id are
documents of their own; a null id comes last among equal scores; an item
without terms, or with terms that no document holds, has no rows; equal item
rows are one item, different texts under one item id are ranked apart; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import map_arrow, save, text_bytes

TOP = 20
ITEMS = 2048             # items of a block
ITEM_BYTES = 4 << 20     # bytes of item texts of a block; a longer item is a block of its own
SCAN_BYTES = 1 << 19     # bytes of text that the automaton runs over at once
DOCS = 1024              # documents of a step: (documents, items) scores are held
HOLD = 1 << 18           # candidates a task holds before it cuts each item's list
PARTS = 64               # first step of the merge

#: Bytes of terms (A-Z in lower case) stay, all others are a separator.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


# ---- the automaton ------------------------------------------------------

@dataclass(frozen=True)
class Block:
    """Items of one block: their terms, and the postings of each term."""
    items: int
    terms: list[bytes]
    start: np.ndarray      # first posting of each term, and the end
    item: np.ndarray       # postings: item, and how often it holds the term
    times: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Block:
        number: dict[bytes, int] = {}
        post: list[dict[int, int]] = []
        for i, (_, text) in enumerate(items):
            for t in terms(text):
                k = number.setdefault(t, len(number))
                if k == len(post):
                    post.append({})
                post[k][i] = post[k].get(i, 0) + 1
        sizes = [len(p) for p in post]
        return cls(len(items), list(number), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
                   np.array([i for p in post for i in p], np.int64), np.array([n for p in post for n in p.values()], np.int64))


def automaton(words: list[bytes]):
    """Bytes are read as Latin-1, one character each."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for k, t in enumerate(words):
        a.add_word(f" {t.decode('latin-1')} ", k)
    if words:
        a.make_automaton()
    return a


def _pieces(data: bytes, off: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(first document, first byte, bytes with a separator on both sides) of
    runs of whole documents; a longer document is cut between two terms."""
    at, doc, n = 0, 0, len(off) - 1
    while doc < n:
        stop = max(doc + 1, int(np.searchsorted(off, at + SCAN_BYTES, side="right")) - 1)
        end = int(off[stop])
        if end - at > SCAN_BYTES:       # one long document
            cut = data.rfind(b" ", at + 1, at + SCAN_BYTES)
            cut = cut if cut > 0 else data.find(b" ", at + SCAN_BYTES, end)
            if 0 < cut < end:
                yield doc, at, b" " + data[at:cut] + b" "
                at = cut
                continue
        yield doc, at, b" " + data[at:end] + b" "
        at, doc = end, stop


def scan(batches: Iterator[pa.RecordBatch], words: list[bytes]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, n, document, term, tf): rows of a batch, the number of terms of
    each, and the hits counted per (document of these rows, term)."""
    found = automaton(words)
    for batch in batches:
        for first in range(0, batch.num_rows, DOCS):
            rows = batch.slice(first, DOCS)
            raw, off = text_bytes(rows.column("text"))
            size = np.diff(off)
            # folded, with one separator behind each document
            bounds = off.tolist()
            data = b"".join([raw[i:j].tobytes().translate(FOLD) + b" " for i, j in zip(bounds, bounds[1:])])
            at = off[:-1] + np.arange(len(size))
            term = np.frombuffer(data, np.uint8) != 32
            begins = term.copy()
            begins[1:] &= ~term[:-1]
            n = np.add.reduceat(begins, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
            doc, hit = [], []
            if words:
                for _, start, piece in _pieces(data, np.append(at, len(data))):
                    got = np.fromiter((x for pair in found.iter(piece.decode("latin-1")) for x in pair), np.int64).reshape(-1, 2)
                    # the last byte of a hit is the separator behind the term
                    doc.append(np.searchsorted(at, got[:, 0] - 2 + start, side="right") - 1)
                    hit.append(got[:, 1])
            if hit and sum(map(len, hit)):
                key, tf = np.unique(np.concatenate(doc) * len(words) + np.concatenate(hit), return_counts=True)
                yield rows, n, key // len(words), key % len(words), tf.astype(np.int64)
            else:
                none = np.zeros(0, np.int64)
                yield rows, n, none, none, none


# ---- the two scans ------------------------------------------------------

def _statistics(docs: DataFrame, words: list[bytes]) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents per term)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        df, some, total = np.zeros(len(own), np.int64), 0, 0
        for _, n, _, term, _ in scan(batches, own):
            df += np.bincount(term, minlength=len(own))
            some += int((n > 0).sum())
            total += int(n.sum())
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], k))), pa.array(np.concatenate(([some, total], df[k])))], names=["term", "n"])

    sums = map_arrow(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in sums.collect()}       # one row per term of the block
    return got.get(-2, 0), got.get(-1, 0), np.array([got.get(k, 0) for k in range(len(words))], np.int64)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if not n_terms:
        return np.full(len(n), 75, np.int64)
    if len(n) and int(n.max()) * 25 * n_docs >= 1 << 63:
        return np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 75 + 25 * n * n_docs // n_terms


class _Best:
    """The best ``top`` documents of each item seen so far."""

    def __init__(self, items: int, top: int):
        self.top, self.rows = top, np.zeros((0, 4), np.int64)        # item, -score, null id, id
        self.new: list[np.ndarray] = []
        self.held, self.least = 0, np.zeros(items, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        doc, item = np.nonzero((score > 0) & (score >= self.least))
        self.new.append(np.stack([item, -score[doc, item], no_id[doc], ids[doc]], axis=1))
        self.held += len(doc)
        if self.held > HOLD:
            self.cut()

    def cut(self) -> None:
        rows = np.concatenate([self.rows, *self.new])
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))) if len(rows) else np.zeros(0, np.int64)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        last = rows[place == self.top - 1]
        self.least[last[:, 0]] = -last[:, 1]
        self.rows, self.new, self.held = rows[place < self.top], [], 0


def _scored(docs: DataFrame, block: Block, w: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The best documents of each item in each task: (item, doc_id, score)."""
    # plain values: executors need not have this module
    shared = docs.sparkSession.sparkContext.broadcast((block.items, block.terms, block.start, block.item, block.times, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, words, start, item, times, weight = shared.value
        best = _Best(items, top)
        for rows, n, doc, term, tf in scan(batches, words):
            m = length_norm(n, n_docs, n_terms)[doc]
            part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            size = start[term + 1] - start[term]
            post = np.repeat(start[term] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(term) else np.zeros(0, np.int64)
            score = np.zeros(rows.num_rows * items, np.int64)
            np.add.at(score, np.repeat(doc, size) * items + item[post], np.repeat(part, size) * times[post])
            ids = rows.column("doc_id")
            best.add(score.reshape(rows.num_rows, -1), ids.fill_null(0).to_numpy(), np.asarray(ids.is_null(), dtype=np.int64))
        best.cut()
        r = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(r[:, 0]), pa.array(r[:, 3], mask=r[:, 2] == 1), pa.array(-r[:, 1])], names=["item", "doc_id", "score"])

    return map_arrow(docs, run, "item long, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items, read one after the other."""
    block, size = [], 0
    for r in items.toLocalIterator():
        k = len(r["text"].encode())
        if block and (len(block) >= ITEMS or size + k > ITEM_BYTES):
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += k
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents of each item: (item_id, rank, doc_id, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    out = None
    for rows in _blocks(items.orderBy("item_id", "text")):
        block = Block.of(rows)
        n_docs, n_terms, df = _statistics(docs, block.terms)
        near = _scored(docs, block, weights(df, n_docs), n_docs, n_terms, top)
        near = near.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "part"], ["item"]):
            near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(i, int(x) if x is not None else None) for i, (x, _) in enumerate(rows)], "item long, item_id long")
        found = save(near.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "lexical")
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
