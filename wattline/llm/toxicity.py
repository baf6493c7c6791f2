"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic passages and one on
ordinary text.  A text is cut into windows of whole words; each window is
compressed against the ordinary dictionary and against toxic + ordinary, and
the bytes saved are its distance.  A logistic model over the sorted distances
of a text gives the score; its threshold is calibrated on labelled rows that
the dictionaries have not seen.

Fitting uses a bounded sample of labelled rows (``MAX_TOXIC``,
``MAX_ORDINARY``, ``MAX_CHARS``); scoring reads every whole text.

Defined results: null and empty texts are one empty window; without rows of
both labels every text scores the share of toxic rows (0 without any label);
rows repeated under one id are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import give_back, held_out, map_arrow

THRESHOLD = 0.3
#: Bounds of the labelled sample: rows of each class, characters in all.
MAX_TOXIC, MAX_ORDINARY, MAX_CHARS = 1500, 5000, 48_000_000
WINDOW = 64            # bytes of a window, at most
GRAM = 5               # characters of the sequences that mark toxic passages
TOXIC_SIZES = (1024, 1536, 2048, 3072)   # bytes of the toxic dictionary; the best on calibration rows is taken
ORDINARY_SIZE = 16384
COMPRESS = {"window_log": 17, "chain_log": 16, "hash_log": 15, "search_log": 4, "min_match": 3, "target_length": 16,
            "strategy": 6, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}

_CUT = re.compile(rb"(?s).{1,%d}(?=\s|$)|.{%d}" % (WINDOW, WINDOW))


@dataclass
class Model:
    toxic: bytes            # dictionary contents
    ordinary: bytes
    centre: np.ndarray      # of the features
    scale: np.ndarray
    weights: np.ndarray     # last: intercept
    constant: float | None = None


def windows(text: str) -> list[bytes]:
    return _CUT.findall(text.lower().encode()) or [b""]


class Distance:
    """Bytes that toxic + ordinary saves over ordinary alone, per window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard
        params = zstandard.ZstdCompressionParameters(**COMPRESS)

        def against(content: bytes):
            if len(content) < 8:
                return zstandard.ZstdCompressor(compression_params=params)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            return zstandard.ZstdCompressor(compression_params=params, dict_data=d)

        self.plain, self.both = against(ordinary).compress, against(ordinary + toxic).compress

    def features(self, text: str) -> list[float]:
        plain, both = self.plain, self.both
        d = np.sort(np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float))[::-1]
        n = len(d)
        return [d[0], d[:2].mean(), d[:4].mean(), d[:max(1, n // 10)].mean(), d.mean(), np.log1p(n), np.minimum(d, 3).mean()]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Contents of a trained dictionary; with too few samples, the samples."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]


def _spaced(text: str) -> str:
    return " " + " ".join(text.lower().split()) + " "


def toxic_passages(toxic: list[str], ordinary: list[str], min_z: float = 4.0, ratio: float = 40.0) -> list[bytes]:
    """The parts of toxic texts whose character sequences are far more common
    in toxic than in ordinary texts (by texts that hold them)."""
    def holders(texts: list[str], only: set[str] | None = None) -> Counter:
        c: Counter = Counter()
        for t in map(_spaced, texts):
            grams = {t[i:i + GRAM] for i in range(len(t) - GRAM + 1)}
            c.update(grams if only is None else grams & only)
        return c

    a = {g: n for g, n in holders(toxic).items() if n >= 3}
    b = holders(ordinary, set(a))      # the others can't mark a passage
    na, nb = max(1, len(toxic)), max(1, len(ordinary))

    def marks(g: str) -> bool:
        x, y = a[g], b[g]
        p = (x + y) / (na + nb)
        z = (x / na - y / nb) / (p * (1 - p) * (1 / na + 1 / nb) + 1e-12) ** 0.5
        return z > min_z and x / na >= min(ratio, nb / 4) * (y + 0.5) / nb

    good = {g for g in a if marks(g)}
    out = []
    for t in map(_spaced, toxic):
        mark = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - GRAM + 1):
            if t[i:i + GRAM] in good:
                mark[i + 1:i + 1 + GRAM] = 1
        edge = np.flatnonzero(np.diff(mark))
        out += [t[s:e].encode() for s, e in zip(edge[::2], edge[1::2])]
    return out


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps; w weighs rows."""
    beta = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(len(beta))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x / w.sum() + ridge, x.T @ (w * (p - y)) / w.sum() + 1e-3 * beta)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _best_f1(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(F1, cut): the cut lies midway between two scores."""
    o = np.argsort(-z, kind="stable")
    tp, n = np.cumsum((w * y)[o]), np.cumsum(w[o])
    f1 = 2 * tp / (n + (w * y).sum())
    last = np.r_[z[o][1:] < z[o][:-1], True]
    i = int(np.argmax(np.where(last, f1, -1)))
    return float(f1[i]), float(z[o][i] if i + 1 == len(z) else (z[o][i] + z[o][i + 1]) / 2)


def fit_rows(toxic: list[str], ordinary: list[str], share: float) -> Model:
    """Model from texts in random order; ``share`` of toxic among labelled rows."""
    nil = np.zeros(0)
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model(b"", b"", nil, nil, nil, constant=share)
    ha, hb = max(1, len(toxic) // 2), len(ordinary) // 2
    learn_t, learn_o = toxic[:ha], ordinary[:hb]
    test = toxic[ha:] + ordinary[hb:]
    y = np.array([1.0] * (len(toxic) - ha) + [0.0] * (len(ordinary) - hb))
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    passages = toxic_passages(learn_t, learn_o)
    passages = [b" ".join(passages[i:i + 8]) for i in range(0, len(passages), 8)] or [x for t in learn_t for x in windows(t)]
    step = max(1, sum(len(t) for t in learn_o) // (8 << 20))   # about 8 MB of ordinary windows, evenly
    plain = _dictionary([x for t in learn_o for x in windows(t)][::step], ORDINARY_SIZE)
    best: tuple[float, Model] | None = None
    for size in TOXIC_SIZES:
        dist = Distance(toxic_dict := _dictionary(passages, size), plain)
        x = np.array([dist.features(t) for t in test])
        centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.3)     # a feature that never varies must not decide
        z = np.c_[(x - centre) / scale, np.ones(len(x))]
        beta = _logistic(z, y, w)
        f1, cut = _best_f1(z @ beta, y, w)
        beta[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut     # the cut scores THRESHOLD
        if best is None or f1 > best[0]:
            best = (f1, Model(toxic_dict, plain, centre, scale, beta))
    return best[1]


def choose(rows: list[tuple]) -> list[tuple]:
    """(place, id, toxic, key) of the sample from (rank, id, toxic, key of the
    text, length): by rank, each text once (toxic if any of its rows is), as
    long as MAX_CHARS holds; a text that does not fit is passed over, and no
    text takes more than a tenth."""
    toxic = {key for _, _, label, key, _ in rows if label}
    out, seen, used = [], set(), 0
    for _, doc, _, key, n in sorted(rows, key=lambda r: (r[0], r[1])):
        if key in seen or n > MAX_CHARS // 10 or used + n > MAX_CHARS:
            continue
        seen.add(key)
        used += n
        out.append((len(out), doc, key in toxic, key))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out."""
    own = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
           .select("doc_id", (F.col("toxic") != 0).alias("toxic")).distinct())
    seen = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(seen.values())
    # the share of hashes that holds four samples of a class on average goes to the ranking, not all rows
    part = F.lit(float(1 << 30)) * 4 * F.when(F.col("toxic"), MAX_TOXIC / max(1, seen.get(True, 0))).otherwise(MAX_ORDINARY / max(1, seen.get(False, 0)))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part).withColumn("_r", rank).where(F.col("_r") <= F.when(F.col("toxic"), MAX_TOXIC).otherwise(MAX_ORDINARY))
    # at most MAX_TOXIC + MAX_ORDINARY ids: a proven bound; of an id's texts, that with the smallest key
    key = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    sized = (docs.select("doc_id", key.alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(F.broadcast(ids), "doc_id")
             .groupBy("doc_id", "toxic", "_r").agg(F.min(F.struct("key", "n")).alias("t")).select("doc_id", "toxic", "_r", "t.key", "t.n"))
    chosen = choose([(r["_r"], r["doc_id"], r["toxic"], r["key"], r["n"]) for r in sized.collect()])
    spark = docs.sparkSession
    chosen = spark.createDataFrame(chosen, "place int, doc_id long, toxic boolean, key string")
    sample = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).join(F.broadcast(chosen), ["doc_id", "key"])
              .dropDuplicates(["place"]).orderBy("place").select("text", "toxic").collect())
    toxic, ordinary = [r["text"] for r in sample if r["toxic"]], [r["text"] for r in sample if not r["toxic"]]
    del sample
    model = fit_rows(toxic, ordinary, seen.get(True, 0) / total if total else 0.0)
    del toxic, ordinary
    give_back()
    return model


def _scorer(model: Model):
    """Array of texts -> scores; built once in a task."""
    dist = None if model.constant is not None else Distance(model.toxic, model.ordinary)

    def scores(texts: pa.Array) -> np.ndarray:
        if dist is None or not len(texts):
            return np.full(len(texts), model.constant or 0.0)
        x = np.array([dist.features(t.as_py() or "") for t in texts])
        z = ((x - model.centre) / model.scale) @ model.weights[:-1] + model.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score from 0 to 1, predicted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            s = scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()),
                                              pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with all their columns (one pass, no join)."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column("text")) < THRESHOLD))

    return map_arrow(docs, run, docs.schema)
