"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (one to three characters,
word boundaries included), weighted by (1 + log tf) * idf and normalised.
Each language has several centroids, from spherical k-means over a bounded
sample of its texts; a text takes the language of the centroid with the
largest cosine.  A text farther from its centroid than nearly all of that
centroid's own sample texts is rejected.

Fitting uses at most ``SAMPLE`` texts a language and learns every language
(a centroid takes 16 KB); prediction reads every whole text.

Defined results: null texts and texts without a letter are ``und`` with score
0; without a labelled language every text is ``und``; rows repeated under one
id are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import held_out, join_groups, key_bitmap, map_arrow, maybe_in, save

BUCKETS = 4096
CLUSTERS = 4
#: Sampled texts of each language, characters of each sampled text counted whole.
SAMPLE = 600
#: Centroids that texts are compared with at once; every language is learned.
BLOCK_CENTROIDS = 1024
RADIUS_SHARE = 0.995       # part of a centroid's sample texts within its radius
BLOCK_ROWS, BLOCK_CHARS = 256, 1 << 20
PIECE = 1 << 20            # characters whose n-grams are hashed at once
TEMPERATURES = (5.0, 10.0, 20.0, 40.0, 80.0)
_LETTER = re.compile(r"[^\W\d_]")
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@dataclass
class Model:
    idf: np.ndarray          # BUCKETS
    centroids: np.ndarray    # (languages * clusters, BUCKETS), unit length
    radius: np.ndarray       # largest distance 1 - cosine that is not rejected
    of: np.ndarray           # language of a centroid
    languages: list[str]
    temperature: float


def counts(texts: list[str]) -> np.ndarray:
    """Dense (rows, BUCKETS) n-gram counts.  Characters below U+0250 that are
    no letters count as a space.  Works on PIECE characters at a time, also
    within a text."""
    lower = [f" {t.lower()} " for t in texts]
    ends = np.cumsum([len(t) for t in lower])
    source = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    del lower
    letter = _letters()
    out = np.zeros(len(texts) * BUCKETS)
    for first in range(0, len(source), PIECE):
        cp = source[first:first + PIECE + 2]        # n-grams that begin here may end behind
        row = np.searchsorted(ends, np.arange(first, first + len(cp)), side="right")
        low = cp < len(letter)
        cp = np.where(low & ~letter[np.minimum(cp, len(letter) - 1)], 32, cp).astype(np.uint64)
        h = np.zeros(len(cp), np.uint64)
        for n in range(3):
            h = h[:len(cp) - n] * np.uint64(31) + (cp[n:] + np.uint64(1)) * _MULT[n] if n else (cp + np.uint64(1)) * _MULT[0]
            same = row[n:] == row[:len(row) - n]
            blank = (cp[n:] == 32) & (cp[:len(cp) - n] == 32)     # runs of blanks, and single blanks
            key = ((h ^ (h >> np.uint64(29))) * _MULT[2] >> np.uint64(52)).astype(np.int64)
            ok = same & ~blank
            ok[PIECE:] = False
            out += np.bincount((row[:len(row) - n] * BUCKETS + key)[ok], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x250)])


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Row ranges of at most BLOCK_ROWS texts and about BLOCK_CHARS characters."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= BLOCK_ROWS or chars + len(t) > BLOCK_CHARS):
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors (float32)."""
    out = np.empty((len(texts), BUCKETS), np.float32)
    for a, b in blocks(texts):
        tf = counts(texts[a:b])
        np.log1p(tf, out=tf)
        tf *= idf
        norm = np.sqrt((tf * tf).sum(axis=1, keepdims=True))
        out[a:b] = tf / np.maximum(norm, 1e-12)
    return out


def spherical_kmeans(x: np.ndarray, k: int, steps: int = 15) -> np.ndarray:
    """Unit centroids; the first is the mean direction's nearest text, each
    next the text least like those before."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    for _ in range(min(k, len(x)) - 1):
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    c = x[start]
    for _ in range(steps):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(docs: DataFrame) -> Model | None:
    """Learn from rows that have a language and are not held out."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    ids = own.select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # a language's share of hashes that holds four samples on average goes to the ranking, not all its rows
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * 4 * SAMPLE / F.col("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = join_groups(ids, sizes, ["lang"], "n").where(part).withColumn("_r", rank).where(F.col("_r") <= SAMPLE).select("doc_id", "lang")
    ids = save(ids.distinct(), "language-sample")
    # at most SAMPLE ids a language, so no key is hot; a bitmap keeps the other texts where they are
    near = maybe_in(own.select("doc_id", "lang", "text"), "doc_id", key_bitmap(ids, "doc_id"))
    sample = near.join(ids, ["doc_id", "lang"]).where(F.col("text").rlike(r"\p{L}"))
    sample = sample.select("lang", "text").repartition("lang")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in blocks(texts):
                held += (counts(texts[a:b]) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([held.tobytes()])], names=["n", "held"])

    df, total = np.zeros(BUCKETS), 0
    for r in map_arrow(sample, seen, "n long, held binary").collect():     # one row a task, of fixed size
        df, total = df + np.frombuffer(r["held"], np.int64), total + r["n"]
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 0.1

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:     # at most SAMPLE texts
        x = vectors(list(pdf["text"]), idf)
        c = spherical_kmeans(x, CLUSTERS)
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        far = [float(np.quantile(1 - cos[own == j, j], RADIUS_SHARE)) if (own == j).any() else 0.0 for j in range(len(c))]
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "centroid": [v.astype("<f4").tobytes() for v in c], "radius": far})

    rows = sorted(sample.groupBy("lang").applyInPandas(cluster, "lang string, k int, centroid binary, radius double").collect(),
                  key=lambda r: (r["lang"], r["k"]))
    languages = sorted({r["lang"] for r in rows})
    model = Model(idf, np.stack([np.frombuffer(r["centroid"], "<f4") for r in rows]), np.array([r["radius"] for r in rows]),
                  np.array([languages.index(r["lang"]) for r in rows]), languages, 1.0)

    def losses(pdf: pd.DataFrame) -> pd.DataFrame:
        best = language_cosines(vectors(list(pdf["text"]), idf), model)
        true = languages.index(pdf["lang"].iloc[0])
        out = []
        for t in TEMPERATURES:
            z = best * t
            z = z - z.max(axis=1, keepdims=True)
            out.append(float((np.log(np.exp(z).sum(axis=1)) - z[:, true]).sum()))
        return pd.DataFrame({"t": TEMPERATURES, "loss": out})

    loss = sample.groupBy("lang").applyInPandas(losses, "t double, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
    model.temperature = min(loss, key=lambda r: (r["loss"], r["t"]))["t"]
    return model


def language_cosines(x: np.ndarray, model: Model) -> np.ndarray:
    """(rows, languages): cosine with the nearest centroid of each language."""
    best = np.full((len(x), len(model.languages)), -1.0, np.float32)
    for a in range(0, len(model.of), BLOCK_CENTROIDS):      # sorted by language
        of = model.of[a:a + BLOCK_CENTROIDS]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        best[:, of[first]] = np.maximum(best[:, of[first]], np.maximum.reduceat(x @ model.centroids[a:a + BLOCK_CENTROIDS].T, first, axis=1))
    return best


def nearest(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, cosine) of the nearest centroid of each row; of equals the first."""
    near, most = np.zeros(len(x), np.int64), np.full(len(x), -2.0, np.float32)
    for a in range(0, len(model.of), BLOCK_CENTROIDS):
        cos = x @ model.centroids[a:a + BLOCK_CENTROIDS].T
        own = np.argmax(cos, axis=1)
        top = cos[np.arange(len(x)), own]
        near, most = np.where(top > most, a + own, near), np.maximum(top, most)
    return near, most


def predict(docs: DataFrame, model: Model | None, reject_as: str | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, distance, rejected).  Rejected texts keep the
    nearest language unless ``reject_as`` names another value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = len(texts)
            known = np.array([model is not None and _LETTER.search(t) is not None for t in texts], bool)
            lang, score = np.full(n, "und", object), np.zeros(n)
            dist, far = np.ones(n), np.ones(n, bool)
            for a, b in blocks(texts) if model is not None else ():
                x = vectors(texts[a:b], model.idf)
                near, most = nearest(x, model)
                top = language_cosines(x, model)
                z = np.exp((top - top.max(axis=1, keepdims=True)) * model.temperature)
                lang[a:b] = np.array(model.languages, object)[model.of[near]]
                score[a:b] = 1 / z.sum(axis=1)
                dist[a:b] = 1 - most
                far[a:b] = dist[a:b] > model.radius[near]
            if reject_as is not None:
                lang[far] = reject_as
            lang[~known], score[~known], dist[~known], far[~known] = "und", 0.0, 1.0, True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(dist), pa.array(far)],
                                             names=["doc_id", "lang_pred", "score", "distance", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, lang_pred string, score double, distance double, rejected boolean")
