"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

Texts are cut at spaces and newlines (no piece crosses them); words not seen
before in the task are grouped by length and all words of a length advance
together.  At each end position the substrings of up to ``MAX_PIECE``
characters are hashed, the hashes probe the sorted keys of the pieces, and the
best admissible piece is stored with a backpointer.

Unigram models: the best piece has the largest sum of scores.  Merge (BPE)
models: a piece may follow another only if merging would leave the pair as it
is.  A sequence whose neighbours all pass is the merge result, and each prefix
has just one, so the maximum runs over admissible pieces and the ids equal
those of the merges.

Characters without a piece become byte pieces.  Runs of spaces, whose pieces
share one score, go by a table of run lengths.

Defined results: null and empty texts have no ids; U+2581 is read as a space,
as the model does; a character without piece or byte pieces is the unknown
id; rows repeated under one id are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import map_arrow

SPACE = "▁"
_UNIT = re.compile(r" ?[^ \n]+| |\n")
_BASE = np.uint64(0x9E3779B97F4A7C15)
LONG_WORD = 64            # longer words advance alone, by the same recurrence
CACHE_WORDS = 300_000     # words that a task remembers
SLOT_BITS = 20
NONE = np.int32(-1)       # no piece before
UNKNOWN = np.int32(-2)    # a character without a piece


@dataclass
class Vocabulary:
    """Pieces of a model and the tables of the recurrence."""
    pieces: list[str]                      # by id
    scores: np.ndarray
    bytes_: dict[int, int]                 # byte -> id
    unknown: int
    merges: bool
    index: dict[str, int] = field(default_factory=dict)        # pieces of the recurrence
    runs: dict[int, list[int]] = field(default_factory=dict)   # number of spaces -> ids
    chars: np.ndarray = None               # sorted code points with a piece
    keys: np.ndarray = None                # sorted hashes of the pieces
    key_id: np.ndarray = None
    key_len: np.ndarray = None
    max_piece: int = 1
    rank: np.ndarray = None                # merges: order of the merge that makes a piece, -1 for characters
    left: np.ndarray = None
    right: np.ndarray = None
    pair_keys: np.ndarray = None           # merges: sorted left * 2**32 + right
    pair_rank: np.ndarray = None
    key_slots: np.ndarray = None           # hashed membership of keys and pair_keys: most probes end here
    pair_slots: np.ndarray = None


def _slot(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) * _BASE) >> np.uint64(64 - SLOT_BITS)


def _slots(keys: np.ndarray) -> np.ndarray:
    t = np.zeros(1 << SLOT_BITS, bool)
    t[_slot(keys)] = True
    return t


def merge_steps(text: str, index: dict[str, int], scores: np.ndarray) -> tuple[list[str], tuple[str, str] | None]:
    """Plain merging (best score first, then leftmost): parts, and the last merge."""
    sym, nxt, prv = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(sym) and (p := sym[i] + sym[j]) in index:
            heapq.heappush(heap, (-float(scores[index[p]]), i, j, p))

    for i in range(len(sym) - 1):
        offer(i)
    last = None
    while heap:
        _, i, j, p = heapq.heappop(heap)
        if sym[i] and nxt[i] == j and sym[j] and sym[i] + sym[j] == p:
            last = (sym[i], sym[j])
            sym[i], sym[j] = p, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
    return [s for s in sym if s], last


def load(path: str) -> Vocabulary:
    """Tables of a SentencePiece model file (read once, on the driver)."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    pieces = [m.id_to_piece(i) for i in range(n)]
    scores = np.array([m.get_score(i) for i in range(n)])
    plain = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_unused(i) or m.is_byte(i))]
    byte = {int(pieces[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
    every = {pieces[i]: i for i in plain}
    # merge models score a piece by its place in the list of merges
    long = [i for i in plain if len(pieces[i]) > 1 and pieces[i].strip(SPACE)]
    merges = all(scores[i] == round(scores[i]) for i in long) and len({scores[i] for i in long}) == len(long)
    v = Vocabulary(pieces, scores, byte, m.unk_id(), merges)
    _space_runs(v, every)
    v.index = {p: i for p, i in every.items() if p.strip(SPACE) or len(p) == 1}
    if any(SPACE in p[1:] or "\n" in p for p in v.index):
        raise ValueError("a piece crosses spaces or lines; texts can't be cut there")
    if merges:
        _merge_tables(v)
    v.chars = np.array(sorted(ord(p) for p in v.index if len(p) == 1), np.uint32)
    v.max_piece = max(map(len, v.index))
    char = {chr(c): i + 1 for i, c in enumerate(v.chars)}
    rows = []
    for p, i in v.index.items():
        if all(c in char for c in p):
            h = 0
            for c in p:
                h = (h * int(_BASE) + char[c]) & 0xFFFFFFFFFFFFFFFF
            rows.append((h, i, len(p)))
    rows.sort()
    v.keys = np.array([r[0] for r in rows], np.uint64)
    v.key_id = np.array([r[1] for r in rows], np.int32)
    v.key_len = np.array([r[2] for r in rows], np.int32)
    v.key_slots = _slots(v.keys)
    if len(np.unique(v.keys)) != len(v.keys):
        raise ValueError("two pieces share a hash")
    return v


def _space_runs(v: Vocabulary, every: dict[str, int]) -> None:
    """Ids of runs of spaces below twice the longest run piece."""
    only = {p: i for p, i in every.items() if not p.strip(SPACE)}
    top = max(map(len, only), default=0)
    for n in range(1, 2 * top + 1):
        if v.merges:
            parts = merge_steps(SPACE * n, only, v.scores)[0]
        else:
            best = [(0.0, [])] + [None] * n
            for e in range(1, n + 1):
                best[e] = max(((best[e - len(p)][0] + v.scores[i], best[e - len(p)][1] + [p]) for p, i in only.items() if len(p) <= e), key=lambda x: x[0])
            parts = best[n][1]
        v.runs[n] = [only[p] for p in parts]
    v.runs[0] = []


def run_ids(v: Vocabulary, n: int) -> list[int]:
    top = len(v.runs) // 2
    if n < len(v.runs):
        return v.runs[n]
    whole = (n - top) // top
    return v.runs[top] * whole + v.runs[n - whole * top]


def _merge_tables(v: Vocabulary) -> None:
    n = len(v.pieces)
    v.rank, v.left, v.right = np.full(n, -1, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    good = {}
    for p, i in sorted(v.index.items(), key=lambda x: len(x[0])):
        if len(p) == 1:
            good[p] = i
            continue
        parts, last = merge_steps(p, v.index, v.scores)
        if parts == [p]:
            good[p] = i
            v.left[i], v.right[i] = v.index[last[0]], v.index[last[1]]
    v.index = good      # pieces that merging can make
    order = sorted((i for p, i in good.items() if len(p) > 1), key=lambda i: -v.scores[i])
    v.rank[order] = np.arange(len(order))
    pairs = {}
    for p, i in good.items():
        for k in range(1, len(p)):
            a, b = good.get(p[:k]), good.get(p[k:])
            if a is not None and b is not None:
                pairs[(a << 32) | b] = v.rank[i]
    v.pair_keys = np.array(sorted(pairs), np.int64)
    v.pair_rank = np.array([pairs[k] for k in v.pair_keys.tolist()], np.int64)
    v.pair_slots = _slots(v.pair_keys)


def stays_apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For merges: whether pieces a, b next to each other stay as they are.
    Undoes the later of the two last merges, step by step, and looks whether
    the pieces that then touch would have merged before it."""
    out = np.ones(len(a), bool)
    live = np.flatnonzero((a >= 0) & (b >= 0))
    a, b = a[live].astype(np.int64), b[live].astype(np.int64)
    limit = np.full(len(live), np.iinfo(np.int64).max)
    while len(live):
        key = (a << 32) | b
        joins = v.pair_slots[_slot(key)]
        maybe = np.flatnonzero(joins)
        at = np.minimum(np.searchsorted(v.pair_keys, key[maybe]), len(v.pair_keys) - 1)
        joins[maybe] = (v.pair_keys[at] == key[maybe]) & (v.pair_rank[at] < limit[maybe])
        out[live[joins]] = False
        ra, rb = v.rank[a], v.rank[b]
        go = ~joins & ((ra >= 0) | (rb >= 0))
        live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
        first = ra > rb
        # the left merge of equal rank comes first
        limit = np.where(first, ra, rb + 1)
        a, b = np.where(first, v.right[a], a), np.where(first, b, v.left[b])
    return out


def _probe(v: Vocabulary, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, ids) of the hashes that are pieces of this length."""
    maybe = np.flatnonzero(v.key_slots[_slot(h)])
    own = h[maybe]
    at = np.minimum(np.searchsorted(v.keys, own), len(v.keys) - 1)
    ok = (v.keys[at] == own) & (v.key_len[at] == length)
    return maybe[ok], v.key_id[at[ok]]


def viterbi(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words of one length, all advancing together: (ids of all words
    in order, number of ids of each)."""
    n, size = len(words), len(words[0])
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T
    at = np.minimum(np.searchsorted(v.chars, cp), len(v.chars) - 1)
    known = v.chars[at] == cp
    sym = np.where(known, at + 1, 1 << 40).astype(np.uint64)
    prefix = np.zeros((size + 1, n), np.uint64)
    for p in range(size):
        prefix[p + 1] = prefix[p] * _BASE + sym[p]
    power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(v.max_piece + 1)]
    last = np.full((size + 1, n), NONE)
    back = np.zeros((size + 1, n), np.int16)
    best = np.zeros((size + 1, n)) if not v.merges else None
    low = float(v.scores.min()) - 10.0
    for p in range(1, size + 1):
        last[p] = np.where(known[p - 1], NONE, UNKNOWN)
        back[p] = 1
        if v.merges:
            open_ = np.flatnonzero(known[p - 1])
            for k in range(min(v.max_piece, p), 0, -1):
                if not len(open_):
                    break
                hit, ids = _probe(v, prefix[p][open_] - prefix[p - k][open_] * power[k], k)
                if not len(hit):
                    continue
                rows = open_[hit]
                ok = stays_apart(v, last[p - k][rows], ids)
                last[p][rows[ok]], back[p][rows[ok]] = ids[ok], k
                done = np.zeros(len(open_), bool)
                done[hit[ok]] = True
                open_ = open_[~done]
        else:
            best[p] = best[p - 1] + low
            last[p] = UNKNOWN
            for k in range(1, min(v.max_piece, p) + 1):
                rows, ids = _probe(v, prefix[p] - prefix[p - k] * power[k], k)
                total = best[p - k][rows] + v.scores[ids]
                better = total > best[p][rows]
                rows = rows[better]
                best[p][rows], last[p][rows], back[p][rows] = total[better], ids[better], k
    return _trace(v, words, last, back)


def _trace(v: Vocabulary, words: list[str], last: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Follow the backpointers of all words at once, from their ends."""
    size, n = last.shape[0] - 1, last.shape[1]
    pos, rows, steps = np.full(n, size), np.arange(n), []
    while len(rows):
        steps.append((rows, pos, last[pos, rows]))
        pos = pos - back[pos, rows]
        rows, pos = rows[pos > 0], pos[pos > 0]
    row, end, ids = (np.concatenate([s[k] for s in steps]) for k in range(3))
    order = np.argsort(row * (size + 1) + end, kind="stable")
    row, end, ids = row[order], end[order], ids[order]
    lost = np.flatnonzero(ids < 0)
    if len(lost):     # characters without a piece become several ids
        own = [_fallback(v, words[r][e - 1]) for r, e in zip(row[lost].tolist(), end[lost].tolist())]
        times = np.ones(len(ids), np.int64)
        times[lost] = [len(x) for x in own]
        row = np.repeat(row, times)
        at = np.flatnonzero(np.repeat(ids < 0, times))
        ids = np.repeat(ids, times)
        ids[at] = [t for x in own for t in x]
    return ids.astype(np.int32), np.bincount(row, minlength=n)


def _fallback(v: Vocabulary, char: str) -> list[int]:
    raw = char.encode("utf-8", "surrogatepass")
    return [v.bytes_[b] for b in raw] if all(b in v.bytes_ for b in raw) else [v.unknown]


def one_word(v: Vocabulary, word: str, memo: dict) -> np.ndarray:
    """The same recurrence for a single, long word."""
    last, back, best = [-1], [0], [0.0]
    low = float(v.scores.min()) - 10.0
    for p in range(1, len(word) + 1):
        if v.merges:
            got = (UNKNOWN, 1)
            for k in range(min(v.max_piece, p), 0, -1):
                t = v.index.get(word[p - k:p])
                if t is not None:
                    key = (last[p - k], t)
                    if key not in memo:
                        memo[key] = bool(stays_apart(v, np.array([key[0]]), np.array([t]))[0])
                    if memo[key]:
                        got = (t, k)
                        break
        else:
            top, got = best[p - 1] + low, (UNKNOWN, 1)
            for k in range(1, min(v.max_piece, p) + 1):
                t = v.index.get(word[p - k:p])
                if t is not None and best[p - k] + v.scores[t] > top:
                    top, got = best[p - k] + v.scores[t], (t, k)
            best.append(top)
        last.append(int(got[0]))
        back.append(got[1])
    out, p = [], len(word)
    while p:
        out.append([last[p]] if last[p] >= 0 else _fallback(v, word[p - 1]))
        p -= back[p]
    return np.array([t for part in reversed(out) for t in part], np.int32)


class Encoder:
    """Texts to ids; remembers words within a task.  A word has a number; its
    ids lie in one flat array."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo = vocabulary, {}
        self.space = vocabulary.index.get(SPACE, -1)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)

    def learn(self, words: set[str]) -> None:
        if len(self.number) + len(words) > CACHE_WORDS:
            self.forget()
        groups: dict[int, list[str]] = {}
        for w in words:
            if w not in self.number:
                groups.setdefault(len(w), []).append(w)
        flat, size = [self.flat], [self.size]
        for length, own in groups.items():
            plain = [w.replace(" ", SPACE) for w in own]
            if length > LONG_WORD:
                if len(self.memo) > 1 << 20:
                    self.memo.clear()
                ids = [one_word(self.v, w, self.memo) for w in plain]
                flat += ids
                size.append(np.array([len(x) for x in ids], np.int64))
            else:
                for a in range(0, len(plain), 50_000):
                    ids, n = viterbi(self.v, plain[a:a + 50_000])
                    flat.append(ids)
                    size.append(n)
            self.number.update(zip(own, range(len(self.number), len(self.number) + len(own))))
        self.flat, self.size = np.concatenate(flat), np.concatenate(size)
        self.start = np.cumsum(self.size) - self.size

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in order, and how many each has."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[numbers] - (ends - size), size)], size

    def with_runs(self, parts: list[str]) -> np.ndarray:
        """A text with runs of spaces: a space that stays alone joins the run before it."""
        out, run = [], 0
        for u in parts:
            if u == " ":
                run += 1
                continue
            k = self.number[u]
            own = self.flat[self.start[k]:self.start[k] + self.size[k]]
            if run:
                if u[0] == " " and own[0] == self.space:
                    run, own = run + 1, own[1:]
                out.append(run_ids(self.v, run))
                run = 0
            out.append(own)
        out.append(run_ids(self.v, run))
        return np.concatenate([np.asarray(x, np.int32) for x in out])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each)."""
        texts = [t.replace(SPACE, " ") for t in texts]
        units = [_UNIT.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*units) if units else set())
        loose = ["  " in t or t[:1] == " " or t[-1:] == " " for t in texts]
        plain = [[] if x else u for x, u in zip(loose, units)]
        count = np.array([len(u) for u in plain])
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(plain)), np.int64, int(count.sum()))
        ids, size = self.gather(numbers)
        n = np.bincount(np.repeat(np.arange(len(texts)), count), size, len(texts)).astype(np.int64)
        if not any(loose):
            return ids, n
        cut = np.concatenate(([0], np.cumsum(n)))
        parts = [self.with_runs(u) if x else ids[a:b] for x, u, a, b in zip(loose, units, cut[:-1], cut[1:])]
        return np.concatenate(parts), np.array([len(x) for x in parts])


class Decoder:
    """Ids to texts: a gather over the bytes of all pieces."""

    def __init__(self, v: Vocabulary):
        byte = {i: bytes([b]) for b, i in v.bytes_.items()}
        raw = [byte[i] if i in byte else p.replace(SPACE, " ").encode() for i, p in enumerate(v.pieces)]
        raw[v.unknown] = " ⁇ ".encode()
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        size = self.size[ids]
        at = np.arange(size.sum()) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        text = self.bytes[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ids), and the columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**shared.value))
        for batch in batches:
            texts = batch.column("_text")
            for a, b in _pieces(texts):
                ids, n = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
                ends = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
                rest = [batch.column(c).slice(a, b - a) for c in (id_col, *keep)]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, pa.array(ids))], names=[id_col, *keep, "ids"])

    rows = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", ids array<int>")


def _pieces(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges with about ``most`` bytes of text, at least one row each."""
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def decode(coded: DataFrame, vocabulary: Vocabulary, out: str = "text") -> DataFrame:
    """Adds the text of ``ids`` (null ids are none)."""
    shared = coded.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(**shared.value))
        for batch in batches:
            ids = batch.column("ids")
            flat, off = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                texts = [decoder.decode(flat[s:e]) for s, e in zip(off[a:a + part.num_rows], off[a + 1:a + 1 + part.num_rows])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    rows = coded.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return map_arrow(rows, run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + f", `{out}` string")
