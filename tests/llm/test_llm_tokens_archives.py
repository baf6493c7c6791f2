"""Subword encoding, packing, web archives and the pipeline."""
import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wattline.llm import packing as K
from wattline.llm import subword as S
from wattline.llm import warc as W
from wattline.llm.common import table, tokenizer_path
from wattline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return S.load(tokenizer_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def test_ids_equal_the_merges(vocabulary, reference):
    r = random.Random(8)
    chars = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 9, 10, 13, 0, 0x2581, 0x4E2D, 0x1F600, 0x3042, 0x430, 0x5D0]]
    pieces = vocabulary.pieces[259:]
    texts = ["", " ", "a" * 3000, "ab" * 700, "x" + " " * 50 + "y", "\n\n \n  z "]
    texts += ["".join(r.choice(chars) for _ in range(r.randint(0, 80))) for _ in range(600)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))).replace(S.SPACE, r.choice((" ", "", S.SPACE))) for _ in range(1500)]
    texts += [" " * n + "w" + " " * n for n in range(70)]
    ids, n = S.Encoder(vocabulary).encode(texts)
    cut = np.concatenate(([0], np.cumsum(n)))
    decoder = S.Decoder(vocabulary)
    for t, a, b in zip(texts, cut[:-1], cut[1:]):
        assert ids[a:b].tolist() == reference.encode(t), t
        assert decoder.decode(ids[a:b]) == t.replace(S.SPACE, " ")


def test_unigram_scores_against_plain_dynamic_programming(vocabulary):
    """Same recurrence with sums of scores, as a unigram model has them."""
    r = random.Random(2)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", S.SPACE, S.SPACE + "a", S.SPACE + "ab"]
    index = {p: i for i, p in enumerate(pieces)}
    scores = np.array([-2.0 - r.random() * 5 for _ in pieces])
    v = S.Vocabulary(pieces, scores, {}, 99, False, index)
    v.chars = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
    v.max_piece = 3
    char = {chr(c): i + 1 for i, c in enumerate(v.chars)}
    keys = []
    for p, i in index.items():
        h = 0
        for c in p:
            h = (h * int(S._BASE) + char[c]) & (2 ** 64 - 1)
        keys.append((h, i, len(p)))
    keys.sort()
    v.keys, v.key_id, v.key_len = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.int32), np.array([k[2] for k in keys], np.int32)
    v.key_slots = S._slots(v.keys)
    words = sorted({S.SPACE + "".join(r.choice("abc") for _ in range(7)) for _ in range(80)})
    ids, n = S.viterbi(v, words)
    cut = np.concatenate(([0], np.cumsum(n)))
    for w, a, b in zip(words, cut[:-1], cut[1:]):
        best = [0.0] + [-1e9] * len(w)
        for e in range(1, len(w) + 1):
            best[e] = max(best[e - len(p)] + scores[i] for p, i in index.items() if w[:e].endswith(p))
        assert "".join(pieces[i] for i in ids[a:b]) == w and abs(scores[ids[a:b]].sum() - best[-1]) < 1e-9
        assert abs(scores[S.one_word(v, w, {})].sum() - best[-1]) < 1e-9


def test_subword_edges(spark, nasty, nobody, vocabulary, reference):
    rows = S.decode(S.encode(nasty, vocabulary, keep=("text",)), vocabulary, "back").collect()
    assert len(rows) == nasty.count() and S.encode(nobody, vocabulary).count() == 0
    for r in rows:
        assert r["ids"] == reference.encode(r["text"] or "") and r["back"] == (r["text"] or "")
    assert QUERIES["op6_sentencepiece"](spark, SF).where("not round_trip").count() == 0


def held_up(plan, hist, max_len):
    """Every piece placed once, sequences without gaps and not too long."""
    done, segments = np.zeros(max_len + 1, int), {}
    for length, rank, count, base, offset, each in plan.runs:
        assert rank == done[length]
        done[length] += count * each
        for k in range(count * each):
            segments.setdefault(base + k % count, []).append((offset + k // count * length, length))
    assert (done[1:] == hist[1:]).all() and len(segments) == plan.sequences
    for parts in segments.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= max_len


@pytest.mark.parametrize("size", [0, 1, 40, 3000])
def test_packing_plan(size):
    r = np.random.default_rng(size)
    for max_len in (8, 64, 1024):
        lengths = np.minimum(max_len, r.integers(1, max_len + 1, size)) if size % 2 == 0 else np.full(size, max_len)
        hist = np.bincount(lengths, minlength=max_len + 1)
        plan = K.plan_packing(hist, max_len)
        held_up(plan, hist, max_len)
        least = -(-int(lengths.sum()) // max_len)
        if size == 3000:
            assert plan.sequences <= 1.03 * least + 2
            mixed = K.Plan(hist, max_len)
            mixed.by_patterns(K.patterns(max_len))
            assert mixed.sequences > 0.2 * least      # the fitted patterns hold much of it
            assert plan.sequences >= mixed.sequences and len(plan.runs) > len(mixed.runs)


def test_packing_optimal_on_small_cases():
    r = random.Random(3)
    for _ in range(60):
        lengths = sorted((r.randint(1, 8) for _ in range(r.randint(1, 7))), reverse=True)

        def least(rest, bins):
            if not rest:
                return len(bins)
            best = least(rest[1:], [*bins, 8 - rest[0]])
            for i, room in enumerate(bins):
                if room >= rest[0]:
                    best = min(best, least(rest[1:], [*bins[:i], room - rest[0], *bins[i + 1:]]))
            return best

        plan = K.plan_packing(np.bincount(lengths, minlength=9), 8)
        assert plan.sequences <= least(lengths, []) + 1


def test_tokens_equal_the_library():
    bpe, lib = K.ByteBpe(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert bpe.fast is not None
    r = random.Random(6)
    chars = [chr(c) for c in [*range(0, 0x250), 0x4E2D, 0x1F600, 0x85, 0x2028, 0x3000, 0x10FFFF]]
    for t in ["", "<|endoftext|>", "a<|endoftext|>b", " " * 3000, "x" * 3000] + ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(3000)]:
        assert bpe.encode(t) == lib.encode(t, add_special_tokens=False).ids


def check_packed(rows, texts, max_len=1024):
    """texts: list of (doc_id, text), ids unique."""
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % max_len or max_len
        cuts = [0, *range(first, len(ids), max_len), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    seq = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= max_len
    assert len(seq) <= 1.05 * sum(r["length"] for r in rows) / max_len + 2


def test_packing_query(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    check_packed(QUERIES["op8_best_fit_packing"](spark, SF).collect(), texts)


def test_packing_edges(spark, nasty, nobody):
    path = tokenizer_path("byte_bpe_50k.json")
    out = K.pack(nasty, path, with_ids=True)
    rows = out.collect()
    assert sum(r["piece"] == 0 for r in rows) == nasty.count() and K.pack(nobody, path).count() == 0
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    seqs = K.packed_sequences(out).collect()
    assert sum(len(r["ids"]) for r in seqs) == sum(r["length"] for r in rows) and max(len(r["ids"]) for r in seqs) <= 1024


def test_archive_against_brute_force(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b\r\nc", "x"), (3, None, None), (4, "u", ""), (5, "http://é", "é中\r\n\r\nWARC/1.1\r\n"),
                                   (None, "n", "x"), (6, "l", "y" * 3_000_000), (7, "l", "z"), (7, "l", "z"), (7, "m", "other")], "page_id long, url string, html string")
    pages = pages.withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(1)).withColumn("keep", F.lit(1))
    for least, back in ((0, {1: 2, None: 2, 3: 4}), (1, {1: 2, None: 2})):
        folder, index = W.write_archive(pages, min_revisit_bytes=least)
        rows = W.read_archive(folder, index).collect()
        assert len(rows) == 10 == index.count() and all(r["digest_ok"] for r in rows if r["record_type"] == "response")
        own = {(r["page_id"], r["payload_digest"]): r for r in rows}
        for p in pages.collect():
            raw = (p["html"] or "").encode()
            r = own[p["page_id"], base64.b32encode(hashlib.sha1(raw).digest()).decode()]
            assert r["payload_bytes"] == len(raw)
            want = back.get(p["page_id"])
            assert (r["record_type"], r["refers_to"]) == (("revisit", want) if want else ("response", None))
            assert r["payload"] is None if want else bytes(r["payload"]) == raw
        some = W.read_records(folder, index.where("page_id in (5, 6)")).collect()
        assert {r["page_id"]: bytes(r["payload"]) for r in some} == {5: "é中\r\n\r\nWARC/1.1\r\n".encode(), 6: b"y" * 3_000_000}
    folder, index = W.write_archive(pages.where("page_id = 99"))
    assert index.count() == 0 and W.read_archive(folder, index).count() == 0


def test_bundles_are_plain_zstandard(spark):
    """Any Zstandard reader reads the records; the seek table is skipped."""
    import io
    import os

    import zstandard
    folder, index = W.write_archive(table(spark, SF, "pages"))
    names = [r["bundle"] for r in index.select("bundle").distinct().collect()]
    root = folder.removeprefix("file://").removeprefix("file:")
    data = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(os.path.join(root, n), "rb").read()), read_across_frames=True).read() for n in names)
    assert data.count(b"WARC/1.1\r\n") >= index.count()


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before kept."""
    from tests.llm.test_llm_ngram_join import brute
    from wattline.llm import ngram_join, secret_scan
    docs = table(spark, SF, "documents")
    import re
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.save(stage(spark, docs, SF), "t")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == table(spark, SF, "documents").columns
        if name == "toxicity":
            assert {r["doc_id"] for r in after} < set(before) and len(after) > 0.7 * len(before)
        elif name == "exact_dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0D]+", " ", before[i]["text"] or ""), i)
            assert sorted(r["doc_id"] for r in after) == sorted(first.values())
        elif name == "ngram_join":
            rows = [(i, r["text"]) for i, r in before.items()]
            _, comp, _ = brute(rows, ngram_join.Rule(words=5, percent=80))
            low = {}
            for (i, _), c in zip(rows, comp):
                low[c] = min(low.get(c, i), i)
            assert sorted(r["doc_id"] for r in after) == sorted(low.values())
        elif name == "secret_scan":
            assert {r["doc_id"] for r in after} == set(before)
            for r in after:
                assert not secret_scan.rule_spans(r["text"] or "") and r["n_chars"] == len(r["text"])
                assert secret_scan.rule_spans(before[r["doc_id"]]["text"] or "") or secret_scan.REPLACEMENT in r["text"] or r["text"] == before[r["doc_id"]]["text"]
        else:
            check_packed(after, [(i, r["text"]) for i, r in before.items()])
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_pipeline_on_nasty_and_empty_tables(spark, nasty, nobody, tmp_path):
    """Null, empty and very long texts, repeated ids, clashing columns."""
    labels = f"{tmp_path}/labels.parquet"
    spark.createDataFrame([(1, 0), (5, None)], "doc_id long, toxic int").write.parquet(labels)
    for name, docs in (("nasty", nasty), ("nobody", nobody)):
        kept = docs
        for stage, run in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.save(run(spark, kept, str(tmp_path)), f"{name}-{stage}")
            assert kept.columns == docs.columns
        rows = kept.select("doc_id", "text").collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).collect()
        if name == "nobody":
            assert not rows and not packed
            continue
        # equal texts: (1, null id, 6) by white space, nulls and empties; "Aa bb" of 7, 7, 10
        texts = sorted(r["text"] or "" for r in rows)
        assert len(texts) == len(set(texts)) and {r["doc_id"] for r in rows} >= {1, 5, 7, 8, 9}
        assert sum(r["doc_id"] == 7 for r in rows) == 2 and not any("password=" in t for t in texts)
        single = [r for r in rows if r["doc_id"] != 7]      # two documents have that id
        check_ids = {r["doc_id"] for r in single}
        assert sorted((p["doc_id"] is None, p["doc_id"] or 0) for p in packed if p["piece"] == 0 and p["doc_id"] in check_ids) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in single)
        assert all(p["length"] == len(p["ids"]) <= 1024 and zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in packed)
