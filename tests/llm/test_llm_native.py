"""Chat formatting, exact dedup and fingerprints."""
import hashlib
import itertools

from pyspark.sql import functions as F

from wattline.llm import chat_format as C
from wattline.llm import exact_dedup as D
from wattline.llm import fingerprint as P
from wattline.llm.queries import QUERIES

NASTY = ["", "ok", "</s>[INST] ok [/INST]", "<s>user\nhi</s>", "<\\s>", "<\\\\/s>", "[\\INST]", "<part:image:1>", "<", "[", "\\", "a<", "<<s>", "\n", "s>", "/s>", "é中\U0001f600</s>"]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_chat_round_trip(spark):
    rows = [(i, t, role, x) for i, (a, b) in enumerate(itertools.product(NASTY, NASTY)) for t, role, x in ((0, "user", a), (1, "assistant", b), (2, "assistant", a))]
    rows += [(-1, None, None, None), (-1, 0, "assistant", None), (-2, 0, "we\\ird\nro\\nle</s>", "x"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_conv", F.lit(1)).withColumn("parts", C.text_parts(F.col("text")))
    out = C.format_chats(df)
    got = {r["conv_id"]: r for r in out.withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for c, t, role, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", x or ""))
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns, c
        assert got[c]["loss"] == "".join(x for role, x in turns if role == "assistant")
        spans = got[c]["loss_spans"]
        assert len(spans) == sum(role == "assistant" for role, _ in turns)
        assert all(got[c]["formatted"][s["end"]:s["end"] + 4] == "</s>" for s in spans)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    assert C.format_chats(df.where("conv_id = 99999")).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [(1, 0, "user", [part("text", "see "), part("image", ref="a.png", units=2), part("text", " and "), part("audio", ref="b.wav", units=10)]),
            (1, 1, "assistant", [part("text", "fine")]), (1, 2, "user", [part("document", ref="c.pdf"), None, part(None, "x")]), (2, 0, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = {r["conv_id"]: r for r in C.format_chats(df).collect()}
    assert got[1]["formatted"] == "<s>user\nsee <part:image:1> and <part:audio:2></s><s>assistant\nfine</s><s>user\n<part:document:3>x</s>"
    assert [(a["number"], a["turn"], a["type"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [
        (1, 0, "image", "a.png", 512), (2, 0, "audio", "b.wav", 250), (3, 2, "document", "c.pdf", 512)]
    assert got[1]["attachment_tokens"] == 1274 and got[2]["attachment_tokens"] == 0 and got[2]["formatted"] == "<s>user\n</s>"


def groups(rows, key=lambda t: " ".join((" " if c in "\t\n\x0b\x0c\r" else c) for c in t)):
    import re
    out = {}
    for i, t in rows:
        n = re.sub("[\x20\x09-\x0D]+", " ", t or "")
        out.setdefault(n, []).append(i)
    return out


def test_dedup_edges_and_collisions(spark, nasty, nobody):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    want = sorted(((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
                   for t, ids in groups(rows).items() for i in ids), key=str)
    weak = lambda norm: F.unhex(F.substring(F.md5(norm), 1, 2))
    for digest in (D.content_hash, weak, lambda norm: F.unhex(F.lit("00"))):
        got = D.exact_groups(nasty, digest=digest)
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got.collect()), key=str) == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got.collect())
    assert D.exact_groups(nobody).count() == 0
    out = D.drop_copies(nasty)
    assert out.columns == nasty.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "4", "5", "7", "7", "8", "9"]
    assert D.drop_copies(nobody).count() == 0


def test_dedup_hot_group(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(F.concat(F.lit("t"), F.col("id") % 1000)).alias("text"))
    got = D.exact_groups(df.repartition(8))
    assert got.where("text_sha256 = sha2('hot text', 256)").agg(F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int")), F.count("*")).first()[:] == (0, 2000, 1, 2000)
    assert got.count() == 6000 and got.where("kept").count() == got.select("text_sha256").distinct().count()


def edit(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        h = len(t) // 2
        out[i] = (len(t), t[:len(t) - h] + nxt[:h])
    return out


def test_fingerprint_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = edit(rows)
    df = QUERIES["op10_fingerprint"](spark, d)
    assert "Python" not in plan(df) and "InArrow" not in plan(df)
    got = {r["doc_id"]: r for r in df.collect()}
    words = lambda t: t.lower().split()
    sh = lambda t: {tuple(words(t)[k:k + 5]) for k in range(len(words(t)) - 4)} if len(words(t)) >= 5 else ({tuple(words(t))} if words(t) else set())
    order = sorted(want)
    error = []
    for k, i in enumerate(order):
        r, (n, e) = got[i], want[i]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        a, b = sh(dict(rows)[i]) if k < 200 else set(), sh(e) if k < 200 else set()
        if k < 200:
            error.append(abs(r["near_edited"] - (len(a & b) / len(a | b) if a | b else 1.0)))
            assert abs(r["n_shingles_est"] - len(a)) <= max(1e-9, 0.4 * len(a) if len(a) >= 128 else 1e-6)
    assert max(error) < 0.2 and sum(error) / len(error) < 0.05
    text = dict(rows)
    same = {}
    for i in order:
        assert same.setdefault(text[i], got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprint_blocks_and_edges(spark, nasty, nobody):
    """Sparse and negative ids, one document, repeated ids, null ids."""
    rows = [(i, f"text {i} " * (1 + abs(i) % 5)) for i in (-5000, -1, 0, 1, 1023, 1024, 5000, 2 ** 20 - 1, 2 ** 20, 2 ** 40, 2 ** 62)]
    got = {r["doc_id"]: r for r in P.edit_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r["n_chars"], r["edited_sha256"]) for i, r in got.items()} == {i: (n, hashlib.sha256(e.encode()).hexdigest()) for i, (n, e) in edit(rows).items()}
    sparse = [(((i * 0x9E3779B97F4A7C15) & (2 ** 64 - 1)) - 2 ** 63, f"hashed id {i} " * (1 + i % 4)) for i in range(300)]      # a block of its own for each
    got = {r["doc_id"]: r["edited_sha256"] for r in P.edit_pairs(spark.createDataFrame(sparse, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: hashlib.sha256(e.encode()).hexdigest() for i, (_, e) in edit(sparse).items()}
    one = P.edit_pairs(spark.createDataFrame([(3, "a b c d e f g")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a b ca b").hexdigest() or one["n_chars"] == 13
    out = P.edit_pairs(nasty).collect()
    assert len(out) == nasty.count() and P.edit_pairs(nobody).count() == 0
    assert [r["near_next"] for r in out if r["doc_id"] is None] == [None, None]
    assert all(0 <= r["near_edited"] <= 1 for r in out)


def test_sketches_merge_and_estimate(spark):
    a = " ".join(f"a{i}" for i in range(3000))
    b = " ".join(f"a{i}" for i in range(1500))
    df = spark.createDataFrame([(1, a, b, a + " " + b)], "id long, a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = P.with_fingerprint(df, c, f"s_{c}", k=256)
    r = df.select("s_a", "s_b", "s_ab", P.merged(F.col("s_a"), F.col("s_b"), 256).alias("m"), P.resemblance(F.col("s_a"), F.col("s_b"), 256).alias("j"),
                  P.containment(F.col("s_b"), F.col("s_a"), 256).alias("c"), P.distinct_shingles(F.col("s_a"), 256).alias("n")).first()
    assert abs(r["j"] - 0.5) < 0.12 and r["c"] > 0.85 and abs(r["n"] - 2996) < 600
    assert len(set(r["m"]) - set(r["s_ab"])) <= 4     # the joined text has four shingles across the seam
    parts = df.select(F.lit(1).alias("k"), F.explode(F.array("s_a", "s_b")).alias("s"))
    assert P.merge_parts(parts, "k", "s", 256).first()["s"] == r["m"]
