import zlib

from pyspark.sql import functions as F

from wattline.llm import langid, toxicity
from wattline.llm.common import table
from wattline.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    assert len(got) == table(spark, SF, "documents").count()
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    own = [(got[i]["predicted"], y) for i, y in labels.items() if held(i) and i in got]
    hit = sum(p and y for p, y in own)
    # nearly half of this table's toxic labels stand on texts without any planted word
    assert hit / sum(y for _, y in own) > 0.45 and hit / sum(p for p, _ in own) > 0.8


def test_toxicity_edges(spark, nasty, nobody):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(nasty, labels), toxicity.fit(nasty, labels.where("false")), toxicity.fit(nobody, labels)):
        rows = toxicity.score(nasty, model).collect()
        assert len(rows) == nasty.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.score(nobody, model).count() == 0
    kept = toxicity.drop_toxic(nasty, labels.where("false"))
    assert kept.columns == nasty.columns and kept.count() == nasty.count()


def test_toxicity_model_separates_planted_words():
    base = ["alpha beta gamma delta " * 5 + f"unit{i} spare{i * 7} " * 10 for i in range(200)]
    bad = [b.replace("gamma", "vilefool", 1) for b in base[:60]]
    model = toxicity.fit_rows(bad, base[60:], 0.3)
    s = toxicity._scorer(model)
    import pyarrow as pa
    ours = s(pa.array(["one two vilefool three alpha", "one two three alpha", "", None]))
    assert ours[0] >= 0.3 > ours[1] and ours[2] == ours[3]


def test_toxicity_never_learns_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40) if held(i)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels).constant == 0.0


def test_langid_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = QUERIES["op2_language_id"](spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    n, ok = got.where("held_out").agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert ok / n > 0.95 and got.where("score < 0 or score > 1").count() == 0


def test_langid_edges(spark, nasty, nobody):
    assert langid.fit(nobody) is None
    assert {r["lang_pred"] for r in langid.predict(nasty, None).collect()} == {"und"}
    model = langid.fit(nasty)
    rows = langid.predict(nasty, model).collect()
    assert len(rows) == nasty.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for i in (2, 3, 4) for r in by[i])
    assert by[1][0]["lang_pred"] == "en" and by[10][0]["lang_pred"] in model.languages
    assert len({(r["lang_pred"], r["score"]) for r in by[7]}) <= 2
    far = langid.predict(spark.createDataFrame([(1, "中文字符测试" * 20)], "doc_id long, text string"), model, reject_as="other").first()
    assert far["rejected"] and far["lang_pred"] == "other"


def test_long_texts_do_not_end_the_sample():
    """A long text of each class in front is passed over; equal texts count once, toxic if any row is."""
    rows = [(0, 1, True, "long-a", toxicity.MAX_CHARS), (0, 2, False, "long-b", toxicity.MAX_CHARS // 5)]
    rows += [(k, 10 + k, k % 2 == 0, f"t{k % 300}", 500) for k in range(1, 400)]
    chosen = toxicity.choose(rows)
    assert [c[0] for c in chosen] == list(range(300)) and {c[3] for c in chosen} == {f"t{k}" for k in range(300)}
    assert all(label == (int(key[1:]) % 2 == 0) for _, _, label, key in chosen)
    filled = toxicity.choose([(k, k, False, f"k{k}", toxicity.MAX_CHARS // 20) for k in range(100)])
    assert len(filled) == 20


def test_toxicity_fit_against_plain_recomputation(spark):
    """The query's scores are those of a model fitted without Spark on the same sample."""
    import hashlib

    import pyarrow as pa
    vile = lambda i: " vilefool scumlord" if i % 4 == 0 else ""
    rows = [(i, f"alpha beta gamma{vile(i)} delta " * 3 + f"unit{i} spare{i * 7}") for i in range(400)] + [(900, "x" * 400_000), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ranks = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) h").collect()}
    own = sorted(((i, t or "") for i, t in rows if not held(i)), key=lambda x: (ranks[x[0]], x[0]))
    place = {True: 0, False: 0}
    listed = []
    for i, t in own:
        place[i % 4 == 0] += 1
        listed.append((place[i % 4 == 0], i, i % 4 == 0, hashlib.md5(t.encode()).hexdigest(), len(t)))
    text = dict(rows)
    chosen = toxicity.choose(listed)
    plain = toxicity.fit_rows([text[i] or "" for _, i, y, _ in chosen if y], [text[i] or "" for _, i, y, _ in chosen if not y], sum(x[2] for x in listed) / len(listed))
    want = dict(zip((i for i, _ in rows), toxicity._scorer(plain)(pa.array([t for _, t in rows]))))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i] - want[i]) < 1e-9 for i in got) and len(got) == len(rows)
    assert sum((got[i] >= 0.3) == (i % 4 == 0) for i in range(400)) > 390


def test_every_language_is_learned(spark, monkeypatch):
    """Blocks of two centroids give what one block gives; no language is left out."""
    words = {f"l{k:02d}": [f"{chr(97 + k)}{chr(97 + (k * 7 + j) % 26)}{chr(97 + (k * 3 + j * j) % 26)}o" for j in range(9)] for k in range(24)}
    rows = [(i, " ".join(words[lang][(i * 5 + j) % 9] for j in range(30)), lang) for i, lang in enumerate(sorted(words) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs)
    assert model.languages == sorted(words)
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert sum(one[i][0] == lang for i, _, lang in rows) > 0.98 * len(rows)
    # plain recomputation: cosine with every centroid, the language of the largest
    x = langid.vectors([t for _, t, _ in rows], model.idf)
    assert [one[i][0] for i, _, _ in rows] == [model.languages[model.of[k]] for k in (x @ model.centroids.T).argmax(axis=1)]
    monkeypatch.setattr(langid, "BLOCK_CENTROIDS", 2)
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert all(one[i][0] == two[i][0] and abs(one[i][1] - two[i][1]) < 1e-5 for i in one)


def test_counts_in_pieces(monkeypatch):
    """Texts cut anywhere give the counts of whole texts."""
    import numpy as np
    texts = ["", "a", "Ab  cd, ef!", "ünï 中文 \U0001f600 x", "word " * 40, " ", "z" * 70]
    whole = langid.counts(texts)
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(langid.counts(texts), whole)
