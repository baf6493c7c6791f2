"""Model-side properties: additivity, surrogate recovery, code metrics."""

import os
import tempfile

from pyspark.sql import functions as F

from wattline.models import codemetrics as CM
from wattline.models import explain as X
from wattline.sources.files import read_code_bundle

FEATS = ["a", "b", "c"]


def _frame(spark, n, offset=0):
    return spark.createDataFrame([(i + offset, float(i % 5), float((i * 3) % 7), float((i * 5) % 11)) for i in range(n)],
                                 "row_id long, a double, b double, c double")


def test_code_metrics_from_bundle_files(spark):
    root = tempfile.mkdtemp(prefix="wattline-bundles-")
    os.makedirs(f"{root}/b1")
    with open(f"{root}/b1/handler.py", "w") as f:
        f.write("# comment\nimport json\n\ndef handler(e, c):\n    for x in range(3):\n"
                "        if x and e:\n            print(x)\n    while False:\n        pass\n"
                "    return json.dumps(e)\n")
    with open(f"{root}/b1/broken.py", "w") as f:
        f.write("def (:\n  x = 1\n")
    files = CM.source_metrics(read_code_bundle(spark, root))
    rows = {os.path.basename(r.path): r for r in files.collect()}
    h = rows["handler.py"]
    assert (h.loc, h.num_loops, h.num_conditionals, h.max_nesting_depth) == (8, 2, 1, 2)
    assert h.num_function_calls == 3 and h.parsed
    assert not rows["broken.py"].parsed and rows["broken.py"].loc == 2
    b = CM.bundle_metrics(files).first()
    assert b.bundle == "b1" and b.lines_of_code == 10 and b.cyclomatic_complexity == 5.0


def test_discretised_lime_finds_the_step(spark):
    """The prediction depends on whether a is in its lower half."""
    train = _frame(spark, 400)
    bins = X.quartile_bins(train, FEATS)
    step = lambda df: df.withColumn("prediction", F.when(F.col("a") <= 2.0, 5.0).otherwise(1.0) + 0.0 * F.col("b"))
    w = X.lime_discretised(_frame(spark, 2), bins, FEATS, step, n_samples=600)
    got = {(r.row_id, r.feature): r.lime_weight for r in w.collect()}
    for i in (0, 1):      # a = 0 and 1: both in the lower half
        assert got[(i, "a")] > 0.8 and abs(got[(i, "b")]) < 0.4 and abs(got[(i, "c")]) < 0.4


def test_forest_ignores_constant_columns_and_network_stops_early(spark):
    from wattline.models import trees as TR
    from wattline.models.forest import Settings, fit_forests
    from wattline.models.mlp import DistributedMLP
    df = _frame(spark, 300).withColumn("k", F.lit(1.0)).withColumn("energy_target_wh", F.col("a") + 2 * F.col("b")).withColumn("is_validation", F.col("row_id") % 5 == 0)
    gbt = TR.fit(df, features=["a", "k", "b"], max_iter=5, max_depth=4)
    imp = {r.feature: r.importance for r in TR.importances(spark, gbt, ["a", "k", "b"]).collect()}
    assert imp["k"] == 0.0 and imp["b"] > imp["a"] > 0
    assert fit_forests(df, ["a", "k", "b"], "energy_target_wh", Settings(trees=3, depth=4), F.col("row_id"))[0].used == ["a", "b"]
    net = DistributedMLP(["a", "b", "k"], "energy_target_wh", hidden=(16,), epochs=60, batch=16, lr=0.01, patience=5).fit(df)
    assert net.history[-1] < 0.05 and len(net.history) <= 61
    assert net.transform(df).selectExpr("max(abs(prediction - energy_target_wh)) e").first().e < 1.5
    import numpy as np
    rows = net.transform(df, floor=None).select("a", "b", "k", "prediction").collect()
    assert np.allclose(net.predictor()(np.array([r[:3] for r in rows])), [r[3] for r in rows])


def test_gap_report_hand_rows(spark):
    """p = 0 stays, p < 0 takes the floor after the range check, range 0 has a buffer of 1."""
    from wattline.config import RANGE_CHECK_FEATURES
    from wattline.operators.gap import gap_report
    train = spark.createDataFrame([[100.0] + [5.0] * 11, [200.0] + [5.0] * 11], ", ".join(f"{c} double" for c in RANGE_CHECK_FEATURES))
    inputs = spark.createDataFrame([(n, *[150.0] + [v] * 11) for n, v in (("zero", 5.0), ("neg", 5.0), ("far", 6.5), ("ok", 6.0))],
                                   "function_name string, " + ", ".join(f"{c} double" for c in RANGE_CHECK_FEATURES))
    live = spark.createDataFrame([("zero", 0.0, 0.0), ("neg", 0.0, 0.0), ("far", 0.0, 0.0), ("ok", 5.5, 120.0)],
                                 "function_name string, avg_duration_ms double, max_memory_mb double")
    score = lambda df: df.withColumn("prediction", F.when(F.col("function_name") == "zero", 0.0)
                                     .when(F.col("function_name") == "neg", -2.0).otherwise((10 + 0.2 * F.col("memory_config_mb")) * F.col("aws_duration_ms") / 3600000.0))
    top = spark.createDataFrame([(1.0,)], "target_max double")
    got = {r.function_name: r for r in gap_report(inputs, live, train, top, score).collect()}
    assert got["zero"].predicted_wh == 0.0 and got["zero"].confidence_status == "low"
    assert got["neg"].predicted_wh == 0.0001 and "-2.0000" in got["neg"].reasons
    assert got["far"].confidence == 0.5 and "out of typical range [4.0, 6.0]" in got["far"].reasons
    ok = got["ok"]      # memory 120 in both memory inputs: the used memory is out of its range
    assert ok.memory_config_mb == 120.0 and ok.aws_memory_used_mb == 120.0 and ok.aws_duration_ms == 5.5
    assert abs(ok.accuracy_pct - 100.0) < 1e-9 and ok.verdict == "Excellent"


def test_missing_inputs_rule(spark):
    from wattline.operators.checks import missing_inputs
    df = spark.createDataFrame([("raw", {"a": 1.0, "b": 1.0}), ("enc", {"x": 1.0, "y": 1.0}), ("bad", {"a": 1.0, "x": 1.0}), ("none", None)],
                               "k string, inputs map<string,double>")
    got = {r.k: r.message for r in missing_inputs(df, "k", ["a", "b"], ["x", "y"]).collect()}
    assert got == {"bad": "Missing required features: b", "none": "Missing required features: a, b"}


def test_means_of_an_empty_table_are_the_fallback(spark):
    from wattline.config import FALLBACK_MEANS
    from wattline.plans.modelling import MEAN_FEATURES, means_of
    df = spark.createDataFrame([], ", ".join(f"{c} double" for c in MEAN_FEATURES) + ", function_type string")
    r = means_of(df).first()
    assert r.mean_lines_of_code == FALLBACK_MEANS["lines_of_code"] and r.share_io == FALLBACK_MEANS["share_io"]


def _wavy(spark, n=3000):
    df = spark.range(n).select(F.col("id").alias("row_id"), *[((F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1 << 20))) / (1 << 20)).alias(c) for c in "abcd"])
    return df.withColumn("d", F.floor(F.col("d") * 4).cast("double")).withColumn("y", F.sin(6 * F.col("a")) + F.col("b") * F.col("d"))


def test_forest_levels_and_local_subtrees(spark):
    """Splits from level jobs equal brute force; both ways predict alike, on any
    partitioning, and a fold's forest never sees its rows."""
    import numpy as np

    from wattline.models import forest as FO
    df = _wavy(spark)
    whole = FO.fit_forests(df, list("abcd"), "y", FO.Settings(trees=12, depth=10), F.col("row_id"))[0]
    again = FO.fit_forests(df.repartition(7), list("abcd"), "y", FO.Settings(trees=12, depth=10), F.col("row_id"))[0]
    for x, y in zip(whole.trees, again.trees):
        assert np.array_equal(x.feature, y.feature) and np.array_equal(x.bin, y.bin) and np.allclose(x.value, y.value)
    levels = FO.fit_forests(df, list("abcd"), "y", FO.Settings(trees=12, depth=10, local_rows=200), F.col("row_id"))[0]
    # one node, one looked-at feature: the same split either way
    for x, y in zip(whole.trees, levels.trees):
        assert (x.feature[0], x.bin[0]) == (y.feature[0], y.bin[0])
    score = [m.transform(df, floor=None).agg(F.corr("y", "prediction")).first()[0] for m in (whole, levels)]
    assert min(score) > 0.98 and abs(score[0] - score[1]) < 0.01
    folds = FO.fit_forests(df, list("abcd"), "y", FO.Settings(trees=2, depth=6), F.col("row_id"), (F.col("row_id") % 3).cast("int"), range(3))
    alone = FO.fit_forests(df.where("row_id % 3 != 1").withColumn("z", F.lit(0)), list("abcd"), "y", FO.Settings(trees=2, depth=6), F.col("row_id"))[0]
    assert len(folds) == 3 and [len(f.trees) for f in folds] == [2, 2, 2] and len(alone.trees) == 2
    empty = FO.fit_forests(df.where("false"), list("abcd"), "y", FO.Settings(trees=2), F.col("row_id"))[0]
    assert empty.transform(df).selectExpr("max(prediction) p").first().p == 0.0


def test_best_splits_against_brute_force(spark):
    import numpy as np

    from wattline.models import forest as FO
    r = np.random.default_rng(3)
    codes, y, w = r.integers(0, 6, 200), r.random(200), r.integers(1, 4, 200)
    rows = [(0, 0, 2, int(c), float(w[codes == c].sum()), float((w * y)[codes == c].sum())) for c in range(6)]
    got = FO._best_splits(spark.createDataFrame(rows, "tree int, node long, feature int, bin int, w double, wy double")).first()

    def score(c):
        a, b = codes <= c, codes > c
        return sum(float((w * y)[k].sum()) ** 2 / float(w[k].sum()) for k in (a, b))

    assert got["bin"] == max(range(5), key=score) and got["feature"] == 2 and got["lw"] == float(w[codes <= got["bin"]].sum())
    score_, cut = FO._best_sorted(codes, np.zeros(200, np.int64), w.astype(float), w * y, np.array([w.sum()]), np.array([(w * y).sum()]))
    assert cut[0] == got["bin"]


def _enumerated(predict, x, background, weight):
    """Shapley values from all subsets."""
    import itertools
    import math
    n = len(x)

    def worth(s):
        z = background.copy()
        z[:, list(s)] = x[list(s)]
        return predict(z) @ weight

    subsets = {s: worth(s) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    return [sum(math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (subsets[tuple(sorted((*s, i)))] - v)
                for s, v in subsets.items() if i not in s) for i in range(n)]


def test_tree_and_kernel_attributions_equal_enumeration(spark):
    import numpy as np

    from wattline.models import attribution as AT
    from wattline.models import forest as FO
    from wattline.models import trees as TR
    names = list("abcdef")
    df = _wavy(spark, 400).withColumn("e", F.col("a") * F.col("c")).withColumn("f", F.round(F.col("b") * 3)).withColumn("energy_target_wh", F.col("y") + F.col("e") * F.col("f"))
    df = df.withColumn("is_validation", F.col("row_id") % 5 == 0)
    rows, background = df.where("row_id < 6"), df.where("row_id between 100 and 111")
    x = np.array([[r[c] for c in names] for r in rows.orderBy("row_id").collect()])
    bg = np.array([[r[c] for c in names] for r in background.collect()])
    weight = np.full(len(bg), 1 / len(bg))
    forest = FO.fit_forests(df, names, "energy_target_wh", FO.Settings(trees=9, depth=6), F.col("row_id"))[0]
    gbt = TR.fit(df, features=names, max_iter=6, max_depth=4)
    folder = tempfile.mkdtemp(prefix="wattline-trees-")
    for nodes, scored in ((AT.forest_nodes(forest), forest.transform(rows, floor=None)), (AT.ensemble_nodes(gbt, names, folder), TR.predict(gbt, rows, floor=None))):
        want = {r.row_id: r.prediction for r in scored.collect()}
        predict = lambda z, nodes=nodes: sum(AT.tree_predict(t, z) for t in nodes)
        got = AT.tree_shap(rows, background, names, nodes).collect()
        assert len(got) == 6 * len(names) and all(abs(r.prediction - want[r.row_id]) < 1e-9 for r in got)
        for i in range(6):
            exact = _enumerated(predict, x[i], bg, weight)
            own = {r.feature: r.shap_value for r in got if r.row_id == i}
            assert all(abs(own[n] - v) < 1e-9 for n, v in zip(names, exact))
    plain = [(t.feature, t.threshold, t.left, t.right, t.value) for t in AT.forest_nodes(forest)]
    predict = lambda z: sum(AT.tree_predict(AT.NodeTable(*p), z) for p in plain)
    for r in (got := AT.kernel_shap(rows, background, names, predict).collect()):
        assert abs(r.shap_value - _enumerated(predict, x[r.row_id], bg, weight)[names.index(r.feature)]) < 1e-9
    few = AT.kernel_shap(rows, background, names, predict, samples=20).groupBy("row_id").agg(
        F.sum("shap_value").alias("s"), F.first("base_value").alias("b"), F.first("prediction").alias("p")).collect()
    assert all(abs(r.s + r.b - r.p) < 1e-9 for r in few) and len(got) == 36


def test_registered_models_really_fit(spark, monkeypatch):
    """The registered settings are the original's, and the queries run on small ones."""
    from wattline.plans import modelling as PM
    from wattline.sources.tables import Catalog
    assert PM.CV_SETTINGS == {"gbt": {"max_iter": 500}, "rf": {"trees": 100}, "mlp": {"epochs": 100}}
    assert (PM.FO.Settings().trees, PM.FO.Settings().depth, PM.EXPLAINED, PM.BACKGROUND, PM.CENTRES) == (200, 15, 100, 100, 5)
    cat = Catalog(spark, "/root/testdata/sf0.001")
    data = PM.prepared(cat).where("split != 'test'")
    cv = PM.cross_validate(data, {"gbt": {"max_iter": 3, "max_depth": 4}, "rf": {"trees": 20}, "mlp": {"epochs": 2}}).collect()
    assert len(cv) == 15 and all(r.r2 > 0.99 for r in cv if r.model == "rf") and sum(r.n for r in cv if r.model == "rf") == data.count()
    small = {"gbt": {"max_iter": 3, "max_depth": 4}, "rf": {"trees": 5}, "mlp": {"epochs": 2}}
    full = PM.fitted
    monkeypatch.setattr(PM, "_MODELS", {})
    monkeypatch.setattr(PM, "fitted", lambda data, kind: full(data, kind, **small[kind]))
    monkeypatch.setattr(PM, "EXPLAINED", 8)
    rows = PM.ml_shap(cat).collect()
    assert len(rows) == 3 * 8 * len(PM.FEATURE_ORDER)
    sums = {}
    for r in rows:
        s = sums.setdefault((r.model, r.row_id), [0.0, r.base_value, r.prediction])
        s[0] += r.shap_value
    assert all(abs(a + b - p) < 1e-8 for a, b, p in sums.values())
    monkeypatch.setattr(PM, "_SCORED", {})
    online = {r.function_name: r for r in PM.online_predictions(cat).collect()}
    assert {r.model for r in online.values()} == {"xgboost", "random_forest", "neural_network"} and min(r.prediction for r in online.values()) >= 0.0001
    for r in PM.online_results(cat).collect():
        p = online.pop(r.function_name)
        per_call = p.memory_config_mb / 1024 * p.aws_duration_ms / 1000 * 0.001392 + 16.70 / 1_000_000
        assert abs(r.energy_wh_per_invocation - p.prediction) <= 5.1e-5 and abs(r.monthly_carbon_kg - 7_200 * p.prediction * 0.708) < 6e-5
        assert abs(r.monthly_cost_inr - 7_200_000 * per_call) < 6e-3 and abs(r.energy_kwh - r.total_requests * p.prediction / 1000) < 6e-4
        assert abs(r.cost_inr - r.total_requests * per_call) < 6e-3 and 10_000_000 < r.total_requests < 14_400_000
    assert not online
    saved = PM.sink_model(cat).groupBy("model").agg(F.count("*").alias("n"), F.count_if("same").alias("same")).collect()
    assert {r.model for r in saved} == {"gbt", "rf", "mlp"} and all(r.n == r.same > 0 for r in saved)
    live = PM.str_gap_model(cat)
    assert live.count() == cat.events.count() and live.where("predicted_wh < 0.0001 or model_version != 1").count() == 0
    files = PM.ml_validation_files(cat).collect()
    report = {(r.platform, r.group): r for r in PM.ml_trace_validation(cat).collect()}
    for r in files:
        want = report[r.platform, "overall"]
        assert (r.n, r.verdict, r.detail_rows) == (want.n, want.verdict, want.n) and set(r.groups) >= set(PM.VALIDATION_GROUPS[r.platform])
        assert abs(r.detail_mae - want.mae) < 1e-8 and abs(r.detail_accuracy - r.accuracy) < 1e-6 and abs(r.r2 - want.r2) < 1e-9
    assert len(files) == 2


def test_forest_sums_by_bin_in_bounded_jobs(spark, monkeypatch):
    """Sums by bin give the splits of sorted rows; trees dealt a few at a time and rows looked at in
    chunks are the trees of one job; a larger node is finished by one task."""
    import numpy as np

    from wattline.models import forest as FO
    assert FO.LOCAL_ROWS >= 1 << 19
    r = np.random.default_rng(5)
    node, code, w, y = r.integers(0, 7, 5000), r.integers(0, 40, 5000), r.integers(1, 4, 5000).astype(float), r.random(5000)
    sums = w, w * y, np.bincount(node, w), np.bincount(node, w * y)
    a, b = FO._best_sorted(code, node, *sums), FO._best_binned(code, node, *sums, np.full(7, 40))
    assert np.array_equal(a[1], b[1]) and np.allclose(a[0], b[0])
    alone = FO._best_binned(np.zeros(3, int), np.array([0, 0, 1]), np.ones(3), np.ones(3), np.array([2.0, 1.0]), np.array([2.0, 1.0]), np.array([1, 1]))
    assert (alone[0] == -np.inf).all()
    df = _wavy(spark)
    fit = lambda: FO.fit_forests(df, list("abcd"), "y", FO.Settings(trees=7, depth=9), F.col("row_id"))[0]
    whole = fit()
    jobs, finish = [], FO._finish
    monkeypatch.setattr(FO, "_finish", lambda *x: jobs.append(sum(len(t.small) for t in x[1])) or finish(*x))
    monkeypatch.setattr(FO, "DEALT_ROWS", 6000)
    few = fit()
    assert jobs == [2, 2, 2, 1]
    for x, y in zip(whole.trees, few.trees, strict=True):
        assert all(np.array_equal(getattr(x, k), getattr(y, k)) for k in ("feature", "bin", "left", "value"))
    monkeypatch.setattr(FO, "SORTED_ROWS", 0)
    score = [m.transform(df, floor=None).agg(F.corr("y", "prediction")).first()[0] for m in (whole, fit())]
    assert min(score) > 0.98 and abs(score[0] - score[1]) < 0.005


def test_network_trains_varying_columns_without_row_objects(spark, monkeypatch):
    """A constant column is not in the training matrix and keeps its initial weights; a step
    equals Adam written out; rows reach the steps as plain numbers."""
    import numpy as np
    from pyspark.sql import DataFrame

    from wattline.models import mlp as M
    r = np.random.default_rng(2)
    sizes, x, y = [3, 4, 1], r.normal(size=(8, 3)), r.normal(size=8)
    theta = M._flatten(M._init(sizes, 1))
    want, state = theta.copy(), np.zeros(2 * len(theta))
    adam = M._Adam(theta, state, sizes, 0.01)
    loss = lambda v: 0.5 * np.mean((M._forward(M._unflatten(v, sizes), x)[0] - y) ** 2)
    m = v = np.zeros(len(want))
    for t in (1, 2, 3):
        g = np.array([(loss(want + e) - loss(want - e)) / 2e-6 for e in np.eye(len(want)) * 1e-6])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want = want - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        adam.step(x, y, t)
        assert np.allclose(theta, want, atol=1e-5)
    monkeypatch.setattr(DataFrame, "mapInPandas", None)
    df = _frame(spark, 300).withColumn("k", F.lit(3.0)).withColumn("energy_target_wh", F.col("a") + 2 * F.col("b"))
    net = M.DistributedMLP(["a", "k", "b"], "energy_target_wh", hidden=(8,), epochs=20, batch=16, lr=0.01)
    net.fit(df)
    assert net._varying(df) == [0, 2] and net._varying(df.withColumn("k", F.when(F.col("a") > 0, F.col("k")))) == [0, 1, 2]
    assert net.params[0].shape == (3, 8) and np.array_equal(net.params[0][1], M._init([3, 8, 1], 42)[0][1])
    assert not np.allclose(net.params[0][0], M._init([3, 8, 1], 42)[0][0]) and net.history[-1] < net.history[0] / 4


def test_features_are_saved_by_columns(spark):
    """A plan that needs two columns of the split feature table reads two."""
    from wattline.plans import modelling as PM
    from wattline.sources.tables import Catalog
    cat = Catalog(spark, "/root/testdata/sf0.001")
    plan = PM.prepared(cat).select("inv_id", "split")._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan.lower() and "ReadSchema: struct<inv_id:string,split:string>" in plan


def test_summary_source_is_computed_once(spark, monkeypatch):
    from wattline.plans import metrics as PMET
    from wattline.plans import modelling as PM
    from wattline.sources.tables import Catalog
    cat, calls, own = Catalog(spark, "/root/testdata/sf0.001"), [], PMET.azure_like
    monkeypatch.setattr(PMET, "azure_like", lambda c: calls.append(1) or own(c))
    assert PM.src_json_summary(cat).count() == 5 and len(calls) == 1


def test_sources_come_in_small_batches(spark):
    """Workers hold few bytes of files at once, whatever the number of rows of a batch."""
    df = spark.createDataFrame([("b", str(i), "x = 1\n" + "# " + "a" * 1000 + "\n" * 3) for i in range(20)] + [("b", "n", None)], "bundle string, path string, content string")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    out = CM.source_metrics(df)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= CM.BATCH_BYTES and "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    rows = {r["path"]: r for r in out.collect()}
    assert rows["0"]["loc"] == 1 and rows["0"]["parsed"] and rows["n"]["loc"] == 0 and len(rows) == 21


def test_training_ends_are_the_bounds_of_all_rows(spark):
    """One pass gives the same bounds and largest target; nulls don't count."""
    from wattline.config import RANGE_CHECK_FEATURES
    from wattline.operators.checks import training_bounds
    from wattline.plans.modelling import training_ends
    cols = [*RANGE_CHECK_FEATURES, "energy_target_wh"]
    rows = [tuple(None if (i + k) % 7 == 0 else float((i * 31 + k * 17) % 101) - 20 for k in range(len(cols))) for i in range(60)]
    train = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    ends, top = training_ends(train)
    assert ends.count() == 2 and top.first()[0] == max(r[-1] for r in rows if r[-1] is not None)
    assert training_bounds(ends, RANGE_CHECK_FEATURES).first() == training_bounds(train, RANGE_CHECK_FEATURES).first()
