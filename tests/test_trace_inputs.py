"""The inputs of the model-scored validation."""

from pytest import approx

from wattline.operators import traces as T
from wattline.plans import modelling as PM
from wattline.sources.tables import Catalog


def test_validation_shuffles_no_raw_rows_for_unused_percentiles(spark, monkeypatch):
    """The summary without percentiles has the other columns' values, and the validation asks for that."""
    cat = Catalog(spark, "/root/testdata/sf0.001")
    full, plain = T.region_function_summary(cat.v_inv), T.region_function_summary(cat.v_inv, percentiles=False)
    assert set(full.columns) - set(plain.columns) == {"p50_duration_ms", "p99_duration_ms"}
    a, b = ({r["function_name"]: r for r in d.collect()} for d in (full, plain))
    assert a.keys() == b.keys() and a
    assert all(a[k][c] == (approx(b[k][c], rel=1e-12) if isinstance(b[k][c], float) else b[k][c]) for k in a for c in plain.columns)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    seen, own = [], T.region_function_summary
    monkeypatch.setattr(T, "region_function_summary", lambda *x, **k: seen.append(own(*x, **k)) or seen[-1])
    monkeypatch.setattr(PM, "_SCORED", {})
    monkeypatch.setattr(PM, "scorer", lambda *a, **k: lambda df: df.withColumn("prediction", df["actual_wh"]))
    assert PM.trace_predictions(cat, "alibaba").count() > 0 and "p50_duration_ms" not in seen[0].columns
