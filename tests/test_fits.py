"""The forest of a shared table and the network on packed rows."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_models import _wavy


def test_small_table_is_shared_instead_of_dealt(spark, monkeypatch):
    """Tasks grow whole trees from one table; the trees are those of dealt samples, for all folds."""
    from wattline.models import forest as FO
    calls, finish = [], FO._finish
    monkeypatch.setattr(FO, "_finish", lambda *x: calls.append(1) or finish(*x))
    df = _wavy(spark)
    twice = df.unionByName(df.limit(50)).withColumn("b", F.when(F.col("row_id") % 13 > 0, F.col("b")))
    fit = lambda: FO.fit_forests(twice, list("abcd"), "y", FO.Settings(trees=3, depth=9), F.col("row_id"), (F.col("row_id") % 3).cast("int"), [-1, 0, 2])
    shared = fit()
    assert not calls
    monkeypatch.setattr(FO, "SHARED_TREES", 1 << 30)
    dealt = fit()
    assert calls
    for a, b in zip(shared, dealt, strict=True):
        for x, y in zip(a.trees, b.trees, strict=True):
            assert all(np.array_equal(getattr(x, k), getattr(y, k)) for k in ("feature", "bin", "left", "value"))


def test_network_epochs_move_blobs(spark, monkeypatch):
    """No weight or input travels as a value of its own; sums of several steps are those of one."""
    from pyspark.sql import DataFrame

    from wattline.models import mlp as M
    monkeypatch.setattr(F, "posexplode", None)
    seen, epoch = [], M.DistributedMLP._epoch
    monkeypatch.setattr(M.DistributedMLP, "_epoch", lambda self, data, *a: seen.append(data) or epoch(self, data, *a))
    df = _wavy(spark).where("row_id < 400").withColumn("energy_target_wh", F.col("y"))

    def fit():
        net = M.DistributedMLP(["a", "b", "d"], "energy_target_wh", hidden=(8,), epochs=3, batch=16, lr=0.01, rows_per_task=50)
        return net.fit(df.coalesce(1))

    one = fit()
    monkeypatch.setattr(M, "SUMMED", 3)
    few = fit()
    assert np.allclose(M._flatten(one.params), M._flatten(few.params), atol=1e-9) and np.allclose(one.history, few.history)
    assert isinstance(seen[0], DataFrame) and dict(seen[0].dtypes) == {"x": "binary", "y": "binary", "held": "binary"}
    assert one.history[-1] < one.history[0]
