"""The ridge fit in blocks and its scores against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import deviation
from tandem.plans import shared


def sparse(spark, x, y):
    """Rows of places and values, zeros left out; values of each row in the order of their places."""
    v = np.hstack([x, y])
    rows = [(str(i), np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "cell_id string, pos array<int>, value array<double>")


def numpy_fit(x, y, alpha=1.0):
    xc, yc = x - x.mean(0), y - y.mean(0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean(0) - x.mean(0) @ w


def whole(model):
    w = np.full((model.p, model.q), np.nan)
    for r in model.coefficients().toLocalIterator():
        w[r["predictor"], r["target"]] = r["weight"]
    b = model.intercepts().toPandas().sort_values("target")["b"].to_numpy()
    return w, b


def fitted(spark, out, n, q):
    yhat, y = np.full((n, q), np.nan), np.full((n, q), np.nan)
    for r in out.collect():
        at = slice(r["j"] * deviation.BLOCK, r["j"] * deviation.BLOCK + len(r["yhat"]))
        yhat[int(r["cell_id"]), at], y[int(r["cell_id"]), at] = r["yhat"], r["y"]
    return yhat, y


@pytest.mark.parametrize("partitions", [1, 8])
def test_ridge_equals_numpy(spark, partitions):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 1, (200, 5)) * (rng.random((200, 5)) < 0.9)
    y = x @ rng.normal(size=(5, 4)) + rng.normal(size=(200, 4))
    rows = sparse(spark, x, y).repartition(partitions)
    model = deviation.fit_ridge(rows, 5, 4)
    w, b = whole(model)
    want, c = numpy_fit(x, y)
    assert np.allclose(w, want, atol=1e-9) and np.allclose(b, c, atol=1e-7)
    yhat, given = fitted(spark, deviation.predict(rows, model), 200, 4)
    assert np.allclose(given, y) and np.allclose(yhat, x @ want + c, atol=1e-8) and np.allclose((y - yhat).mean(0), 0, atol=1e-8)
    got = {r.cell_id: r.deviation_score for r in deviation.deviation_score(rows, model).collect()}
    assert np.allclose([got[str(i)] for i in range(200)], np.abs(y - yhat).mean(1), atol=1e-8)


@pytest.mark.parametrize("broadcast", [64_000_000, 1])
def test_ridge_in_blocks_equals_numpy(spark, broadcast):
    """More predictors than three blocks, strips of one block, panels broadcast and dealt out."""
    rng = np.random.default_rng(5)
    n, p, q = 300, 1700, 700
    x = rng.normal(3, 1, (n, p)) * (rng.random((n, p)) < 0.3)
    x[:, :9] = rng.normal(1e4, 1, (n, 9))  # means that are large against what is around them
    y = x[:, :5] @ rng.normal(size=(5, q)) + rng.normal(size=(n, q))
    rows, path = shared.saved(sparse(spark, x, y).repartition(3), "rows")
    model = deviation.fit_ridge(rows, p, q, strip_bytes=8 * (p + q) * 600, broadcast_bytes=broadcast)
    w, b = whole(model)
    want, c = numpy_fit(x, y)
    assert w.shape == (p, q) and np.allclose(w, want, atol=1e-8) and np.allclose(b, c, atol=1e-3)
    score = np.abs(y - x @ want - c).mean(1)
    for limit in (64_000_000, 2 * 8 * deviation.BLOCK**2, 1):  # one tile; tiles of two blocks of predictors; of one block
        yhat, given = fitted(spark, deviation.predict(rows, model, limit), n, q)
        assert np.allclose(given, y) and np.allclose(yhat, x @ want + c, atol=1e-5)
        got = {r.cell_id: r.deviation_score for r in deviation.deviation_score(rows, model, limit).collect()}
        assert np.allclose([got[str(i)] for i in range(n)], score, atol=1e-6)
    shared.discard(spark, path)


def test_no_matrix_is_collected(spark, monkeypatch):
    """The driver gets the means and nothing else of the fit."""
    from pyspark.sql.classic.dataframe import DataFrame

    got = []
    collect, pandas = DataFrame.collect, DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "collect", lambda self: got.append(out := collect(self)) or out)
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: got.append(out := pandas(self)) or out)
    rng = np.random.default_rng(1)
    deviation.fit_ridge(sparse(spark, rng.normal(size=(30, 600)), rng.normal(size=(30, 3))), 600, 3)
    assert sum(x.size if hasattr(x, "size") else len(x) for x in got) <= 3 * 603  # toPandas collects


def test_names_shared_by_both_sides(spark):
    long = spark.createDataFrame([("a", "GEX", "CD4", 1.0), ("a", "ADT", "CD4", 2.0), ("b", "ADT", "CD8", 3.0), ("b", "ADT", "CD8", 0.5), ("a", "GEX", "CD9", 7.0)], "cell_id string, feature_type string, feature string, value double")
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string")
    side = lambda kind, *names: spark.createDataFrame([(kind, f) for f in names], "feature_type string, feature string")
    to = deviation.layout(side("GEX", "CD8", "CD4"), side("ADT", "CD4", "CD8"))
    assert (to.p, to.q) == (2, 2)
    got = {r.cell_id: dict.fromkeys(r.pos, 0.0) | {k: sum(v for j, v in zip(r.pos, r.value) if j == k) for k in r.pos} for r in deviation.vectors(long, cells, to).collect()}
    assert got == {"a": {0: 1.0, 2: 2.0}, "b": {3: 3.5}, "c": {}}


def test_one_name_as_predictor_and_target(spark):
    long = spark.createDataFrame([("a", "f", 1.0), ("b", "g", 2.0)], "cell_id string, feature string, value double")
    names = spark.createDataFrame([("f",), ("g",)], "feature string")
    to = deviation.layout(names, names)
    got = {r.cell_id: (r.pos, r.value) for r in deviation.vectors(long, long.select("cell_id"), to).collect()}
    assert got == {"a": ([0, 2], [1.0, 1.0]), "b": ([1, 3], [2.0, 2.0])}


def test_plan_of_vectors_names_no_feature(spark):
    long = spark.range(1).select(F.lit("c").alias("cell_id"), F.lit("f1").alias("feature"), F.lit(1.0).alias("value"))
    few, many = (spark.range(n).select(F.concat(F.lit("f"), "id").alias("feature")) for n in (2, 3000))
    size = [len(deviation.vectors(long, long.select("cell_id"), deviation.layout(x, x))._jdf.queryExecution().optimizedPlan().toString()) for x in (few, many)]
    assert size[1] < 1.1 * size[0]


def test_no_rows_and_constant_columns(spark):
    rows = sparse(spark, np.array([[1.0, 2.0], [1.0, 4.0], [1.0, 9.0]]), np.array([[1.0], [2.0], [5.0]]))
    with pytest.raises(ValueError, match="at least one row"):
        deviation.fit_ridge(rows.limit(0), 2, 1)
    w, b = whole(deviation.fit_ridge(rows, 2, 1))
    assert w[0, 0] == 0 and np.isfinite(w).all() and np.isfinite(b).all()


def test_shared_folder(spark):
    from types import SimpleNamespace as N

    fake = lambda conf, master: N(conf=N(get=lambda k, d=None: conf.get(k, d)), sparkContext=N(master=master), _jvm=spark._jvm, _jsc=spark._jsc)
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    local = {"spark.sql.warehouse.dir": "file:/tmp/warehouse"}
    assert shared.shared_dir(fake(local, "local[4]")) == "file:/tmp/warehouse/_scratch"
    assert shared.shared_dir(fake(local | {"spark.checkpoint.dir": "/mnt/all/"}, "spark://m:7077")) == "/mnt/all"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(fake(local, "spark://m:7077"))
