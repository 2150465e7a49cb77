"""Operators that work without the shuffles, pairs and buffers of their plain forms."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import align, coupling, profile, project, select
from tandem.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def column(spark, values, n=3):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(n)


@pytest.mark.parametrize("kind", ["ties", "even", "odd", "wild", "one", "signs", "inf"])
def test_quantiles_equal_numpy(spark, kind):
    rng = np.random.default_rng(7)
    v = {
        "ties": rng.integers(-3, 4, 1001), "even": rng.normal(size=1000), "odd": rng.normal(size=999), "wild": rng.normal(size=800) * 10.0 ** rng.integers(-300, 300, 800),
        "one": np.array([4.25]), "signs": np.array([-0.0, 0.0, -1e-320, 1e-320, -5, 5]), "inf": np.array([-np.inf, -1, 2, 3, 4, np.inf]),
    }[kind].astype(float)
    shares = [0.0, 0.5, 1.0] if kind == "inf" else [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = [r.value for r in select.quantiles(column(spark, [*v, None, None]), "v", shares).collect()]
    want = [-np.inf, 2.5, np.inf] if kind == "inf" else np.quantile(v, shares)
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    ranks = list(range(0, len(v), max(1, len(v) // 7)))
    assert select.order_statistics(column(spark, v), "v", ranks)[0] == np.sort(v)[ranks].tolist()


def test_implicit_zeros_enter_the_median(spark):
    rng = np.random.default_rng(2)
    for zeros in (0, 3, 60, 61, 500):
        v = rng.normal(size=60)
        dense = np.r_[v, np.zeros(zeros)]
        r = profile.sparsity_profile(column(spark, v), "v", len(dense)).first()
        assert r["median"] == pytest.approx(np.median(dense), rel=1e-15) and r["pct_zeros"] == pytest.approx(100 * zeros / len(dense))
        same = profile.sparsity_profile(column(spark, dense), "v", len(dense)).first()
        assert same == r


def test_selection_of_nothing(spark):
    none = column(spark, [None, None])
    assert select.order_statistics(none, "v", shares=[0.5]) == ([None], 0) and select.order_statistics(none, "v", [0, 3]) == ([None, None], 0)
    assert select.order_statistics(none, "v", shares=[0.5], n_total=4) == ([0.0], 0)
    assert select.order_statistics(column(spark, [1, 2]), "v", [1, 2]) == ([2.0, None], 2)
    assert np.isnan(select.order_statistics(column(spark, [1, float("nan"), 3]), "v", shares=[1.0])[0][0])
    with pytest.raises(ValueError, match="n_total"):
        select.order_statistics(column(spark, [1, 2]), "v", shares=[0.5], n_total=1)


def test_selection_takes_a_fixed_number_of_passes_and_counters(spark, monkeypatch):
    seen, real = [], select._pass
    monkeypatch.setattr(select, "_pass", lambda *a: seen.append(out := real(*a)) or out)
    v = np.random.default_rng(0).normal(size=20_000)
    assert select.order_statistics(column(spark, v), "v", shares=[0.5])[0][0] == np.median(v)
    assert len(seen) <= 5 and all(len(x) <= 2 * 2**select.BITS for x in seen)


def pairs_and_cells(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    pairs = [(str(i), f"p{j}", f"g{j}", float(rng.integers(0, 3)), float(rng.integers(0, 3))) for i in range(n + 5) for j in range(4)]
    cells = [(str(i), None if i % 17 == 0 else "ABC"[min(2, i % 5)], f"D{i % 4}") for i in range(n)]
    return spark.createDataFrame(pairs, "cell_id string, pair_id string, feature string, x double, y double"), spark.createDataFrame(cells, "cell_id string, cell_type string, donor_id string")


def test_one_scan_equals_the_three(spark, tmp_path):
    pairs, cells = pairs_and_cells(spark)
    pairs.write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    one = coupling.coupling_in_one_scan(pairs, cells, min_stratum=60, min_cells=20)
    assert len(re.findall(r"FileScan parquet", plan(one))) == 1
    show = lambda df, axis: {(axis, r["stratum"] if axis != "all" else None, r.pair_id, r.feature, r.pearson_r and round(r.pearson_r, 9), r.n_cells) for r in df.collect()}
    want = show(coupling.per_feature_pearson(pairs, 20), "all")
    for c in ("cell_type", "donor_id"):
        want |= show(coupling.coupling_by_stratum(pairs, cells, c, 60, 20), c)
    assert {(r.axis, r.stratum, r.pair_id, r.feature, r.pearson_r and round(r.pearson_r, 9), r.n_cells) for r in one.collect()} == want
    assert {x[0] for x in want} == {"all", "cell_type", "donor_id"}


def test_bucketed_tables_align_without_a_shuffle(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = lambda f: spark.createDataFrame([(str(c), f"{f}{j}", float(rng.integers(1, 9))) for c in range(60) for j in range(3) if rng.random() < 0.6], "cell_id string, feature string, value double")
    x, y = long("x"), long("y")
    names = spark.createDataFrame([(f"y{j}", f"g{j}", f"x{j}", f"y{j}") for j in range(3)], "pair_id string, feature string, x_feature string, y_feature string")
    cells = spark.createDataFrame([(str(c), f"T{c % 2}", "D") for c in range(60)], "cell_id string, cell_type string, donor_id string")
    bx, by, bc = (tables.write_bucketed(df, f"t_{n}_{id(tmp_path)}", 4) for n, df in (("x", x), ("y", y), ("c", cells)))
    written = []
    real = align.align_pairs
    align.align_pairs = lambda *a, **k: written.append(real(*a, **k)) or written[-1]
    try:
        with_setting = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
        both = align.align_bucketed(bx, by, names, f"t_pairs_{id(tmp_path)}", 4)
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == with_setting
    finally:
        align.align_pairs = real
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")  # cells are too large to be sent around; the names are not
    try:
        exchanges = lambda df: len(re.findall(r"(?<!Broadcast)Exchange", plan(df)))
        assert exchanges(real(bx, by, F.broadcast(names))) == 0
        assert exchanges(real(x, y, F.broadcast(names))) == 2
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
        assert exchanges(align.attach_cells(both, bc, ["cell_type"])) == 0
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", with_setting)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, real(x, y, names).collect()))


def test_repeated_keys_are_refused_when_asked(spark):
    x = spark.createDataFrame([("a", "f", 1.0), ("a", "f", 2.0)], "cell_id string, feature string, value double")
    names = spark.createDataFrame([("p", "g", "f", "f")], "pair_id string, feature string, x_feature string, y_feature string")
    with pytest.raises(ValueError, match="1 keys .* 2 rows of x"):
        align.align_pairs(x, x.limit(1), names, strict=True)
    assert align.align_pairs(x.limit(1), x.limit(1), names, strict=True).count() == 1


def correlations(m):
    """Pairwise-complete, from a features x strata matrix with NaN for what is missing."""
    out = {}
    for i in range(m.shape[1]):
        for j in range(m.shape[1]):
            ok = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
            a, b = m[ok, i], m[ok, j]
            if ok.any():
                flat = len(a) < 2 or np.ptp(a) == 0 or np.ptp(b) == 0
                out[f"S{i:04}", f"S{j:04}"] = (None if flat else round(np.corrcoef(a, b)[0, 1], 9), int(ok.sum()))
    return out


def by_stratum(spark, m):
    rows = [(f"p{f}", f"S{s:04}", None if np.isnan(m[f, s]) and f % 2 else float(m[f, s])) for f in range(m.shape[0]) for s in range(m.shape[1])]
    return spark.createDataFrame(rows, "pair_id string, stratum string, pearson_r double")


@pytest.mark.parametrize("seed", range(3))
def test_consistency_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    m = rng.uniform(-1, 1, (9, 12))
    m[rng.random(m.shape) < 0.4] = np.nan
    m[:, 3], m[:, 4] = 0.7, np.where(rng.random(9) < 0.5, 0.3, np.nan)  # constant
    m[:, 5] = m[:, 6] * 0.5 + 0.25
    m[:, 7] = np.nan
    got = {(r.s1, r.s2): (r.r if r.r is None else round(r.r, 9), r.n_shared) for r in coupling.stratum_consistency(by_stratum(spark, m)).collect()}
    assert got == correlations(m)


def test_many_strata_make_no_rows_of_pairs(spark):
    rng = np.random.default_rng(4)
    m = rng.uniform(-1, 1, (40, 1000))
    df = coupling.stratum_consistency(by_stratum(spark, m).repartition(4))
    got = df.where("s1 < s2").orderBy("s1", "s2").toPandas()
    want = np.corrcoef(m.T)[np.triu_indices(1000, 1)]
    assert len(got) == len(want) and np.allclose(got["r"], want, atol=1e-9) and (got["n_shared"] == 40).all()
    assert not re.search(r"Join[^\n]*pair_id", plan(df))


@pytest.mark.parametrize("seed", range(3))
def test_sparse_skew_equals_dense(spark, seed):
    rng = np.random.default_rng(seed)
    for v, zeros in ((rng.gamma(1, 2, 50), 30), (rng.normal(size=7) - 3, 100), (np.full(9, 2.0), 4), (np.full(9, 2.0), 0), (np.array([1.0]), 2), (np.zeros(0), 5), (np.array([1.0, 2.0]), 0)):
        dense = np.r_[v, np.zeros(zeros)]
        n, d = len(dense), dense - dense.mean()
        flat = n < 3 or np.ptp(dense) == 0
        want = None if flat else np.sqrt(n * (n - 1)) / (n - 2) * (d**3).mean() / (d**2).mean() ** 1.5
        got = profile.skew_corrected(column(spark, v) if len(v) else column(spark, [0]).limit(0), "v", n).first()["skew"]
        assert got == (want if want is None else pytest.approx(want, rel=1e-9))


def test_densify_spreads_rows_where_they_stand(spark):
    long = spark.createDataFrame([("a", "f1", 2.0), ("a", "f3", 3.0), ("b", "f2", 1.0), ("z", "f1", 9.0), ("b", "other", 5.0)], "cell_id string, feature string, value double")
    cells, feats = spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string"), spark.createDataFrame([("f1",), ("f2",), ("f3",)], "feature string")
    df = project.densify(long, cells, feats)
    assert not re.search("Cartesian|NestedLoop", plan(df))
    got = {(r.cell_id, r.feature): r.value for r in df.collect()}
    assert len(got) == 9 and {k: v for k, v in got.items() if v} == {("a", "f1"): 2.0, ("a", "f3"): 3.0, ("b", "f2"): 1.0}
    assert project.densify(long, cells, feats.limit(0)).count() == 0 and project.densify(long, cells.limit(0), feats).count() == 0
