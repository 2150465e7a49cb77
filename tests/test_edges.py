"""Edge cases on small inline frames, and properties that must hold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.functions.stats import pearson_p_value, t_statistic
from tandem.operators import align, coupling, profile, project, rank
from tandem.sources import tables


def pairs(spark, rows, pair="p"):
    return spark.createDataFrame([(str(i), pair, "g", float(x), float(y)) for i, (x, y) in enumerate(rows)], "cell_id string, pair_id string, feature string, x double, y double")


def one(df):
    return df.first().asDict()


def test_constant_side_keeps_the_row_without_r(spark):
    r = one(coupling.per_feature_pearson(pairs(spark, [(1, 2), (1, 3), (1, 5)]), 1))
    assert r["pearson_r"] is None and r["n_cells"] == 3


@pytest.mark.parametrize("n, kept", [(50, 1), (49, 0)])
def test_threshold(spark, n, kept):
    df = pairs(spark, [(i + 1, i * i) for i in range(n)] + [(0, 0)] * 5)
    assert coupling.per_feature_pearson(df, 50).count() == kept


def test_all_zero_and_empty(spark):
    assert coupling.per_feature_pearson(pairs(spark, [(0, 0)] * 3), 1).count() == 0
    empty = coupling.per_feature_pearson(pairs(spark, [(1, 1)]).limit(0), 1)
    assert empty.columns == ["pair_id", "feature", "pearson_r", "n_cells"] and rank.rank_by_r(empty).count() == 0


def test_one_sided_zeros_count(spark):
    assert one(coupling.per_feature_pearson(pairs(spark, [(0, 1), (1, 0), (2, 3), (0, 0)]), 1))["n_cells"] == 3


def test_nan_counts_and_makes_r_nan(spark):
    r = one(coupling.per_feature_pearson(pairs(spark, [(float("nan"), 1), (1, 2), (2, 1)]), 1))
    assert r["n_cells"] == 3 and math.isnan(r["pearson_r"])


def test_stratum_size_counts_all_cells(spark):
    cells = spark.createDataFrame([(str(i), "T") for i in range(50)], "cell_id string, cell_type string")
    df = pairs(spark, [(i + 1, (i * 7) % 5) for i in range(30)] + [(0, 0)] * 20)
    assert coupling.coupling_by_stratum(df, cells, "cell_type", 50, 20).count() == 1
    assert coupling.coupling_by_stratum(df, cells.limit(49), "cell_type", 50, 20).count() == 0


def test_variance_of_one_stratum_is_null(spark):
    by = spark.createDataFrame([("p", "g", "A", 0.5)], "pair_id string, feature string, stratum string, pearson_r double")
    r = one(coupling.coupling_variability(by))
    assert r["mean_r"] == 0.5 and r["variance"] is None


def test_two_labels_of_one_gene_stay_apart(spark):
    df = pairs(spark, [(1, 2), (2, 1), (3, 5)], "a").unionByName(pairs(spark, [(1, 2), (2, 1), (3, 5)], "b"))
    assert coupling.per_feature_pearson(df, 1).count() == 2


def test_consistency_is_pairwise_complete_and_null_if_a_pair_is(spark):
    rows = [("p1", "A", 0.1), ("p2", "A", 0.4), ("p3", "A", 0.2), ("p1", "B", 0.3), ("p2", "B", 0.9), ("p3", "B", None), ("p1", "C", 0.5)]
    by = spark.createDataFrame([(p, "g", s, r) for p, s, r in rows], "pair_id string, feature string, stratum string, pearson_r double")
    m = {(r.s1, r.s2): (r.r, r.n_shared) for r in coupling.stratum_consistency(by).collect()}
    assert m["A", "B"][1] == 2 and m["A", "B"][0] == pytest.approx(1.0) and m["A", "C"] == (None, 1)
    assert one(coupling.mean_consistency(coupling.stratum_consistency(by))) == {"mean_r": None, "n_pairs": 3}


def test_profiles(spark):
    v = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert one(profile.skew_corrected(v, "v"))["skew"] == pytest.approx(1.763632614803888)
    assert one(profile.sparsity_profile(v, "v", 4)) == {"median": 2.5, "pct_zeros": 0.0}
    assert one(profile.sparsity_profile(v, "v", 8)) == {"median": 0.5, "pct_zeros": 50.0}
    assert one(profile.value_profile(v, "v", 8)) == {"min": 0.0, "max": 10.0, "mean": 2.0}
    assert one(profile.sparsity_profile(v.limit(0), "v", 3)) == {"median": 0.0, "pct_zeros": 100.0}
    assert one(project.value_flags(spark.createDataFrame([(2.5,), (1.0,)], "v double"), "v")) == {"any_negative": False, "any_non_integer": True}
    assert spark.range(1).select(F.rint(F.lit(2.5))).first()[0] == 2.0


def test_histogram(spark):
    v = spark.createDataFrame([(float(i),) for i in range(4)], "v double")
    assert [r.n for r in profile.histogram(v, "v", 3).orderBy("bin").collect()] == [1, 1, 2]
    flat = profile.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v", 2).orderBy("bin").collect()
    assert [(r.lo, r.hi, r.n) for r in flat] == [(4.5, 5.0, 0), (5.0, 5.5, 3)]
    assert profile.histogram(v.limit(0), "v", 3).count() == 0


def test_p_values(spark):
    df = spark.createDataFrame([(0.5, 10), (0.1, 50), (1.0, 10), (float("nan"), 10), (0.3, 2), (0.3, 90_000), (None, 10), (0.3, 1), (0.0, 5), (-0.5, 10), (0.9999999, 3), (1e-9, 3)], "r double, n long")
    p = [x for (x,) in df.select(pearson_p_value("r", "n")).collect()]
    assert p[:3] == pytest.approx([0.141113, 0.489593, 0.0], abs=1e-6) and p[9] == pytest.approx(p[0])
    assert p[3] is None and p[4] == 1.0 and p[5] == 0.0 and p[6] is None and p[7] is None and p[8] == 1.0
    assert p[10] == pytest.approx(2 / math.pi * math.acos(0.9999999), rel=1e-6) and p[11] == pytest.approx(1.0)
    assert "Python" not in df.select(pearson_p_value("r", "n"))._jdf.queryExecution().executedPlan().toString()
    t = spark.createDataFrame([(0.5, 10), (None, 10), (1.0, 5)], "r double, n long")
    assert [x and round(x, 6) for (x,) in t.select(t_statistic(F.col("r"), F.col("n"))).collect()] == [1.632993, None, None]


@pytest.mark.parametrize("n", [3, 4, 7, 30, 501, 4002, 90_000])
def test_p_value_is_the_area_of_the_tails(spark, n):
    """Against the density of r under independence, (1 - r^2)^((n - 4) / 2), integrated numerically."""
    for r in (0.01, 0.2, 0.6):
        angle = np.linspace(0, np.pi / 2, 2_000_001)  # r = sin(angle)
        f = np.cos(angle) ** (n - 3)
        want = np.trapezoid(np.where(np.sin(angle) >= r, f, 0), angle) / np.trapezoid(f, angle)
        got = spark.range(1).select(pearson_p_value(F.lit(r), F.lit(n))).first()[0]
        assert got == pytest.approx(want, abs=2e-5)


def test_resolve_labels(spark):
    labels = spark.createDataFrame([("click",), ("view",), ("signup",), ("error",)], "label string")
    lookup = spark.createDataFrame([("view", "visit"), ("signup", None), ("error", "absent"), ("click", "visit")], "label string, gene string")
    targets = spark.createDataFrame([("click",), ("visit",)], "feature string")
    res = align.resolve_labels(labels, lookup, targets)
    assert {r.label: (r.feature, r.how) for r in res.collect()} == {"click": ("click", "direct"), "view": ("visit", "lookup"), "signup": (None, "unmatched"), "error": (None, "unmatched")}
    assert [r.label for r in align.unmatched(labels, res).collect()] == ["error", "signup"]
    assert one(align.match_coverage(labels, res)) == {"total": 4, "matched": 2, "unmatched": 2}


def test_overlap_and_identity(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "pos int, cell_id string")
    b = spark.createDataFrame([(0, "y"), (1, "x")], "pos int, cell_id string")
    assert one(align.ids_identical(a, a, "pos"))["identical"] and not one(align.ids_identical(a, b, "pos"))["identical"]
    assert not one(align.ids_identical(a, a.limit(1), "pos"))["identical"]
    assert one(align.id_overlap(a, b))["n_common"] == 2
    assert one(align.axis_overlap(a.withColumnRenamed("cell_id", "feature"), b.limit(0).withColumnRenamed("cell_id", "feature"))) == {"n_first": 2, "n_second": 0, "n_both": 0}


def test_split_modality_keeps_shared_names_apart(spark):
    meas = spark.createDataFrame([("c", "GEX", "CD4", 1.0), ("c", "ADT", "CD4", 2.0), ("c", "ADT", "CD8", 3.0)], "cell_id string, feature_type string, feature string, value double")
    feats = meas.select("feature", "feature_type").distinct()
    assert [r.value for r in project.split_modality(meas, feats, "GEX").collect()] == [1.0]
    assert sorted(r.value for r in project.split_modality(meas.drop("feature_type"), feats, "ADT").collect()) == [1.0, 2.0, 3.0]


def test_approximate_median_counts_frequencies(spark):
    ones = spark.createDataFrame([(v,) for v in [1.0] * 50 + [9.0, 10.0, 11.0]], "v double")
    assert one(profile.sparsity_profile(ones, "v", 53, approximate=True)) == {"median": 1.0, "pct_zeros": 0.0}
    assert one(profile.sparsity_profile(ones, "v", 1000, approximate=True))["median"] == 0.0
    signs = spark.createDataFrame([(float(v),) for v in [-5] * 60 + [-1] * 10 + [7] * 20], "v double")
    assert one(profile.sparsity_profile(signs, "v", 100, approximate=True)) == {"median": -5.0, "pct_zeros": 10.0}
    assert one(profile.sparsity_profile(ones.limit(0), "v", 5, approximate=True)) == {"median": 0.0, "pct_zeros": 100.0}


def test_strict_guards_raise(spark):
    a = spark.createDataFrame([(0, "x", "f"), (1, "y", "f")], "pos int, cell_id string, feature string")
    assert align.assert_aligned(a, a, strict=True).first().aligned and align.ids_identical(a, a, "pos", strict=True).first().identical
    with pytest.raises(ValueError, match="1 of 2 keys only in x"):
        align.assert_aligned(a, a.limit(1), strict=True)
    with pytest.raises(ValueError, match="1 positions"):
        align.ids_identical(a, a.limit(1), "pos", strict=True)


def test_scans_check_their_columns(spark, tmp_path):
    spark.range(3).withColumn("cell_id", F.col("id").cast("int")).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="lacks cell_type, donor_id"):
        tables.read_cells(spark, str(tmp_path / "t"))


def test_dense_and_sparse_agree(spark):
    rng = np.random.default_rng(1)
    x, y = np.maximum(rng.normal(size=(80, 3)), 0), np.maximum(rng.normal(size=(80, 3)), 0)
    long = lambda m, f: spark.createDataFrame([(str(c), f"{f}{j}", float(m[c, j])) for c in range(80) for j in range(3)], "cell_id string, feature string, value double")
    names = spark.createDataFrame([(f"y{j}", f"g{j}", f"x{j}", f"y{j}") for j in range(3)], "pair_id string, feature string, x_feature string, y_feature string")
    dense = coupling.per_feature_pearson(align.align_pairs(long(x, "x"), long(y, "y"), names), 10)
    sparse = coupling.per_feature_pearson(align.align_pairs(long(x, "x").where("value <> 0"), long(y, "y").where("value <> 0"), names).repartition(8), 10)
    got = {r.pair_id: (round(r.pearson_r, 9), r.n_cells) for r in sparse.collect()}
    assert got == {r.pair_id: (round(r.pearson_r, 9), r.n_cells) for r in dense.collect()}
    for j in range(3):
        keep = (x[:, j] != 0) | (y[:, j] != 0)
        assert got[f"y{j}"] == (round(np.corrcoef(x[keep, j], y[keep, j])[0, 1], 9), keep.sum())


def test_scaling_and_swapping_do_not_change_r(spark):
    rows = [(i % 7 + 1, (i * i) % 11 + 1) for i in range(60)]
    r = one(coupling.per_feature_pearson(pairs(spark, rows)))["pearson_r"]
    assert one(coupling.per_feature_pearson(pairs(spark, [(3 * x, 5 * y) for x, y in rows])))["pearson_r"] == pytest.approx(r)
    assert one(coupling.per_feature_pearson(pairs(spark, [(y, x) for x, y in rows])))["pearson_r"] == pytest.approx(r)


def test_sinks_and_empty_profile(spark, tmp_path):
    by = spark.createDataFrame([("p", "A", 0.25), ("p", "B", None), ("q", "A", 0.5)], "pair_id string, stratum string, pearson_r double")
    tables.write_wide(by, str(tmp_path / "wide"), strata=["A", "B"])
    back = tables.read_result(spark, str(tmp_path / "wide"), "pair_id string, A double, B double")
    assert {tuple(r) for r in back.collect()} == {("p", 0.25, None), ("q", 0.5, None)}
    assert project.to_long(project.to_wide(by, ["A", "B"])).count() == 4
    assert project.profile_columns(by, ["nothing"]).count() == 0


def test_no_join_is_a_cross_join_but_densify(spark, sf):
    from tandem import catalog

    for name in ("j3_align_pairs", "a3_by_cell_type", "a8_consistency"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
