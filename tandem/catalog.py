"""The registered queries of the coupling library and their SQL.

Each name starts with the identifier of its operator.  Floating-point results are
rounded to 6 decimals on both sides, as engines differ in the last bits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.stats import pearson, t_statistic
from .operators import align, coupling, deviation, profile, project, rank, select
from .plans import fixtures as fx
from .plans.shared import saved
from .plans.shared import scratch as _scratch
from .sources import tables as src

#: Masked rows and stratum sizes asked for over the embeddings fixture.
MIN_CELLS, MIN_STRATUM = 20, 50
#: Buckets of the fixture's tables; a cluster takes as many as give some 128 MB each.
BUCKETS = 8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            text, recursive = sql.lstrip().removeprefix("RECURSIVE"), "RECURSIVE " * sql.lstrip().startswith("RECURSIVE")
            ORACLES[name] = f"WITH {recursive}{fx.SQL}{' ' if text.startswith(('SELECT', 'FROM')) else ', '}{text}"
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def rd(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0::DOUBLE"


def _pairs(spark, d):
    m = fx.measurements(spark, d)
    f = fx.features(spark, d)
    return align.align_pairs(project.split_modality(m, f, "GEX"), project.split_modality(m, f, "ADT"), fx.pair_names(spark, d))


def _r(x: str = "x", y: str = "y") -> str:
    sx, sy = f"stddev_samp({x})", f"stddev_samp({y})"
    return f"CASE WHEN {sx} * {sy} = 0 THEN NULL ELSE greatest(least(covar_samp({x}, {y}) / ({sx} * {sy}), 1.0), -1.0) END"


LINE_COUPLING = f"lc AS (SELECT pair_id, any_value(feature) AS feature, {_r()} AS r, count(*) AS n_cells FROM lpairs WHERE x <> 0 OR y <> 0 GROUP BY pair_id HAVING count(*) >= 50)"
LINE_COUPLING2 = f"lc2 AS (SELECT pair_id, any_value(feature) AS feature, {_r('x2', 'y2')} AS r, count(*) AS n_cells FROM lpairs WHERE x2 <> 0 OR y2 <> 0 GROUP BY pair_id HAVING count(*) >= 50)"


def _line_coupling(spark, d, second: bool = False):
    return coupling.per_feature_pearson(fx.lineitem_pairs(spark, d, *(("l_quantity", "l_extendedprice") if second else ())))


def _by(col: str) -> str:
    return (
        f"kept AS (SELECT {col} AS s FROM cells GROUP BY 1 HAVING count(*) >= {MIN_STRATUM}),\n"
        f"bs AS (SELECT pair_id, c.{col} AS stratum, any_value(feature) AS feature, {_r()} AS r, count(*) AS n_cells FROM pairs JOIN cells c USING (cell_id)\n"
        f" WHERE c.{col} IN (SELECT s FROM kept) GROUP BY 1, 2 HAVING count(*) >= {MIN_CELLS})"
    )


def _by_stratum(spark, d, col="donor_id"):
    return coupling.coupling_by_stratum(_pairs(spark, d), fx.cells(spark, d), col, MIN_STRATUM, MIN_CELLS)


# -- scans, sinks ------------------------------------------------------------------


@register("s1_read_cells", "SELECT cell_id, cell_type, donor_id FROM cells")
def _(spark, d):
    path = _scratch(spark, "cells")
    src.write_result(fx.cells(spark, d), path, "parquet")
    return src.read_cells(spark, path)


@register("s2_read_features", "SELECT feature, feature_type FROM feats")
def _(spark, d):
    path = _scratch(spark, "features")
    src.write_result(fx.features(spark, d), path, "parquet")
    return src.read_features(spark, path)


@register("s3_read_measurements", f"SELECT cell_id, feature_type, feature, {rd('value * 2')} AS value FROM meas")
def _(spark, d):
    path = _scratch(spark, "measurements")
    m = fx.measurements(spark, d)
    both = m.withColumn("layer", F.lit("X")).unionByName(m.withColumn("value", F.col("value") * 2).withColumn("layer", F.lit("counts")))
    both.write.partitionBy("layer", "feature_type").parquet(path)
    return rounded(src.read_measurements(spark, path, "counts"), "value").select("cell_id", F.col("feature_type").cast("string"), "feature", "value")


@register("s4_explode_matrix", f"SELECT cell_id, 'f' || pos AS feature, {rd('embedding[pos + 1]')} AS value FROM (SELECT CAST(vec_id AS VARCHAR) AS cell_id, embedding, unnest(range(0, 64)) AS pos FROM embeddings)")
def _(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("cell_id"), "embedding")
    names = spark.range(64).select(F.col("id").cast("int").alias("pos"), F.concat(F.lit("f"), "id").alias("feature"))
    return rounded(src.explode_matrix(e, "cell_id", "embedding", names), "value")


@register("s5_s7_result_round_trip", f"{LINE_COUPLING} SELECT pair_id, feature, {rd('r')} AS pearson_r, n_cells FROM lc")
def _(spark, d):
    path = _scratch(spark, "coupling")
    src.write_result(_line_coupling(spark, d), path)
    return rounded(src.read_result(spark, path, "pair_id string, feature string, pearson_r double, n_cells bigint"), "pearson_r")


@register("s6_read_lookup", "SELECT p_partkey || '-' || p_name AS label, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS gene FROM part")
def _(spark, d):
    path = _scratch(spark, "lookup")
    part = spark.read.parquet(f"{d}/part.parquet")
    src.write_result(part.select(F.concat_ws("-", "p_partkey", "p_name").alias("label"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("gene")), path)
    return src.read_lookup(spark, path)


@register("s8_write_wide", f"{_by('donor_id')}, " "k AS (SELECT pair_id, stratum, r FROM bs) " "SELECT pair_id, " + ", ".join(f"{rd(f'max(CASE WHEN stratum = {chr(39)}D{i}{chr(39)} THEN r END)')} AS D{i}" for i in range(7)) + " FROM k GROUP BY pair_id")
def _(spark, d):
    path, strata = _scratch(spark, "wide"), [f"D{i}" for i in range(7)]
    src.write_wide(_by_stratum(spark, d), path, strata=strata)
    return rounded(src.read_result(spark, path, "pair_id string, " + ", ".join(f"{s} double" for s in strata)), *strata)


@register("s9_shape_summary", "SELECT feature_type, count(*) AS n_features, (SELECT count(*) FROM cells) AS n_cells FROM feats GROUP BY 1")
def _(spark, d):
    return src.shape_summary(fx.cells(spark, d), fx.features(spark, d))


# -- projections, filters, reshaping -----------------------------------------------


@register("p1_split_modality", f"SELECT cell_id, feature, {rd('value')} AS value FROM meas WHERE feature_type = 'ADT'")
def _(spark, d):
    return rounded(project.split_modality(fx.measurements(spark, d), fx.features(spark, d), "ADT"), "value").select("cell_id", "feature", "value")


@register("p1_split_shared_names", f"SELECT cell_id, substr(feature, 2) AS feature, {rd('value')} AS value FROM meas WHERE feature_type = 'GEX'")
def _(spark, d):
    # without their first letter all names stand in both types
    short = lambda df: df.withColumn("feature", F.substring("feature", 2, 9))
    return rounded(project.split_modality(short(fx.measurements(spark, d)), short(fx.features(spark, d)), "GEX"), "value").select("cell_id", "feature", "value")


@register("p2_select_features", f"SELECT cell_id, feature, {rd('value')} AS value FROM meas WHERE feature IN ('f1', 'f5', 'p7')")
def _(spark, d):
    names = fx.features(spark, d).where(F.col("feature").isin("f1", "f5", "p7"))
    return rounded(project.select_features(fx.measurements(spark, d), names), "value").select("cell_id", "feature", "value")


@register("p3_filter_stratum", "SELECT pair_id, count(*) AS n FROM lpairs WHERE cell_type = 'AF' GROUP BY 1")
def _(spark, d):
    return project.filter_stratum(fx.lineitem_pairs(spark, d), "cell_type", "AF").groupBy("pair_id").agg(F.count("*").alias("n"))


@register("p4_nonzero_mask", "SELECT pair_id, count(*) AS n FROM lpairs WHERE x <> 0 OR y <> 0 GROUP BY 1")
def _(spark, d):
    return project.nonzero_mask(fx.lineitem_pairs(spark, d)).groupBy("pair_id").agg(F.count("*").alias("n"))


@register("p5_densify", f"SELECT c.cell_id, f.feature, {rd('coalesce(m.value, 0)')} AS value FROM cells c CROSS JOIN feats f LEFT JOIN meas m ON m.cell_id = c.cell_id AND m.feature = f.feature")
def _(spark, d):
    return rounded(project.densify(fx.measurements(spark, d), fx.cells(spark, d), fx.features(spark, d)), "value")


@register("p6_transform_values", f"SELECT cell_id, feature, {rd('ln(1 + value)')} AS value FROM meas")
def _(spark, d):
    return rounded(project.transform_values(fx.measurements(spark, d), "value"), "value").select("cell_id", "feature", "value")


@register("p7_log1p_positive", f"SELECT event_id, {rd('ln(1 + value)')} AS value FROM events WHERE value > 0")
def _(spark, d):
    return rounded(project.log1p_positive(spark.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "value"), "value")


@register(
    "p8_value_flags",
    "SELECT 'l_quantity' AS col, bool_or(l_quantity < 0) AS any_negative, bool_or(abs(l_quantity - round_even(l_quantity, 0)) > 1e-8 + 1e-5 * abs(round_even(l_quantity, 0))) AS any_non_integer FROM lineitem "
    "UNION ALL SELECT 'l_discount', bool_or(l_discount < 0), bool_or(abs(l_discount - round_even(l_discount, 0)) > 1e-8 + 1e-5 * abs(round_even(l_discount, 0))) FROM lineitem",
)
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    a, b = (project.value_flags(li, c).withColumn("col", F.lit(c)) for c in ("l_quantity", "l_discount"))
    return a.unionByName(b).select("col", "any_negative", "any_non_integer")


@register("p9_profile_columns", 'SELECT \'cell_type\' AS "column", cell_type AS value, count(*) AS n FROM cells GROUP BY 2 UNION ALL SELECT \'donor_id\', donor_id, count(*) FROM cells GROUP BY 2')
def _(spark, d):
    return project.profile_columns(fx.cells(spark, d), ["celltype", "cell_type", "donor", "donor_id"])


@register("p10_project", f"{LINE_COUPLING} SELECT feature AS gene, {rd('r')} AS r_protein FROM lc")
def _(spark, d):
    return rounded(project.project(_line_coupling(spark, d), {"feature": "gene", "pearson_r": "r_protein"}), "r_protein")


@register("p11_with_difference", f"{LINE_COUPLING}, {LINE_COUPLING2} SELECT feature, {rd('lc.r')} AS r1, {rd('lc2.r')} AS r2, {rd('lc.r - lc2.r')} AS diff FROM lc JOIN lc2 USING (feature)")
def _(spark, d):
    return rounded(project.with_difference(align.compare_axes(_line_coupling(spark, d), _line_coupling(spark, d, True)), "r1", "r2"), "r1", "r2", "diff")


@register("p12_strip_suffix", "SELECT p_partkey, p_brand AS label FROM part")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_brand", F.lit("_x1")).alias("label"))
    return project.strip_suffix(p, "label")


@register("p13_to_wide", f"{_by('donor_id')} SELECT pair_id, " + ", ".join(f"{rd(f'max(CASE WHEN stratum = {chr(39)}D{i}{chr(39)} THEN r END)')} AS D{i}" for i in range(7)) + " FROM bs GROUP BY pair_id")
def _(spark, d):
    strata = [f"D{i}" for i in range(7)]
    return rounded(project.to_wide(_by_stratum(spark, d), strata), *strata)


@register("p14_to_long", f"{_by('cell_type')}, k AS (SELECT DISTINCT pair_id FROM bs), t AS (SELECT 'T' || i AS stratum FROM range(10) r(i)) SELECT k.pair_id, t.stratum, {rd('bs.r')} AS pearson_r FROM k CROSS JOIN t LEFT JOIN bs ON bs.pair_id = k.pair_id AND bs.stratum = t.stratum")
def _(spark, d):
    return rounded(project.to_long(project.to_wide(_by_stratum(spark, d, "cell_type"), [f"T{i}" for i in range(10)])), "pearson_r")


@register("p15_heatmap_cells", f"{_by('donor_id')} SELECT pair_id, stratum, {rd('CASE WHEN r IS NOT NULL THEN greatest(least(r, 0.05), -0.1) END')} AS shown FROM bs")
def _(spark, d):
    return rounded(project.heatmap_cells(_by_stratum(spark, d), -0.1, 0.05), "shown")


# -- joins and alignment -----------------------------------------------------------


def _resolved(spark, d):
    return align.resolve_labels(fx.labels(spark, d), fx.lookup(spark), fx.targets(spark))


@register("j1_resolve_labels", "SELECT label, feature, how FROM resolved")
def _(spark, d):
    return _resolved(spark, d)


@register("j2_common_features", "SELECT c_custkey AS feature FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def _(spark, d):
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("feature"))
    return align.common_features(a, spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("feature")))


@register("j3_align_pairs", f"SELECT cell_id, pair_id, feature, {rd('x')} AS x, {rd('y')} AS y FROM pairs")
def _(spark, d):
    return rounded(_pairs(spark, d), "x", "y")


@register("j3_align_bucketed", f"SELECT cell_type, cell_id, pair_id, feature, {rd('x')} AS x, {rd('y')} AS y FROM pairs JOIN cells USING (cell_id)")
def _(spark, d):
    # both modalities and the annotations in the same buckets: neither the outer join nor the one with cells shuffles
    m, f = fx.measurements(spark, d), fx.features(spark, d)
    own = uuid.uuid4().hex
    x, y = (src.write_bucketed(project.split_modality(m, f, kind), f"bucketed_{kind}_{own}", BUCKETS) for kind in ("GEX", "ADT"))
    both = align.align_bucketed(x, y, fx.pair_names(spark, d), f"bucketed_pairs_{own}", BUCKETS)
    c = src.write_bucketed(fx.cells(spark, d), f"bucketed_cells_{own}", BUCKETS)
    return rounded(align.attach_cells(both, c, ["cell_type"]), "x", "y").select("cell_type", "cell_id", "pair_id", "feature", "x", "y")


@register("j4_attach_cells", "SELECT cell_type, donor_id, pair_id, count(*) AS n FROM pairs JOIN cells USING (cell_id) GROUP BY ALL")
def _(spark, d):
    return align.attach_cells(_pairs(spark, d), fx.cells(spark, d), ["cell_type", "donor_id"]).groupBy("cell_type", "donor_id", "pair_id").agg(F.count("*").alias("n"))


@register("j5_unmatched", "SELECT label FROM resolved WHERE feature IS NULL ORDER BY label")
def _(spark, d):
    return align.unmatched(fx.labels(spark, d), _resolved(spark, d))


@register("j6_match_coverage", "SELECT count(*) AS total, count(feature) AS matched, count(*) - count(feature) AS unmatched FROM resolved")
def _(spark, d):
    return align.match_coverage(fx.labels(spark, d), _resolved(spark, d))


@register("j7_id_overlap", "SELECT count(*) AS n_common FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)")
def _(spark, d):
    a = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("cell_id"))
    return align.id_overlap(a, spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cell_id")))


@register("j8_ids_identical", "SELECT bool_and(o_orderkey = CASE WHEN o_orderkey = 3 THEN -1 ELSE o_orderkey END) AS identical FROM orders")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("cell_id"))
    return align.ids_identical(o, o.withColumn("cell_id", F.when(F.col("cell_id") == 3, -1).otherwise(F.col("cell_id"))), "pos")


@register("j9_assert_aligned", "SELECT (SELECT count(*) FROM cells) AS n_x, (SELECT count(DISTINCT cell_id) FROM cells WHERE donor_id <> 'D3') AS n_y, (SELECT count(*) FROM cells WHERE donor_id = 'D3') AS only_x, 0::BIGINT AS only_y, (SELECT count(*) FROM cells WHERE donor_id = 'D3') = 0 AS aligned")
def _(spark, d):
    c = fx.cells(spark, d)
    return align.assert_aligned(c, c.where("donor_id <> 'D3'"), ("cell_id",))


@register("j10_compare_axes", f"{LINE_COUPLING}, {LINE_COUPLING2} SELECT feature, {rd('lc.r')} AS r1, {rd('lc2.r')} AS r2 FROM lc JOIN lc2 USING (feature)")
def _(spark, d):
    return rounded(align.compare_axes(_line_coupling(spark, d), _line_coupling(spark, d, True)), "r1", "r2")


#: Masked rows asked for on the second axis of the overlap, so that some features stand on the first alone.
MIN_SECOND = 600


@register("j11_axis_overlap", f"{LINE_COUPLING}, {LINE_COUPLING2}, o AS (SELECT * FROM lc2 WHERE n_cells >= {MIN_SECOND}) SELECT (SELECT count(*) FROM lc) AS n_first, (SELECT count(*) FROM o) AS n_second, (SELECT count(*) FROM lc JOIN o USING (feature)) AS n_both")
def _(spark, d):
    second = coupling.per_feature_pearson(fx.lineitem_pairs(spark, d, "l_quantity", "l_extendedprice"), MIN_SECOND)
    return align.axis_overlap(_line_coupling(spark, d), second)


RIDGE = """
v AS (SELECT c.cell_id, c.cell_type, max(CASE WHEN pos = 0 THEN value END) AS x1, max(CASE WHEN pos = 1 THEN value END) AS x2,
             max(CASE WHEN pos = 32 THEN value END) AS y1, max(CASE WHEN pos = 33 THEN value END) AS y2 FROM cells c JOIN long USING (cell_id) GROUP BY 1, 2),
g AS (SELECT regr_sxx(x1, x1) + 1 AS a, regr_sxy(x1, x2) AS b, regr_sxx(x2, x2) + 1 AS c, regr_sxy(y1, x1) AS p1, regr_sxy(y1, x2) AS p2, regr_sxy(y2, x1) AS q1, regr_sxy(y2, x2) AS q2,
             avg(x1) AS m1, avg(x2) AS m2, avg(y1) AS n1, avg(y2) AS n2 FROM v),
w AS (SELECT *, (c * p1 - b * p2) / (a * c - b * b) AS w11, (a * p2 - b * p1) / (a * c - b * b) AS w12, (c * q1 - b * q2) / (a * c - b * b) AS w21, (a * q2 - b * q1) / (a * c - b * b) AS w22 FROM g),
f AS (SELECT cell_id, cell_type, y1, y2, n1 + w11 * (x1 - m1) + w12 * (x2 - m2) AS e1, n2 + w21 * (x1 - m1) + w22 * (x2 - m2) AS e2 FROM v, w),
dev AS (SELECT cell_id, cell_type, (abs(y1 - e1) + abs(y2 - e2)) / 2 AS s FROM f)"""


#: The same fit for all 32 predictors and targets: moments, then elimination of one column in each step.
WIDE = f"""
RECURSIVE mu AS (SELECT pos, avg(value) AS m FROM long GROUP BY pos),
dv AS (SELECT cell_id, pos, value - m AS v FROM long JOIN mu USING (pos)),
gr AS (SELECT a.pos AS i, list(s + CASE WHEN a.pos = pos2 THEN 1 ELSE 0 END ORDER BY pos2) AS r FROM (
         SELECT a.pos, b.pos AS pos2, sum(a.v * b.v) AS s FROM dv a JOIN dv b USING (cell_id) WHERE a.pos < 32 GROUP BY 1, 2) a GROUP BY 1),
el(k, m) AS (SELECT 1, (SELECT list(r ORDER BY i) FROM gr) UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM el WHERE k <= 32),
ws AS (SELECT i, j, m[i + 1][j + 33] AS w FROM (SELECT m FROM el WHERE k = 33), range(32) a(i), range(32) b(j)),
ic AS (SELECT j, any_value(y.m) - sum(w * x.m) AS b FROM ws JOIN mu x ON x.pos = i JOIN mu y ON y.pos = j + 32 GROUP BY j),
f AS (SELECT x.cell_id, j, sum(x.value * w) + any_value(b) AS e FROM long x JOIN ws ON x.pos = i JOIN ic USING (j) GROUP BY 1, 2),
dev AS (SELECT c.cell_id, c.cell_type, avg(abs(y.value - e)) AS s FROM f JOIN long y ON y.cell_id = f.cell_id AND y.pos = j + 32 JOIN cells c ON c.cell_id = f.cell_id GROUP BY 1, 2)"""


def _ridge(spark, d, p: int = 2, q: int = 2, first: int = 1):
    """Rows and the fit of the first p and q features; names are cut to what follows their first letters."""
    place = F.substring("feature", 2, 9).cast("int")
    named = lambda df: df.withColumn("feature", F.substring("feature", first, 9))
    have = fx.features(spark, d)
    side = lambda kind, n: have.where((F.col("feature_type") == kind) & (place < n)).withColumn("place", place)
    to = deviation.layout(named(side("GEX", p)), named(side("ADT", q)), "place")
    rows, _ = saved(deviation.vectors(named(fx.measurements(spark, d)), fx.cells(spark, d), to), "vectors")
    return rows, deviation.fit_ridge(rows, to.p, to.q)


def _deviation(spark, d, *args):
    return deviation.deviation_score(*_ridge(spark, d, *args)).join(fx.cells(spark, d).select("cell_id", "cell_type"), "cell_id")


@register("j12_predict", f"{RIDGE} SELECT cell_id, {rd('e1')} AS yhat1, {rd('e2')} AS yhat2 FROM f")
def _(spark, d):
    out = deviation.predict(*_ridge(spark, d))
    return rounded(out.select("cell_id", F.get("yhat", F.lit(0)).alias("yhat1"), F.get("yhat", F.lit(1)).alias("yhat2")), "yhat1", "yhat2")


@register("j12_predict_wide", f"{WIDE} SELECT cell_id, 'p' || j AS target, {rd('e')} AS yhat FROM f")
def _(spark, d):
    out = deviation.predict(*_ridge(spark, d, fx.WIDTH, fx.WIDTH)).select("cell_id", "j", F.posexplode("yhat").alias("at", "yhat"))
    return rounded(out.select("cell_id", F.concat(F.lit("p"), F.col("j") * deviation.BLOCK + F.col("at")).alias("target"), "yhat"), "yhat")


# -- aggregations and statistics ---------------------------------------------------


@register("a1_feature_pearson", f"SELECT pair_id, any_value(feature) AS feature, {rd(_r())} AS pearson_r, count(*) AS n_cells FROM pairs GROUP BY 1 HAVING count(*) >= 50")
def _(spark, d):
    return rounded(coupling.per_feature_pearson(_pairs(spark, d)), "pearson_r")


@register("a1_line_pearson", f"{LINE_COUPLING} SELECT pair_id, feature, {rd('r')} AS pearson_r, n_cells FROM lc")
def _(spark, d):
    return rounded(_line_coupling(spark, d), "pearson_r")


@register("a2_t_statistic", f"{LINE_COUPLING} SELECT pair_id, {rd('r * sqrt((n_cells - 2) / (1 - r * r))')} AS t FROM lc")
def _(spark, d):
    return rounded(_line_coupling(spark, d).select("pair_id", t_statistic(F.col("pearson_r"), F.col("n_cells")).alias("t")), "t")


#: I(1 - r^2; a, 1/2) with the library's gamma function and a fold over the terms of the continued fraction.
P_VALUE = f"""
{LINE_COUPLING},
pa AS (SELECT *, (n_cells - 2) / 2.0::DOUBLE AS a, 1 - r * r AS x FROM lc),
ps AS (SELECT *, CASE WHEN x > (a + 1) / (a + 2.5) THEN 0.5::DOUBLE ELSE a END AS p, CASE WHEN x > (a + 1) / (a + 2.5) THEN a ELSE 0.5::DOUBLE END AS q,
              CASE WHEN x > (a + 1) / (a + 2.5) THEN r * r ELSE x END AS z FROM pa),
pf AS (SELECT *, list_reduce(list_reverse(range(1, 401)), lambda f, m: 1 + CASE WHEN m % 2 = 0
                   THEN (m // 2) * (q - m // 2) * z / ((p + 2 * (m // 2) - 1) * (p + 2 * (m // 2)))
                   ELSE -(p + m // 2) * (p + q + m // 2) * z / ((p + 2 * (m // 2)) * (p + 2 * (m // 2) + 1)) END / f, 1.0::DOUBLE) AS frac FROM ps),
pv AS (SELECT pair_id, feature, r, n_cells, exp(p * ln(z) + q * ln(1 - z) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p / frac AS part, x > (a + 1) / (a + 2.5) AS swap FROM pf)"""


@register("a2_p_value", f"{P_VALUE} SELECT pair_id, feature, {rd('r')} AS pearson_r, n_cells, {rd('CASE WHEN swap THEN 1 - part ELSE part END')} AS p_value FROM pv")
def _(spark, d):
    return rounded(coupling.per_feature_pearson(fx.lineitem_pairs(spark, d), p_value=True), "pearson_r", "p_value")


@register("a3_by_cell_type", f"{_by('cell_type')} SELECT pair_id, stratum, feature, {rd('r')} AS pearson_r, n_cells FROM bs")
def _(spark, d):
    return rounded(_by_stratum(spark, d, "cell_type"), "pearson_r")


@register("a4_by_donor", f"{_by('donor_id')} SELECT pair_id, stratum, feature, {rd('r')} AS pearson_r, n_cells FROM bs")
def _(spark, d):
    return rounded(_by_stratum(spark, d), "pearson_r")


@register(
    "a1_a3_a4_one_scan",
    f"pm AS (SELECT pair_id, feature, x, y, cell_type, donor_id FROM pairs JOIN cells USING (cell_id)), "
    f"u AS (SELECT 'all' AS axis, NULL AS stratum, * EXCLUDE (cell_type, donor_id) FROM pm UNION ALL SELECT 'cell_type', cell_type, * EXCLUDE (cell_type, donor_id) FROM pm WHERE cell_type IN (SELECT cell_type FROM cells GROUP BY 1 HAVING count(*) >= {MIN_STRATUM}) "
    f"UNION ALL SELECT 'donor_id', donor_id, * EXCLUDE (cell_type, donor_id) FROM pm WHERE donor_id IN (SELECT donor_id FROM cells GROUP BY 1 HAVING count(*) >= {MIN_STRATUM})) "
    f"SELECT axis, stratum, pair_id, any_value(feature) AS feature, {rd(_r())} AS pearson_r, count(*) AS n_cells FROM u GROUP BY axis, stratum, pair_id HAVING count(*) >= {MIN_CELLS}",
)
def _(spark, d):
    return rounded(coupling.coupling_in_one_scan(_pairs(spark, d), fx.cells(spark, d), min_stratum=MIN_STRATUM, min_cells=MIN_CELLS), "pearson_r")


@register("a5_stratum_sizes", "SELECT cell_type AS stratum, count(*) AS n, count(*) >= 50 AS kept FROM cells GROUP BY 1")
def _(spark, d):
    return coupling.stratum_sizes(fx.cells(spark, d), "cell_type", 50)


@register("a6_coupling_summary", f"{LINE_COUPLING} SELECT {rd('median(r)')} AS median_r, {rd('avg(r)')} AS mean_r, count(*) AS n FROM lc")
def _(spark, d):
    return rounded(coupling.coupling_summary(_line_coupling(spark, d)), "median_r", "mean_r")


@register("a7_variability", f"{_by('donor_id')} SELECT pair_id, any_value(feature) AS feature, {rd('avg(r)')} AS mean_r, {rd('var_samp(r)')} AS variance FROM bs GROUP BY 1")
def _(spark, d):
    return rounded(coupling.coupling_variability(_by_stratum(spark, d)), "mean_r", "variance")


CONSISTENCY = f"{_by('donor_id')}, m AS (SELECT a.stratum AS s1, b.stratum AS s2, {_r('a.r', 'b.r')} AS r, count(*) AS n_shared FROM bs a JOIN bs b USING (pair_id) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2)"


@register("a8_consistency", f"{CONSISTENCY} SELECT s1, s2, {rd('r')} AS r, n_shared FROM m")
def _(spark, d):
    return rounded(coupling.stratum_consistency(_by_stratum(spark, d)), "r")


@register(
    "a8_consistency_months",
    f"bm AS (SELECT l_suppkey AS pair_id, strftime(l_shipdate, '%Y-%m') AS stratum, {_r('l_discount', 'l_tax')} AS r FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3), "
    f"m AS (SELECT a.stratum AS s1, b.stratum AS s2, {_r('a.r', 'b.r')} AS r, count(*) AS n_shared FROM bm a JOIN bm b USING (pair_id) WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2) SELECT s1, s2, {rd('r')} AS r, n_shared FROM m",
)
def _(spark, d):
    # some 84 strata, many of which lack a feature
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("pair_id"), F.date_format("l_shipdate", "yyyy-MM").alias("stratum"))
    by = li.agg(pearson("l_discount", "l_tax").alias("pearson_r"), F.count("*").alias("n")).where("n >= 3")
    return rounded(coupling.stratum_consistency(by), "r")


@register("a9_mean_consistency", f"{CONSISTENCY} SELECT CASE WHEN count(r) = count(*) THEN {rd('avg(r)')} END AS mean_r, count(*) AS n_pairs FROM m WHERE s1 < s2")
def _(spark, d):
    return rounded(coupling.mean_consistency(coupling.stratum_consistency(_by_stratum(spark, d))), "mean_r")


@register("a10_fit_ridge", f"{RIDGE} SELECT 'y1' AS target, {rd('w11')} AS w1, {rd('w12')} AS w2, {rd('n1 - w11 * m1 - w12 * m2')} AS b FROM w UNION ALL SELECT 'y2', {rd('w21')}, {rd('w22')}, {rd('n2 - w21 * m1 - w22 * m2')} FROM w")
def _(spark, d):
    _, fit = _ridge(spark, d)
    w = fit.coefficients().groupBy("target").agg(*[F.max(F.when(F.col("predictor") == i, F.col("weight"))).alias(f"w{i + 1}") for i in range(2)])
    return rounded(w.join(fit.intercepts(), "target").withColumn("target", F.concat(F.lit("y"), F.col("target") + 1)), "w1", "w2", "b")


@register("a10_fit_ridge_wide", f"{WIDE} SELECT 'p' || j AS target, 'f' || i AS predictor, {rd('w')} AS weight, {rd('b')} AS b FROM ws JOIN ic USING (j)")
def _(spark, d):
    _, fit = _ridge(spark, d, fx.WIDTH, fx.WIDTH)
    out = fit.coefficients().join(fit.intercepts(), "target")
    return rounded(out.select(F.concat(F.lit("p"), "target").alias("target"), F.concat(F.lit("f"), "predictor").alias("predictor"), "weight", "b"), "weight", "b")


@register("a11_deviation", f"{RIDGE} SELECT cell_id, cell_type, {rd('s')} AS deviation_score FROM dev")
def _(spark, d):
    return rounded(_deviation(spark, d), "deviation_score")


@register("a11_deviation_wide", f"{WIDE} SELECT cell_id, {rd('s')} AS deviation_score FROM dev")
def _(spark, d):
    return rounded(deviation.deviation_score(*_ridge(spark, d, fx.WIDTH, fx.WIDTH)), "deviation_score")


@register("a11_deviation_shared_names", f"{WIDE} SELECT cell_id, {rd('s')} AS deviation_score FROM dev")
def _(spark, d):
    # without their first letter all names stand in both types: a predictor in one, a target in the other
    return rounded(deviation.deviation_score(*_ridge(spark, d, fx.WIDTH, fx.WIDTH, 2)), "deviation_score")


@register("a12_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return profile.value_counts(spark.read.parquet(f"{d}/events.parquet"), "event_type")


@register("a13_distinct_values", "SELECT DISTINCT cell_type FROM lpairs")
def _(spark, d):
    return profile.distinct_values(fx.lineitem_pairs(spark, d), "cell_type")


def _total(spark, d) -> int:
    return fx.cells(spark, d).count() * 64


@register("a14_value_profile", f"SELECT {rd('min(value)')} AS min, {rd('max(value)')} AS max, {rd('avg(value)')} AS mean FROM long")
def _(spark, d):
    return rounded(profile.value_profile(fx.measurements(spark, d), "value", _total(spark, d)), "min", "max", "mean")


@register("a15_sparsity_profile", f"SELECT {rd('median(value)')} AS median, {rd('100.0 * count(*) FILTER (value = 0) / count(*)')} AS pct_zeros FROM long")
def _(spark, d):
    return rounded(profile.sparsity_profile(fx.measurements(spark, d), "value", _total(spark, d)), "median", "pct_zeros")


@register("a15_median_of_prices", f"SELECT {rd('median(l_extendedprice)')} AS median, 0.0::DOUBLE AS pct_zeros FROM lineitem")
def _(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(profile.sparsity_profile(li, "l_extendedprice", li.count()), "median", "pct_zeros")


@register("a15_quantiles", f"q AS (SELECT quantile_cont(l_extendedprice, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]) AS v FROM lineitem) SELECT CAST([0.0, 0.1, 0.25, 0.5, 0.9, 1.0][i] AS DOUBLE) AS share, {rd('v[i]')} AS value FROM q, range(1, 7) r(i)")
def _(spark, d):
    return rounded(select.quantiles(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]), "value")


@register("a16_skewness_sparse", f"SELECT {rd('skewness(value)')} AS skew FROM long WHERE pos = 3")
def _(spark, d):
    # only the non-zero values of the feature; the zeros are added in closed form
    one = project.select_features(fx.measurements(spark, d), fx.features(spark, d).where("feature = 'f3'"))
    return rounded(profile.skew_corrected(one, "value", fx.cells(spark, d).count()), "skew")


@register("a16_skewness", f"SELECT {rd('skewness(value)')} AS skew FROM long WHERE pos = 3")
def _(spark, d):
    one = fx.features(spark, d).where("feature = 'f3'")
    dense = project.densify(project.select_features(fx.measurements(spark, d), one), fx.cells(spark, d), one)
    return rounded(profile.skew_corrected(dense, "value"), "skew")


@register("a17_totals", f"SELECT cell_id, {rd('sum(value)')} AS total FROM long GROUP BY 1")
def _(spark, d):
    return rounded(profile.totals_per_cell(fx.measurements(spark, d), fx.cells(spark, d)), "total")


@register("a18_zero_fraction", f"SELECT cell_id, {rd('1 - count(*) FILTER (value <> 0) / 64.0::DOUBLE')} AS zero_fraction FROM long GROUP BY 1")
def _(spark, d):
    return rounded(profile.zero_fraction_per_cell(fx.measurements(spark, d), fx.cells(spark, d), 64), "zero_fraction")


@register("a19_scalar_correlation", f"t AS (SELECT cell_id, sum(CASE WHEN pos < 32 THEN ln(1 + value) ELSE 0 END) AS a, sum(CASE WHEN pos >= 32 THEN value ELSE 0 END) AS b FROM long GROUP BY 1) SELECT {rd(_r('a', 'b'))} AS r, count(*) AS n FROM t")
def _(spark, d):
    m, c, f = fx.measurements(spark, d), fx.cells(spark, d), fx.features(spark, d)
    gex = project.transform_values(project.split_modality(m, f, "GEX"), "value")
    a, b = profile.totals_per_cell(gex, c, name="a"), profile.totals_per_cell(project.split_modality(m, f, "ADT"), c, name="b")
    return rounded(coupling.scalar_correlation(a.join(b, "cell_id"), "a", "b"), "r")


@register("a20_correlation_of_couplings", f"{LINE_COUPLING}, {LINE_COUPLING2} SELECT {rd(_r('lc.r', 'lc2.r'))} AS r, count(*) AS n FROM lc JOIN lc2 USING (feature)")
def _(spark, d):
    return rounded(coupling.correlation_of_couplings(align.compare_axes(_line_coupling(spark, d), _line_coupling(spark, d, True))), "r")


@register("a21_deviation_overview", f"{RIDGE} SELECT {rd('avg(s)')} AS mean, {rd('stddev_pop(s)')} AS std FROM dev")
def _(spark, d):
    return rounded(deviation.deviation_overview(_deviation(spark, d)), "mean", "std")


@register("a21_deviation_overview_wide", f"{WIDE} SELECT {rd('avg(s)')} AS mean, {rd('stddev_pop(s)')} AS std FROM dev")
def _(spark, d):
    return rounded(deviation.deviation_overview(_deviation(spark, d, fx.WIDTH, fx.WIDTH)), "mean", "std")


@register("a22_deviation_by_type", f"{RIDGE} SELECT cell_type, {rd('avg(s)')} AS mean, {rd('stddev_samp(s)')} AS std, count(*) AS \"count\" FROM dev GROUP BY 1 HAVING count(*) >= 50")
def _(spark, d):
    return rounded(deviation.deviation_by_stratum(_deviation(spark, d)), "mean", "std")


@register("a22_deviation_by_type_wide", f"{WIDE} SELECT cell_type, {rd('avg(s)')} AS mean, {rd('stddev_samp(s)')} AS std, count(*) AS \"count\" FROM dev GROUP BY 1 HAVING count(*) >= 50")
def _(spark, d):
    return rounded(deviation.deviation_by_stratum(_deviation(spark, d, fx.WIDTH, fx.WIDTH)), "mean", "std")


@register(
    "a23_histogram",
    f"e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), k AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 40)) AS INT), 39) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1) "
    f"SELECT CAST(i AS INT) AS bin, {rd('lo + i * ((hi - lo) / 40)')} AS lo, {rd('lo + (i + 1) * ((hi - lo) / 40)')} AS hi, coalesce(n, 0) AS n FROM e, range(40) r(i) LEFT JOIN k ON k.bin = i",
)
def _(spark, d):
    return rounded(profile.histogram(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", 40), "lo", "hi")


@register("a24_result_shape", f"{_by('donor_id')} SELECT count(DISTINCT pair_id) AS n_features, count(DISTINCT stratum) AS n_strata FROM bs")
def _(spark, d):
    return coupling.result_shape(_by_stratum(spark, d))


# -- sorts, limits, top-k ----------------------------------------------------------


@register("t1_rank_by_r", f"{LINE_COUPLING} SELECT pair_id, {rd('r')} AS pearson_r FROM lc")
def _(spark, d):
    return rounded(rank.rank_by_r(_line_coupling(spark, d)).select("pair_id", "pearson_r"), "pearson_r")


@register("t2_top_coupled", f"{LINE_COUPLING} SELECT pair_id, feature, {rd('r')} AS pearson_r, n_cells FROM lc ORDER BY r DESC NULLS LAST, pair_id LIMIT 20")
def _(spark, d):
    return rounded(rank.top_k(_line_coupling(spark, d), 20, ["pearson_r"]), "pearson_r")


@register("t3_bottom_coupled", f"{LINE_COUPLING} SELECT pair_id, {rd('r')} AS pearson_r FROM lc ORDER BY r ASC NULLS FIRST, pair_id DESC LIMIT 20")
def _(spark, d):
    return rounded(rank.bottom_k(_line_coupling(spark, d), 20).select("pair_id", "pearson_r"), "pearson_r")


@register("t4_top_both", f"{LINE_COUPLING}, {LINE_COUPLING2} SELECT feature, {rd('lc.r')} AS r1, {rd('lc2.r')} AS r2 FROM lc JOIN lc2 USING (feature) ORDER BY lc.r DESC, lc2.r DESC, feature LIMIT 15")
def _(spark, d):
    return rounded(rank.top_k(align.compare_axes(_line_coupling(spark, d), _line_coupling(spark, d, True)), 15, ["r1", "r2"], "feature"), "r1", "r2")


@register(
    "t5_axis_specific",
    f"{LINE_COUPLING}, {LINE_COUPLING2}, k AS (SELECT feature, lc.r AS r1, lc2.r AS r2, lc.r - lc2.r AS diff FROM lc JOIN lc2 USING (feature)), u AS ((SELECT *, 'first' AS direction FROM k ORDER BY diff DESC, feature LIMIT 10) UNION ALL (SELECT *, 'second' FROM k ORDER BY diff, feature LIMIT 10)) "
    f"SELECT feature, {rd('r1')} AS r1, {rd('r2')} AS r2, {rd('diff')} AS diff, direction FROM u",
)
def _(spark, d):
    return rounded(rank.axis_specific(align.compare_axes(_line_coupling(spark, d), _line_coupling(spark, d, True)), 10), "r1", "r2", "diff")


@register(
    "t6_variability_extremes",
    f"{_by('donor_id')}, k AS (SELECT pair_id, any_value(feature) AS feature, avg(r) AS mean_r, var_samp(r) AS variance FROM bs GROUP BY 1), u AS ((SELECT *, 'most' AS \"end\" FROM k ORDER BY variance DESC NULLS LAST, pair_id LIMIT 5) UNION ALL (SELECT *, 'least' FROM k ORDER BY variance NULLS LAST, pair_id LIMIT 5)) "
    f'SELECT pair_id, feature, {rd("mean_r")} AS mean_r, {rd("variance")} AS variance, "end" FROM u',
)
def _(spark, d):
    return rounded(rank.variability_extremes(coupling.coupling_variability(_by_stratum(spark, d)), 5), "mean_r", "variance")


@register("t7_first_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return rank.first_n(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey"), 100, ["o_orderkey"])


@register("t8_sorted_names", "SELECT feature FROM feats ORDER BY feature")
def _(spark, d):
    return rank.sorted_names(fx.features(spark, d))
