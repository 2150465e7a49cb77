"""Coupling per feature and per stratum, and what is derived from it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import pearson, pearson_p_value
from .project import nonzero_mask


def per_feature_pearson(pairs: DataFrame, min_cells: int = 50, p_value: bool = False) -> DataFrame:
    """pair_id, feature, pearson_r, n_cells over rows in which x or y is not zero.

    Pairs with fewer than ``min_cells`` such rows are dropped; a constant side leaves the
    row with r null.  One hash aggregation with partial sums.
    """
    out = nonzero_mask(pairs).groupBy("pair_id").agg(F.first("feature").alias("feature"), pearson("x", "y").alias("pearson_r"), F.count("*").alias("n_cells"))
    out = out.where(F.col("n_cells") >= min_cells)
    return out.withColumn("p_value", pearson_p_value("pearson_r", "n_cells")) if p_value else out


def stratum_sizes(cells: DataFrame, col: str, min_stratum: int = 50) -> DataFrame:
    """stratum, n and whether it is kept, counted over all cells."""
    return cells.groupBy(F.col(col).alias("stratum")).agg(F.count("*").alias("n")).withColumn("kept", F.col("n") >= min_stratum)


def coupling_by_stratum(pairs: DataFrame, cells: DataFrame, col: str, min_stratum: int = 50, min_cells: int = 50) -> DataFrame:
    """per_feature_pearson within each stratum that has ``min_stratum`` cells or more.

    Sizes come from all cells; ``min_cells`` counts the masked rows of a pair.
    All strata are aggregated in one pass.
    """
    kept = stratum_sizes(cells, col, min_stratum).where("kept").select(F.col("stratum").alias(col))
    masked = nonzero_mask(pairs).join(cells.select("cell_id", col).join(kept, col, "left_semi"), "cell_id")
    out = masked.groupBy("pair_id", F.col(col).alias("stratum")).agg(F.first("feature").alias("feature"), pearson("x", "y").alias("pearson_r"), F.count("*").alias("n_cells"))
    return out.where(F.col("n_cells") >= min_cells)


def coupling_in_one_scan(pairs: DataFrame, cells: DataFrame, cols: tuple[str, ...] = ("cell_type", "donor_id"), min_stratum: int = 50, min_cells: int = 50) -> DataFrame:
    """per_feature_pearson and coupling_by_stratum of each column of ``cols``, from one read of the pairs.

    Returns axis ('all' or the column's name), stratum (null for 'all'), pair_id, feature, pearson_r and n_cells.
    Cells get the labels of strata that are kept, and the pairs are aggregated by grouping sets over
    (pair), (pair, first column) and so on.  Rows without a label count for 'all' alone.
    """
    labelled = cells.select("cell_id", *[F.col(c).alias(f"_{c}") for c in cols])
    for c in cols:
        kept = stratum_sizes(cells, c, min_stratum).where("kept").select(F.col("stratum").alias(f"_kept_{c}"))
        labelled = labelled.join(kept, F.col(f"_{c}") == F.col(f"_kept_{c}"), "left").drop(f"_{c}")
    rows = nonzero_mask(pairs).select("cell_id", "pair_id", "feature", "x", "y").join(labelled, "cell_id", "left")
    keys = [f"_kept_{c}" for c in cols]
    sets = [[F.col("pair_id")], *[[F.col("pair_id"), F.col(k)] for k in keys]]
    out = rows.groupingSets(sets, "pair_id", *keys).agg(F.grouping_id().alias("_set"), F.first("feature").alias("feature"), pearson("x", "y").alias("pearson_r"), F.count("*").alias("n_cells"))
    bit = lambda i: F.lit(1 << (len(cols) - 1 - i))  # noqa: E731  set in the id where the column is left out
    axis = F.lit("all")
    for i, c in enumerate(cols):
        axis = F.when(F.col("_set").bitwiseAND(bit(i)) == 0, c).otherwise(axis)
    out = out.where(F.col("n_cells") >= min_cells).select(axis.alias("axis"), F.coalesce(*keys).alias("stratum"), "pair_id", "feature", "pearson_r", "n_cells")
    return out.where((F.col("axis") == "all") | F.col("stratum").isNotNull())


def coupling_summary(c: DataFrame) -> DataFrame:
    """Exact median, mean and number of r."""
    return c.agg(F.median("pearson_r").alias("median_r"), F.avg("pearson_r").alias("mean_r"), F.count("*").alias("n"))


def coupling_variability(by_stratum: DataFrame) -> DataFrame:
    """Mean and sample variance of r across strata; the variance of one stratum is null."""
    return by_stratum.groupBy("pair_id").agg(F.first("feature").alias("feature"), F.avg("pearson_r").alias("mean_r"), F.var_samp("pearson_r").alias("variance"))


#: Strata on a side of a block of the consistency matrix, and features that a task makes dense at a time.
STRATA, FEATURES = 512, 4096


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairwise-complete n, sums, squares and products of the columns of x with those of y; NaN is missing."""
    a, b = ~np.isnan(x), ~np.isnan(y)
    u, v = np.where(a, x, 0.0), np.where(b, y, 0.0)
    fa, fb = a.astype(float), b.astype(float)
    return np.stack([fa.T @ fb, u.T @ fb, fa.T @ v, (u * u).T @ fb, fa.T @ (v * v), u.T @ v])


def stratum_consistency(by_stratum: DataFrame) -> DataFrame:
    """s1, s2, r, n_shared: correlation of two strata over the features both hold; pairs that share none are left out.

    Each feature is one row, the array of its r by stratum.  Tasks turn such rows into matrices and add
    up, for each block of STRATA x STRATA pairs, six packed moments; no pair of strata is a row
    before the end.  Missing and NaN r are skipped pair by pair; r is null where fewer than two features
    are shared or one side is constant over them.
    """
    ok = by_stratum.where(F.col("pearson_r").isNotNull() & ~F.isnan("pearson_r")).select("pair_id", "stratum", "pearson_r")
    names = ok.groupBy("stratum").agg(F.avg("pearson_r").alias("mid")).withColumn("k", F.row_number().over(Window.orderBy("stratum")) - 1)
    # values less their stratum's mean, so that squares lose no digits
    rows = ok.join(names, "stratum").groupBy("pair_id").agg(F.collect_list(F.struct("k", (F.col("pearson_r") - F.col("mid")).alias("r"))).alias("e"))
    rows = rows.select(F.col("e.k").alias("k"), F.col("e.r").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, FEATURES):
                b = batch.slice(s, FEATURES)
                k, r = b.column("k").flatten().to_numpy(), b.column("r").flatten().to_numpy()
                row, side = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("k")).to_numpy()), k // STRATA
                dense = {}
                for i in np.unique(side):
                    own, dense[i] = side == i, np.full((b.num_rows, STRATA), np.nan)
                    dense[i][row[own], k[own] % STRATA] = r[own]
                for i in dense:
                    for j in dense:
                        if i <= j:
                            part = _moments(dense[i], dense[j])
                            sums[i, j] = sums[i, j] + part if (i, j) in sums else part
        for (i, j), m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([m.tobytes()], pa.binary())], ["i", "j", "data"])

    def finish(key: tuple, t: pa.Table) -> pa.Table:
        i, j = (x.as_py() for x in key)
        n, sx, sy, xx, yy, xy = sum(np.frombuffer(d.as_buffer()).reshape(6, STRATA, STRATA) for d in t.column("data"))
        a, b = np.nonzero(n)
        n, sx, sy, xx, yy, xy = (m[a, b] for m in (n, sx, sy, xx, yy, xy))
        vx, vy, c = xx - sx * sx / n, yy - sy * sy / n, xy - sx * sy / n
        good = (n > 1) & (vx > 1e-12 * xx) & (vy > 1e-12 * yy)  # less is rounding of a constant
        r = np.clip(c / np.sqrt(np.where(good, vx * vy, 1.0)), -1.0, 1.0)
        out = pa.table({"k1": pa.array((a + i * STRATA).astype(np.int32)), "k2": pa.array((b + j * STRATA).astype(np.int32)), "r": pa.array(r, mask=~good), "n_shared": pa.array(n.astype(np.int64))})
        return out if i == j else pa.concat_tables([out, out.rename_columns(["k2", "k1", "r", "n_shared"]).select(["k1", "k2", "r", "n_shared"])])

    pairs = rows.mapInArrow(run, "i int, j int, data binary").groupBy("i", "j").applyInArrow(finish, "k1 int, k2 int, r double, n_shared long")
    name = lambda k, s: names.select(F.col("k").alias(k), F.col("stratum").alias(s))
    return pairs.join(name("k1", "s1"), "k1").join(name("k2", "s2"), "k2").select("s1", "s2", "r", "n_shared")


def mean_consistency(matrix: DataFrame) -> DataFrame:
    """Mean of the upper triangle, null if any pair is null, and the number of pairs."""
    up = matrix.where(F.col("s1") < F.col("s2"))
    return up.agg(F.when(F.count("r") == F.count("*"), F.avg("r")).alias("mean_r"), F.count("*").alias("n_pairs"))


def scalar_correlation(df: DataFrame, a: str, b: str, p_value: bool = False) -> DataFrame:
    """r and n of two columns over all rows."""
    out = df.agg(pearson(a, b).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"))
    return out.withColumn("p_value", pearson_p_value("r", "n")) if p_value else out


def correlation_of_couplings(compared: DataFrame) -> DataFrame:
    """Correlation across features of what compare_axes() returns."""
    return scalar_correlation(compared, "r1", "r2")


def result_shape(by_stratum: DataFrame) -> DataFrame:
    """n_features, n_strata."""
    return by_stratum.agg(F.countDistinct("pair_id").alias("n_features"), F.countDistinct("stratum").alias("n_strata"))
