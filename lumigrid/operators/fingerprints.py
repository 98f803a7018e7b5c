"""Sparse fingerprints as long tables (id, cell, val): norms, spreading, kernels, sparsifying, merging, statistics.

A fingerprint of a G x G grid has at most G * G rows; every operator groups by (id, cell) or by id, so the work
follows the active cells and nothing is dense but what a kernel makes so.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grid


def from_arrays(vectors: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """(id, cell, val) of the positive places of vectors."""
    exploded = vectors.select(F.col(id_col).alias("id"), F.posexplode(array_col).alias("cell", "val"))
    return exploded.where("val > 0").select("id", "cell", F.col("val").cast("double").alias("val"))


def norms(fingerprints: DataFrame) -> DataFrame:
    """(id, nnz, l1, l2, top) of each fingerprint."""
    v = F.col("val")
    return fingerprints.groupBy("id").agg(F.count("*").alias("nnz"), F.sum(F.abs(v)).alias("l1"), F.sqrt(F.sum(v * v)).alias("l2"), F.max(v).alias("top"))


def normalised(fingerprints: DataFrame, how: str = "l2") -> DataFrame:
    """Fingerprints of unit l2 or l1 norm, or of ones; a zero norm leaves them as they are."""
    own = Window.partitionBy("id")
    v = F.col("val")
    if how == "binary":
        return fingerprints.withColumn("val", F.when(v != 0, 1.0).otherwise(0.0))
    if how not in ("l2", "l1"):
        raise ValueError(f"unknown normalisation {how}")
    norm = F.sqrt(F.sum(v * v).over(own)) if how == "l2" else F.sum(F.abs(v)).over(own)
    return fingerprints.withColumn("norm", norm).select("id", "cell", F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(v).alias("val"))


def spread(fingerprints: DataFrame, size: int, radius: int = 1, decay: float = 0.5, least_density: float = 0.005, l2: bool = False) -> DataFrame:
    """Each active cell adds val * decay ** distance to its neighbours within a radius, clipped at the border.

    Fingerprints of less than the least density stay as they are.
    """
    spark = fingerprints.sparkSession
    steps = grid.table(spark, [(dx, dy, decay**d if d else 1.0) for dx, dy, d in grid.offsets(radius, centre=True)], "dx int, dy int, weight double")
    dense = fingerprints.withColumn("n", F.count("*").over(Window.partitionBy("id"))).withColumn("go", F.col("n") / (size * size) >= least_density)
    # The offset table has (2 radius + 1) ** 2 rows.
    moved = (
        dense.crossJoin(F.broadcast(steps)).where("go or (dx = 0 and dy = 0)")
        .withColumn("x", grid.morton_x(F.col("cell")) + F.col("dx")).withColumn("y", grid.morton_y(F.col("cell")) + F.col("dy"))
        .where(f"x between 0 and {size - 1} and y between 0 and {size - 1}")
    )
    out = moved.groupBy("id", grid.morton(F.col("x"), F.col("y")).alias("cell")).agg(F.sum(F.col("val") * F.col("weight")).alias("val"))
    return normalised(out) if l2 else out


def convolved(fingerprints: DataFrame, size: int, kernel: list[tuple[int, int, float]]) -> DataFrame:
    """Convolution with a small kernel of (dx, dy, weight), mirrored at the border."""
    spark = fingerprints.sparkSession
    steps = grid.table(spark, kernel, "dx int, dy int, weight double")
    radius = max(max(abs(dx), abs(dy)) for dx, dy, _ in kernel)
    # A target t takes weight * source at the mirrored place t + d: a source reaches every t whose mirror it is.
    mirror = [(t, d, t + d if 0 <= t + d < size else -1) for t in range(size) for d in range(-radius, radius + 1)]
    fold = [(t, d, p if p >= 0 else (q if (q := (t + d) % (2 * size)) < size else 2 * size - 1 - q)) for t, d, p in mirror]
    places = grid.table(spark, fold, "t int, d int, s int")
    # size * (2 radius + 1) rows.
    xs, ys = (F.broadcast(places.select(F.col("t").alias(f"t{c}"), F.col("d").alias(f"d{c}"), F.col("s").alias(f"s{c}"))) for c in "xy")
    sources = fingerprints.withColumn("x", grid.morton_x(F.col("cell"))).withColumn("y", grid.morton_y(F.col("cell")))
    joined = sources.join(xs, F.col("x") == F.col("sx")).withColumnRenamed("dx", "ox").join(ys, F.col("y") == F.col("sy")).withColumnRenamed("dy", "oy")
    weighed = joined.join(F.broadcast(steps), (F.col("ox") == F.col("dx")) & (F.col("oy") == F.col("dy")))
    return weighed.groupBy("id", grid.morton(F.col("tx"), F.col("ty")).alias("cell")).agg(F.sum(F.col("val") * F.col("weight")).alias("val"))


def geometric(fingerprints: DataFrame, size: int) -> DataFrame:
    """Convolution with the geometric 3x3 kernel."""
    return convolved(fingerprints, size, [(dx, dy, grid.GEOMETRIC[dy + 1][dx + 1]) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])


def blurred(fingerprints: DataFrame, size: int, sigma: float = 1.5) -> DataFrame:
    """Gaussian blur, one axis after the other."""
    weights = grid.gaussian(sigma)
    along_x = convolved(fingerprints, size, [(d, 0, w) for d, w in weights])
    return convolved(along_x, size, [(0, d, w) for d, w in weights])


def multi_resolution(fingerprints: DataFrame, size: int, mix: tuple[tuple[int, float], ...] = ((1, 0.5), (2, 0.3), (3, 0.2)), decay: float = 0.5) -> DataFrame:
    """Spreadings of several radii, each of unit norm, mixed by weights, of unit norm."""
    parts = [spread(fingerprints, size, r, decay, 0.0, l2=True).withColumn("val", F.col("val") * w) for r, w in mix]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return normalised(every.groupBy("id", "cell").agg(F.sum("val").alias("val")))


def contrast(fingerprints: DataFrame, size: int, share: float = 0.5) -> DataFrame:
    """Cells less a share of the mean over all cells of the grid; only what stays positive."""
    mean = F.sum("val").over(Window.partitionBy("id")) / (size * size)
    return fingerprints.withColumn("val", F.col("val") - share * mean).where("val > 0")


def peaks(fingerprints: DataFrame, size: int, distance: int = 1) -> DataFrame:
    """Cells that are the largest of their neighbourhood."""
    spark = fingerprints.sparkSession
    steps = grid.table(spark, [(dx, dy) for dx, dy, _ in grid.offsets(distance, centre=True)], "dx int, dy int")
    reached = (
        fingerprints.crossJoin(F.broadcast(steps))
        .withColumn("x", grid.morton_x(F.col("cell")) + F.col("dx")).withColumn("y", grid.morton_y(F.col("cell")) + F.col("dy"))
        .where(f"x between 0 and {size - 1} and y between 0 and {size - 1}")
        .groupBy("id", grid.morton(F.col("x"), F.col("y")).alias("cell")).agg(F.max("val").alias("most"))
    )
    return fingerprints.join(reached, ["id", "cell"]).where("val = most and val > 0").select("id", "cell", "val")


def strongest(fingerprints: DataFrame, share: float, size: int) -> DataFrame:
    """The max(1, round(share * cells)) largest cells; cells that tie with the last stay."""
    most = max(1, round(share * size * size))
    ranked = fingerprints.withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("val"))))
    return ranked.where(F.col("r") <= most).select("id", "cell", "val")


def sparsified(fingerprints: DataFrame, most: int, by_code: bool = False) -> DataFrame:
    """The `most` cells by value, or the lowest Morton codes."""
    order = [F.col("cell")] if by_code else [F.desc("val"), F.col("cell")]
    ranked = fingerprints.where("val > 0").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.where(F.col("r") <= most).select("id", "cell", "val")


def merged(fingerprints: DataFrame, group: Column, weight: Column) -> DataFrame:
    """The weighted sum of the fingerprints of each group."""
    return fingerprints.groupBy(group.alias("id"), "cell").agg(F.sum(F.col("val") * weight).alias("val"))


def validity(fingerprints: DataFrame, size: int, least: int = 1, most: int | None = None) -> DataFrame:
    """Flags of each fingerprint: cells in the grid, values not negative, active cells in a range."""
    most = size * size if most is None else most
    n = F.count_if(F.col("val") > 0)
    return fingerprints.groupBy("id").agg((F.count_if((F.col("cell") < 0) | (F.col("cell") >= size * size)) == 0).alias("in_grid"), (F.count_if(F.col("val") < 0) == 0).alias("not_negative"), ((n >= least) & (n <= most)).alias("active_in_range"))


def statistics(fingerprints: DataFrame, size: int) -> DataFrame:
    """One row: fingerprints, mean, deviation, least and most active cells, mean sparsity."""
    n = F.col("nnz")
    return norms(fingerprints).agg(F.count("*").alias("n_fingerprints"), F.avg(n).alias("mean_active"), F.stddev_pop(n).alias("sd_active"), F.min(n).alias("min_active"), F.max(n).alias("max_active"), F.avg(1 - n / (size * size)).alias("mean_sparsity"), F.avg("top").alias("mean_top"))


def sdr(fingerprints: DataFrame, size: int, top_share: float = 0.1, distance: int = 1) -> DataFrame:
    """Topological sparsifying: bits are given to peaks by their value; each peak's window keeps its largest cells.

    The bits of the peaks are made to sum to round(top_share * cells) by single steps at the largest peaks;
    windows may overlap, in which case their values add up. Without peaks the strongest cells are kept.
    """
    total = max(1, round(top_share * size * size))

    def one(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((size, size))
        cell = rows["cell"].to_numpy(np.int64)
        x, y = (sum(((cell >> (2 * b + k)) & 1) << b for b in range(16)) for k in (0, 1))
        g[y, x] = rows["val"].to_numpy()
        padded = np.pad(g, distance, mode="symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(padded, (2 * distance + 1, 2 * distance + 1))
        py, px = np.nonzero((g == windows.max(axis=(2, 3))) & (g > 0))
        out = np.zeros_like(g)
        if not len(py):
            cut = np.sort(g.ravel())[-total]
            out[g >= max(cut, 1e-300)] = g[g >= max(cut, 1e-300)]
        else:
            value = g[py, px]
            bits = np.maximum(1, (value / value.sum() * total).astype(int))
            order = np.lexsort((px, py, -value))
            k = 0
            while bits.sum() != total and k < 4 * total:
                at = order[k % len(order)]
                if bits.sum() < total:
                    bits[at] += 1
                elif bits[at] > 1:
                    bits[at] -= 1
                elif (bits == 1).all():
                    break
                k += 1
            for yy, xx, n in zip(py, px, bits, strict=True):
                r = max(2, int(n**0.5))
                part = g[max(0, yy - r) : yy + r + 1, max(0, xx - r) : xx + r + 1]
                cut = np.sort(part.ravel())[-min(n, part.size)]
                out[max(0, yy - r) : yy + r + 1, max(0, xx - r) : xx + r + 1] += np.where((part >= cut) & (part > 0), part, 0)
        oy, ox = np.nonzero(out)
        code = sum((((ox >> b) & 1) << (2 * b)) | (((oy >> b) & 1) << (2 * b + 1)) for b in range(16))
        return pd.DataFrame({"id": rows["id"].iloc[0], "cell": code.astype(np.int64), "val": out[oy, ox]})

    kind = dict(fingerprints.dtypes)["id"]
    return fingerprints.groupBy("id").applyInPandas(one, f"id {kind}, cell bigint, val double")


def diversity(fingerprints: DataFrame) -> DataFrame:
    """One row: pairs of different ids and 1 - their mean cosine (null without a pair).

    All pairs count, and none is made: the cosines of ordered pairs add up to the squared length of the sum of the unit
    vectors, less that of each of them. An id without length has cosine 0 to all.
    """
    sums = normalised(fingerprints).groupBy("cell").agg(F.sum("val").alias("s"), F.sum(F.col("val") * F.col("val")).alias("one")).agg((F.sum(F.col("s") * F.col("s")) - F.sum("one")).alias("all"))
    n = fingerprints.agg(F.count_distinct("id").alias("n"))
    ordered = F.col("n") * (F.col("n") - 1)
    return n.crossJoin(sums).select((ordered / 2).cast("bigint").alias("n_pairs"), F.when(ordered > 0, 1 - F.col("all") / ordered).alias("diversity"))
