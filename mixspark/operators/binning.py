"""Coarser bins of spots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.operators.graph import nearest


def spacing(spots: DataFrame) -> float:
    """The median distance of a spot to the nearest other one; 0 with fewer than two spots."""
    return nearest(spots, 1).agg(F.median(F.sqrt("d2"))).first()[0] or 0.0


def aggregate_bins(spots: DataFrame, width: float) -> DataFrame:
    """spot_id, coords, gx, gy, bin_id: square bins of a width from the least coordinates on; bin_id is the text gx_gy."""
    if not width > 0:
        raise ValueError("the width must be positive")
    low = spots.agg(F.min(F.get("coords", F.lit(0))).alias("x0"), F.min(F.get("coords", F.lit(1))).alias("y0"))
    cell = lambda k, o: F.floor((F.get("coords", F.lit(k)) - F.col(o)) / width)
    out = spots.join(F.broadcast(low)).select("spot_id", "coords", cell(0, "x0").alias("gx"), cell(1, "y0").alias("gy"))
    return out.withColumn("bin_id", F.concat_ws("_", "gx", "gy"))


def bins_of_size(spots: DataFrame, target: int, original: int = 8, apart: float | None = None) -> DataFrame:
    """aggregate_bins for spots that stand for squares of a size: bins of target // original times their spacing (apart, if known).

    Where that factor is 1 every spot is a bin of its own: gx is its id and gy 0.
    """
    factor = target // original
    if factor < 1:
        raise ValueError("the target must be at least the original size")
    if factor == 1:
        own = spots.select("spot_id", "coords", F.col("spot_id").alias("gx"), F.lit(0).cast("long").alias("gy"))
        return own.withColumn("bin_id", F.concat_ws("_", "gx", "gy"))
    return aggregate_bins(spots, (spacing(spots) if apart is None else apart) * factor)


def numbered(bins: DataFrame) -> DataFrame:
    """bins with bin, a number for each pair of gx and gy, different for different pairs."""
    least_x, least_y, most_x, most_y = bins.agg(F.min("gx"), F.min("gy"), F.max("gx"), F.max("gy")).first()
    if least_x is None:
        return bins.withColumn("bin", F.lit(None).cast("long"))
    rows = most_y - least_y + 1
    if (most_x - least_x + 1) * rows > (1 << 63) - 1:
        raise ValueError("more bins than numbers: the width is too small for these coordinates")
    return bins.withColumn("bin", (F.col("gx") - F.lit(least_x)) * F.lit(rows) + (F.col("gy") - F.lit(least_y)))


def binned_spots(bins: DataFrame) -> DataFrame:
    """bin_id, x, y (mean coordinates), n_spots."""
    return bins.groupBy("bin_id").agg(F.avg(F.get("coords", F.lit(0))).alias("x"), F.avg(F.get("coords", F.lit(1))).alias("y"), F.count("*").alias("n_spots"))


def binned_counts(bins: DataFrame, counts: DataFrame) -> DataFrame:
    """bin_id, gene_id, value: sums over the spots of a bin."""
    return counts.join(bins.select("spot_id", "bin_id"), "spot_id").groupBy("bin_id", "gene_id").agg(F.sum("value").alias("value"))
