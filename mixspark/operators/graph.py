"""Neighbour graphs by joins on grid cells, and what is computed on their edges.

edges: i, j in both directions, distinct. A cell is as wide as the radius, so all points within
it lie in a point's cell or the ones next to it.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixspark.functions.lineage import cut

#: Points of a cell, for each neighbour that is looked for, at most in the first search.
MOST = 16
#: Points of a cell that meet those around it in one group, about, where a cell may hold any number.
PER_GROUP = 4000


def _dimension(spots: DataFrame) -> int:
    """Length of the coordinates, which must be the same for all spots, and 1 at least."""
    low, high, missing = spots.agg(F.min(F.size("coords")), F.max(F.size("coords")), F.count_if(F.col("coords").isNull())).first()
    if missing or low != high:
        raise ValueError("coordinates must have one dimension for all spots")
    if low is not None and low < 1:
        raise ValueError("coordinates need a dimension at least")
    return low or 2


def within(left: DataFrame, right: DataFrame, radius: float, dim: int, per_group: int | None = None) -> DataFrame:
    """i, j, d2 of all pairs of different points at most radius apart (inclusive).

    per_group: cells of more points of the right side are dealt to groups of about so many, which all meet the left side's.
    """
    cell = lambda c, o=0: F.floor(c / F.lit(radius)) + o
    a = left.select(F.col("spot_id").alias("i"), F.col("coords").alias("a"))
    b = right.select(F.col("spot_id").alias("j"), F.col("coords").alias("b"))
    shifts = F.array(*[F.array(*[F.lit(o).cast("long") for o in s]) for s in product((-1, 0, 1), repeat=dim)])
    a = a.select("i", "a", F.explode(shifts).alias("s")).select("i", "a", *[(cell(F.get("a", F.lit(k))) + F.get("s", F.lit(k))).alias(f"c{k}") for k in range(dim)])
    b = b.select("j", "b", *[cell(F.get("b", F.lit(k))).alias(f"c{k}") for k in range(dim)])
    d2 = sum((F.pow(F.get("a", F.lit(k)) - F.get("b", F.lit(k)), 2) for k in range(dim)), F.lit(0.0))
    keys = [f"c{k}" for k in range(dim)]
    if per_group is not None:
        # One row for each cell that is dealt, of which there are as many as groups at most.
        groups = F.broadcast(b.groupBy(*keys).count().where(F.col("count") > per_group).select(*keys, F.ceil(F.col("count") / per_group).alias("groups")))
        several = F.coalesce("groups", F.lit(1))
        a = a.join(groups, keys, "left").select("i", "a", *keys, F.explode(F.sequence(F.lit(0).cast("long"), several - 1)).alias("group"))
        b = b.join(groups, keys, "left").select("j", "b", *keys, F.pmod(F.xxhash64("j"), several).alias("group"))
        keys = [*keys, "group"]
    return a.join(b, keys).where("i <> j").select("i", "j", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def _with_self(edges: DataFrame, spots: DataFrame, include_self: bool) -> DataFrame:
    return edges.unionByName(spots.select(F.col("spot_id").alias("i"), F.col("spot_id").alias("j"))) if include_self else edges


def radius_graph(spots: DataFrame, radius: float, include_self: bool = False) -> DataFrame:
    """Edges between points at most radius apart."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    return _with_self(within(spots, spots, radius, _dimension(spots), PER_GROUP).select("i", "j"), spots, include_self)


def _cell(radius: float, dim: int) -> list[Column]:
    return [F.floor(F.get("coords", F.lit(k)) / F.lit(radius)).alias(f"c{k}") for k in range(dim)]


def _first_radius(spots: DataFrame, k: int, n: int, dim: int) -> float:
    """A radius whose cells hold few points, wherever these lie dense; points far out don't count for more than others."""
    ranges = [F.percentile_approx(F.get("coords", F.lit(d)), [0.01, 0.99], 1000) for d in range(dim)]
    spans = [max(e[1] - e[0], 0.0) for e in spots.agg(*ranges).first()]
    wide = [s for s in spans if s > 0]
    radius = 1.5 * (math.prod(wide) * (k + 1) / n / 3) ** (1 / len(wide)) if wide else 1.0
    most = MOST * (k + 1)
    for _ in range(64):
        fullest = spots.groupBy(*_cell(radius, dim)).count().agg(F.max("count")).first()[0]
        if fullest <= most:
            break
        radius *= max(0.1, 0.8 * (most / fullest) ** (1 / dim))
    return radius


def nearest(spots: DataFrame, k: int) -> DataFrame:
    """i, j, d2, r: the k nearest of every point, ties to smaller ids. Points with too few in reach look again farther.

    Of the points of one place only those with the k + 1 least ids can be anyone's neighbours, so
    no place holds more; and the first radius follows the fullest cell, so no cell holds many.
    """
    dim = _dimension(spots)
    n = spots.count()
    k = min(k, n - 1)
    order = Window.partitionBy("i").orderBy("d2", "j")
    if k <= 0:
        return spots.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double, r int")
    here = Window.partitionBy("coords").orderBy("spot_id")
    near = cut(spots.select("spot_id", "coords").withColumn("r", F.row_number().over(here)).where(F.col("r") <= k + 1).drop("r"))
    radius = _first_radius(near, k, n, dim)
    left, out = spots, None
    while True:
        found = within(left, near, radius, dim).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        found = cut(found)
        full = found.where(F.col("r") == k).select(F.col("i").alias("spot_id"))
        sure = found.join(full.withColumnRenamed("spot_id", "i"), "i", "left_semi")
        out = sure if out is None else out.unionByName(sure)
        left = cut(left.join(full, "spot_id", "left_anti"))
        if left.isEmpty():
            return out
        radius *= 2


def knn_graph(spots: DataFrame, k: int = 6, include_self: bool = False) -> DataFrame:
    """Edges between points of which one is among the k nearest of the other."""
    near = nearest(spots, k).select("i", "j")
    return _with_self(near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct(), spots, include_self)


def grid_graph(spots: DataFrame, spacing: float | None = None) -> DataFrame:
    """Edges within 1.5 times the spacing (the median distance to the nearest point)."""
    if spacing is None:
        spacing = nearest(spots, 1).agg(F.median(F.sqrt("d2"))).first()[0]
    if not spacing:
        return spots.sparkSession.createDataFrame([], "i bigint, j bigint")
    return radius_graph(spots, 1.5 * spacing)


def adjacency(spots: DataFrame, method: str = "knn", k: int = 6, radius: float | None = None) -> DataFrame:
    if method == "knn":
        return knn_graph(spots, k)
    if method == "radius":
        if radius is None:
            raise ValueError("radius is required for the radius graph")
        return radius_graph(spots, radius)
    if method == "grid":
        return grid_graph(spots)
    raise ValueError(f"unknown method: {method}")


def degrees(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """spot_id, degree of every spot."""
    n = edges.groupBy(F.col("i").alias("spot_id")).agg(F.count("*").alias("degree"))
    return spots.select("spot_id").join(n, "spot_id", "left").select("spot_id", F.coalesce("degree", F.lit(0)).cast("int").alias("degree"))


def laplacian(edges: DataFrame, spots: DataFrame, normalized: bool = False) -> DataFrame:
    """i, j, value: D - A, or I - D^-1/2 A D^-1/2 (isolated points keep 1 on the diagonal)."""
    deg = degrees(edges, spots)
    diagonal = deg.select(F.col("spot_id").alias("i"), F.col("spot_id").alias("j"), (F.lit(1.0) if normalized else F.col("degree").cast("double")).alias("value"))
    if not normalized:
        return diagonal.unionByName(edges.select("i", "j", F.lit(-1.0).alias("value")))
    a, b = deg.select(F.col("spot_id").alias("i"), F.col("degree").alias("di")), deg.select(F.col("spot_id").alias("j"), F.col("degree").alias("dj"))
    return diagonal.unionByName(edges.join(a, "i").join(b, "j").select("i", "j", (-1.0 / F.sqrt((F.col("di") * F.col("dj")).cast("double"))).alias("value")))


def neighbors(edges: DataFrame, spots: DataFrame) -> DataFrame:
    """spot_id, neighbors (sorted)."""
    near = edges.groupBy(F.col("i").alias("spot_id")).agg(F.sort_array(F.collect_list("j")).alias("neighbors"))
    return spots.select("spot_id").join(near, "spot_id", "left").select("spot_id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def quadratic(beta: DataFrame, edges: DataFrame) -> DataFrame:
    """One row, value: the sum over edges of squared differences of b (spot_id, b array)."""
    a, c = beta.select(F.col("spot_id").alias("i"), F.col("b").alias("x")), beta.select(F.col("spot_id").alias("j"), F.col("b").alias("y"))
    d2 = F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    return edges.join(a, "i").join(c, "j").agg((F.coalesce(F.sum(d2), F.lit(0.0)) / 2).alias("value"))


def auto_lambda(gram_diagonal_mean: float, edges: DataFrame, spots: DataFrame, alpha: float = 0.005) -> float:
    """alpha times the mean of the Gram diagonal over the mean degree (1 at least)."""
    mean = degrees(edges, spots).agg(F.avg("degree")).first()[0] or 0.0
    return alpha * gram_diagonal_mean / max(mean, 1.0)
