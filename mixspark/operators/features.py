"""Normalising counts and selecting genes. Missing counts are zeros: means divide by all spots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixspark.functions.columns import argmax, total


def qc_totals(counts: DataFrame, spots: DataFrame) -> DataFrame:
    """spot_id, total, n_genes (counts above 0) of every spot."""
    sums = counts.groupBy("spot_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") > 0).alias("n_genes"))
    return spots.select("spot_id").join(sums, "spot_id", "left").select("spot_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def subset_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """The counts of the genes that are listed."""
    return counts.join(genes.select("gene_id"), "gene_id", "left_semi")


def normalise(counts: DataFrame, method: str = "log_cpm", n_spots: int | None = None) -> DataFrame:
    """spot_id, gene_id, value. log_cpm: log1p(1e4 value / library), library 0 counting as 1; pearson: value over its model deviation; raw."""
    value = F.col("value").cast("double")
    if method == "raw":
        return counts.select("spot_id", "gene_id", value.alias("value"))
    if method == "log_cpm":
        library = counts.groupBy("spot_id").agg(F.sum("value").alias("lib"))
        lib = F.when(F.col("lib") == 0, 1.0).otherwise(F.col("lib"))
        return counts.join(library, "spot_id").select("spot_id", "gene_id", F.log1p(value * 1e4 / lib).alias("value"))
    if method == "pearson":
        n = n_spots if n_spots is not None else counts.select("spot_id").distinct().count()
        means = counts.groupBy("gene_id").agg((F.sum("value") / F.lit(n) + 1e-6).alias("mu"))
        return counts.join(means, "gene_id").select("spot_id", "gene_id", (value / F.sqrt(F.col("mu") + F.col("mu") * F.col("mu") / 100)).alias("value"))
    raise ValueError(f"unknown method: {method}")


def normalise_signatures(signatures: DataFrame, method: str = "log_cpm") -> DataFrame:
    """gene_id, x: the same for dense signatures, whose libraries are the sums over genes of each type."""
    if method == "raw":
        return signatures.select("gene_id", F.col("x").cast("array<double>").alias("x"))
    if method not in ("log_cpm", "pearson"):
        raise ValueError(f"unknown method: {method}")
    if method == "log_cpm":
        k = len(signatures.first().x)
        libs = signatures.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"l{i}") for i in range(k)]).first()
        return signatures.select("gene_id", F.array(*[F.log1p(F.get("x", F.lit(i)) * 1e4 / F.lit(libs[i] + 1e-10)) for i in range(k)]).alias("x"))
    mu = total(F.col("x")) / F.size("x") + 1e-6
    return signatures.select("gene_id", F.transform("x", lambda v: v / F.sqrt(mu + mu * mu / 100)).alias("x"))


def gene_moments(counts: DataFrame, genes: DataFrame, n_spots: int) -> DataFrame:
    """gene_id, mean, var (sample) of log1p(1e4 value / library) over all spots, libraries below 1 counting as 1; genes without counts are zeros."""
    library = counts.groupBy("spot_id").agg(F.greatest(F.sum("value").cast("double"), F.lit(1.0)).alias("lib"))
    log = counts.where("value <> 0").join(library, "spot_id").select("gene_id", F.log1p(F.col("value") * 1e4 / F.col("lib")).alias("value"))
    sums = log.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s, q = F.coalesce("s", F.lit(0.0)) / n_spots, F.coalesce("q", F.lit(0.0)) / n_spots
    var = F.greatest(F.lit(0.0), (q - s * s) * (n_spots / (n_spots - 1))) if n_spots > 1 else F.lit(0.0)
    return genes.select("gene_id").join(sums, "gene_id", "left").select("gene_id", s.alias("mean"), var.alias("var"))


def dispersions(moments: DataFrame) -> DataFrame:
    """moments with bin and disp: the variance's z-score among genes of like mean, in 20 bins by percentiles of positive means.

    With fewer than two positive means, or where these are all equal, there are no bins: bin and disp are 0.
    """
    edges = moments.where("mean > 0").agg(F.array_distinct(F.percentile("mean", F.array(*[F.lit(i / 20) for i in range(21)]))).alias("e"))
    n = F.coalesce(F.size(F.col("e")), F.lit(0))
    at = F.greatest(F.lit(0), F.least(F.size(F.filter("e", lambda b: b <= F.col("mean"))) - 1, n - 2))
    # A single row of bin edges joins every gene.
    binned = moments.join(F.broadcast(edges)).withColumn("bin", F.when(n < 2, 0).otherwise(at).cast("int")).withColumn("_bins", n >= 2).drop("e")
    w = Window.partitionBy("bin")
    z = (F.col("var") - F.avg("var").over(w)) / (F.stddev_pop("var").over(w) + 1e-10)
    return binned.withColumn("disp", F.when(F.col("_bins") & (F.count("*").over(w) > 1), z).otherwise(0.0)).drop("_bins")


def select_hvg(disp: DataFrame, n_top: int = 2000, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5) -> DataFrame:
    """gene_id of the n_top genes of the largest dispersion; of all genes where too few pass the bounds. Ties: the larger id."""
    valid = disp.where(F.col("mean").between(min_mean, max_mean) & (F.col("disp") >= min_disp))
    of = valid if valid.count() >= n_top else disp
    return of.orderBy(F.desc("disp"), F.desc("gene_id")).limit(n_top).select("gene_id")


def marker_scores(signatures: DataFrame, method: str = "diff") -> DataFrame:
    """gene_id, type_id (the first of the largest share), score of every gene. Shares are within a type, over its genes."""
    if method not in ("diff", "ratio", "specificity"):
        raise ValueError(f"unknown method: {method}")
    k = len(signatures.first().x)
    sums = signatures.agg(*[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    p = signatures.select("gene_id", F.array(*[F.get("x", F.lit(i)) / F.lit(sums[i] + 1e-10) for i in range(k)]).alias("p"))
    top = F.array_max("p")
    if method == "diff":
        score = top - F.get(F.sort_array("p", asc=False), F.lit(1))
    elif method == "ratio":
        score = top / ((total(F.col("p")) - top) / (k - 1) + 1e-10)
    else:
        score = total(F.transform("p", lambda v: 1 - v / (top + 1e-10))) / (k - 1)
    return p.select("gene_id", argmax(F.col("p")).alias("type_id"), score.alias("score"))


def select_markers(signatures: DataFrame, n_markers: int = 50, method: str = "diff") -> DataFrame:
    """gene_id, type_id: the n_markers genes of the highest score of each type; a type that owns no gene gets its most expressed ones."""
    if n_markers < 0:
        raise ValueError("n_markers must not be negative")
    k = len(signatures.first().x)
    if k == 1:
        return signatures.orderBy("gene_id").limit(n_markers).select("gene_id", F.lit(0).alias("type_id"))
    scored = marker_scores(signatures, method)
    best = Window.partitionBy("type_id").orderBy(F.desc("score"), F.desc("gene_id"))
    own = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= n_markers).select("gene_id", "type_id")
    values = signatures.select("gene_id", F.posexplode("x").alias("type_id", "v")).join(own.select("type_id").distinct(), "type_id", "left_anti")
    most = Window.partitionBy("type_id").orderBy(F.desc("v"), F.desc("gene_id"))
    rest = values.withColumn("r", F.row_number().over(most)).where(F.col("r") <= n_markers).select("gene_id", "type_id")
    return own.unionByName(rest)


def leverage(signatures: DataFrame, reg: float = 1e-6) -> DataFrame:
    """gene_id, leverage: x' (C + reg I)^-1 x for centred signatures, C their types' products, over the sum of all."""
    rows = signatures.orderBy("gene_id").collect()  # genes by types: one reference's signatures
    x = np.array([r.x for r in rows]).reshape(len(rows), -1)
    x = x - x.mean(1, keepdims=True)
    lev = np.einsum("gk,gk->g", x, np.linalg.solve(x.T @ x + reg * np.eye(x.shape[1]), x.T).T)
    lev = lev / (lev.sum() + reg)
    return signatures.sparkSession.createDataFrame([(r.gene_id, float(v)) for r, v in zip(rows, lev, strict=True)], "gene_id bigint, leverage double")


def informative_genes(disp: DataFrame, signatures: DataFrame, n_hvg: int = 2000, n_markers: int = 50) -> DataFrame:
    """gene_id of variable genes and markers together; an empty selection is an error."""
    parts = ([select_hvg(disp, n_hvg)] if n_hvg else []) + ([select_markers(signatures, n_markers).select("gene_id")] if n_markers else [])
    if not parts:
        raise ValueError("no genes selected")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.distinct()
