"""The estimator: from counts, signatures and locations to proportions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.functions.columns import argmax
from mixspark.functions.lineage import cut
from mixspark.operators import binning, features, graph, sketch, solver
from mixspark.sources import tables


@dataclass
class Deconvolution:
    """Parameters of a fit, and what fit() found (attributes with a trailing underscore)."""

    sketch_dim: int = 512
    lambda_spatial: float | str = "auto"
    rho_sparsity: float = 0.01
    n_hvg: int = 2000
    n_markers_per_type: int = 50
    spatial_method: str = "knn"
    k_neighbors: int = 6
    radius: float | None = None
    max_iter: int = 100
    tol: float = 1e-4
    preprocess: str = "log_cpm"
    random_state: int | None = 0
    verbose: bool = False
    fitted: bool = field(default=False, init=False)

    def __post_init__(self) -> None:
        least = (("sketch_dim", 1), ("k_neighbors", 0), ("max_iter", 0), ("rho_sparsity", 0), ("n_hvg", 0), ("n_markers_per_type", 0))
        for name, low in least:
            if getattr(self, name) < low:
                raise ValueError(f"{name} must be at least {low}")
        if self.tol <= 0:
            raise ValueError("tol must be positive")
        if isinstance(self.lambda_spatial, (int, float)) and self.lambda_spatial < 0:
            raise ValueError("lambda_spatial must not be negative")
        if self.spatial_method == "radius" and self.radius is None:
            raise ValueError("radius is required for the radius graph")
        if self.radius is not None and self.radius <= 0:
            raise ValueError("radius must be positive")

    def fit(self, counts: DataFrame, signatures: DataFrame, spots: DataFrame, cell_types: list[str], counted: DataFrame | None = None) -> Deconvolution:
        """counts: spot_id, gene_id, value. signatures: gene_id, x in the order of cell_types. spots: spot_id, coords.

        counted: spot_id of the spots that counts have, where they are known without going through counts.
        """
        spark, k = counts.sparkSession, len(cell_types)
        if not k:
            raise ValueError("no cell types")
        signatures = cut(signatures)
        first = signatures.first()
        if first is None or len(first.x) != k:
            raise ValueError("signatures and cell types differ in number")
        if not (counts if counted is None else counted).select("spot_id").distinct().join(spots, "spot_id", "left_anti").isEmpty():
            raise ValueError("counts have spots without coordinates")
        spots = cut(spots.select("spot_id", "coords"))
        self.n_spots_, self.n_cell_types_, self.cell_type_names_ = spots.count(), k, list(cell_types)
        shared = counts.join(signatures.select("gene_id"), "gene_id", "left_semi")
        if self.n_hvg:
            shared = counts = cut(shared)
            moments = features.gene_moments(counts, signatures, self.n_spots_)
            chosen = features.informative_genes(cut(features.dispersions(cut(moments))), signatures, self.n_hvg, self.n_markers_per_type)
        else:
            chosen = features.informative_genes(signatures, signatures, 0, self.n_markers_per_type)
        self.gene_idx_ = cut(chosen.orderBy("gene_id"))
        # Genes are chosen in thousands at most. Counts that are themselves sums are only summed for these.
        counts = cut(counts.join(F.broadcast(self.gene_idx_), "gene_id", "left_semi"))
        if self.n_spots_ and counts.isEmpty() and shared.isEmpty():
            raise ValueError("no counts of the genes that the signatures have")
        own = cut(signatures.join(self.gene_idx_, "gene_id", "left_semi"))
        lev = {r.gene_id: r.leverage for r in features.leverage(own).collect()}
        genes = sorted(lev)
        self.n_genes_ = len(genes)
        y = features.normalise(counts, self.preprocess, self.n_spots_)
        x = {r.gene_id: r.x for r in features.normalise_signatures(own, self.preprocess).collect()}
        # Sketch: S has a row for each gene. X S and, folded into each gene's weights, S (X S)'.
        bucket, weight = sketch.countsketch(len(genes), self.sketch_dim, [lev[g] for g in genes], self.random_state)
        xs = np.zeros((k, self.sketch_dim))
        np.add.at(xs.T, bucket, np.array([x[g] for g in genes]) * weight[:, None])
        gram, m = sketch.gram(xs), xs[:, bucket].T * weight[:, None]
        weights = spark.createDataFrame([(g, v.tolist()) for g, v in zip(genes, m, strict=True)], "gene_id bigint, m array<double>")
        y = cut(y)
        h = sketch.cross_products(y, weights, spots, k)
        y2 = sketch.project(y, spark.createDataFrame([(g, int(b), float(w)) for g, b, w in zip(genes, bucket, weight, strict=True)], "gene_id bigint, bucket int, weight double")).agg(F.sum(F.col("value") * F.col("value"))).first()[0] or 0.0
        self.adjacency_ = cut(graph.adjacency(spots, self.spatial_method, self.k_neighbors, self.radius))
        self.lambda_used_ = graph.auto_lambda(float(np.mean(np.diag(gram))), self.adjacency_, spots) if self.lambda_spatial == "auto" else float(self.lambda_spatial)
        state, self.info_ = solver.solve(h, self.adjacency_, gram, self.lambda_used_, self.rho_sparsity, self.max_iter, self.tol, y2, 10 if self.verbose else 0, solver.spatial_tiles(spots))
        self.beta_ = state.select("spot_id", "b")
        self.proportions_ = solver.proportions(state)
        self.fitted = True
        return self

    def _check(self) -> None:
        if not self.fitted:
            raise RuntimeError("call fit() first")

    def fit_transform(self, *args, **kwargs) -> DataFrame:
        return self.fit(*args, **kwargs).get_cell_type_proportions()

    def get_cell_type_proportions(self) -> DataFrame:
        """spot_id, cell_type, proportion."""
        self._check()
        return tables.long_proportions(self.proportions_, self.cell_type_names_)

    def get_abundances(self) -> DataFrame:
        self._check()
        return self.beta_

    def get_dominant_cell_type(self) -> DataFrame:
        """spot_id, type_id, cell_type of the largest proportion, the first of equal ones."""
        self._check()
        names = F.array(*[F.lit(t) for t in self.cell_type_names_])
        return self.proportions_.select("spot_id", argmax(F.col("p")).alias("type_id")).withColumn("cell_type", F.get(names, F.col("type_id")))

    def parameters(self) -> dict:
        """What the fit was made with, the smoothing that was used, and how it ended."""
        self._check()
        given = ("sketch_dim", "rho_sparsity", "n_hvg", "n_markers_per_type", "spatial_method", "k_neighbors", "radius", "preprocess", "random_state")
        found = {"lambda_spatial": float(self.lambda_used_), "n_genes_used": self.n_genes_, "n_cell_types": self.n_cell_types_, "cell_type_names": self.cell_type_names_}
        return {n: getattr(self, n) for n in given} | found | {"converged": self.info_.converged, "n_iterations": self.info_.n_iterations}

    def summary(self) -> dict:
        if not self.fitted:
            return {"fitted": False}
        return {"fitted": True, "n_spots": self.n_spots_, "n_genes": self.n_genes_, "n_cell_types": self.n_cell_types_, "cell_types": self.cell_type_names_, "sketch_dim": self.sketch_dim, "lambda_used": self.lambda_used_, "converged": self.info_.converged, "n_iterations": self.info_.n_iterations, "final_objective": self.info_.final_objective, "preprocess": self.preprocess}


def deconvolve(counts: DataFrame, ref_counts: DataFrame, ref_cells: DataFrame, spots: DataFrame, genes: DataFrame | None = None, ref_genes: DataFrame | None = None, **params) -> Deconvolution:
    """Fits on the mean signatures of a labelled reference.

    With genes and ref_genes (gene_id, gene) the sides are aligned by names, and gene ids count in
    the order of the common ones; without them the sides' ids mean the same genes.
    """
    if (genes is None) != (ref_genes is None):
        raise ValueError("names are needed for the genes of both sides or of neither")
    if genes is not None:
        d = tables.prepare_data(counts, genes, ref_counts, ref_genes, ref_cells, spots)
        return Deconvolution(**params).fit(d.counts, d.signatures, d.spots, d.types)
    types = tables.cell_types(ref_cells)
    signatures = tables.gene_major(tables.reference_signatures(ref_counts, ref_cells), types)
    return Deconvolution(**params).fit(counts, signatures, spots, types)


#: Bin sizes, and the size that a spot stands for.
BIN_SIZES, BASE = (8, 16, 32, 64, 128), 8


def multiscale(counts: DataFrame, signatures: DataFrame, spots: DataFrame, types: list[str], sizes: Sequence[int] = BIN_SIZES, base: int = BASE, **params) -> DataFrame:
    """bin_size, spot_id (the bin's number), cell_type, proportion: a fit on the bins of every size, in multiples of the spots' spacing."""
    counts, signatures, spots = cut(counts), cut(signatures), cut(spots)
    apart = binning.spacing(spots) if any(size // base > 1 for size in sizes) else None
    out, finer = None, None
    for size in sizes:
        factor = size // base
        bins = cut(binning.numbered(binning.bins_of_size(spots, size, base, apart)))
        of = bins.groupBy("bin").agg(F.array(F.avg(F.get("coords", F.lit(0))), F.avg(F.get("coords", F.lit(1)))).alias("coords")).select(F.col("bin").alias("spot_id"), "coords")
        if finer is not None and factor % finer[0] == 0 and (factor // finer[0]).bit_count() == 1:
            # Widths that double are exact, so these bins are whole ones of those before.
            parts, inside = finer[2], finer[1].select("spot_id", F.col("bin").alias("_in")).join(bins.select("spot_id", "bin"), "spot_id").select(F.col("_in").alias("spot_id"), "bin").distinct()
        else:
            parts, inside = counts, bins.select("spot_id", "bin")
        summed = cut(parts.join(inside, "spot_id").groupBy(F.col("bin").alias("spot_id"), "gene_id").agg(F.sum("value").alias("value")))
        if factor > 1:
            finer = factor, bins, summed
        got = Deconvolution(**params).fit(summed, signatures, of, types).get_cell_type_proportions().select(F.lit(size).alias("bin_size"), "spot_id", "cell_type", "proportion")
        out = got if out is None else out.unionByName(got)
    return out
