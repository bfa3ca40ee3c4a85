"""Checks of a labelled reference and of results by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixspark.functions.columns import pearson

#: Genes up to which counts of others are left out by a broadcast; beyond it their sums are, which are few.
FEW_GENES = 20_000
#: Labels that stand for no type. Fixed values.
UNKNOWN = ("Unknown", "UND", "Unassigned", "Ambiguous", "Mixed", "Doublet")


def filter_unknown(cells: DataFrame, pattern: str | None = None) -> DataFrame:
    """Cells whose label is none of UNKNOWN or, with a pattern, doesn't contain it (a regular expression)."""
    return cells.where(~F.col("cell_type").isin(*UNKNOWN) if pattern is None else ~F.col("cell_type").rlike(pattern))


def min_cells(cells: DataFrame, least: int = 200) -> DataFrame:
    return cells.join(cells.groupBy("cell_type").count().where(F.col("count") >= least), "cell_type", "left_semi")


def merge_labels(cells: DataFrame, parents: dict[str, str]) -> DataFrame:
    return cells.replace(parents, subset=["cell_type"])


def cell_bands(cells: DataFrame) -> DataFrame:
    """cell_type, n, band by the number of cells: 2000, 500 and 200 at least."""
    n = F.col("n")
    return cells.groupBy("cell_type").agg(F.count("*").alias("n")).withColumn("band", F.when(n >= 2000, "excellent").when(n >= 500, "good").when(n >= 200, "usable").otherwise("poor"))


def signature_correlation(signatures: DataFrame, genes: DataFrame, high: float = 0.95) -> DataFrame:
    """type1, type2, r, similar of all pairs of types (a reference has tens) over all genes."""
    types = signatures.select("cell_type").distinct()
    full = genes.select("gene_id").join(F.broadcast(types)).join(signatures, ["gene_id", "cell_type"], "left").select("gene_id", "cell_type", F.coalesce("value", F.lit(0.0)).alias("v"))
    a, b = full.select("gene_id", F.col("cell_type").alias("type1"), F.col("v").alias("x")), full.select("gene_id", F.col("cell_type").alias("type2"), F.col("v").alias("y"))
    out = a.join(b, "gene_id").where("type1 < type2").groupBy("type1", "type2").agg(pearson(F.col("x"), F.col("y")).alias("r"))
    return out.withColumn("similar", F.col("r") > high)


def marker_validation(counts: DataFrame, cells: DataFrame, markers: DataFrame) -> DataFrame:
    """markers: cell_type, gene_id. Share of a type's cells with the gene, fold change against all others, ok (over 0.8 and 5)."""
    n = cells.groupBy("cell_type").agg(F.count("*").alias("n_in"))
    everything = n.agg(F.sum("n_in").alias("n_all"))
    sums = counts.join(cells, "cell_id").groupBy("gene_id", "cell_type").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 0).alias("k"))
    total = sums.groupBy("gene_id").agg(F.sum("s").alias("all"))
    out = markers.join(sums, ["gene_id", "cell_type"], "left").join(total, "gene_id", "left").join(n, "cell_type").join(F.broadcast(everything))
    s, a = F.coalesce("s", F.lit(0.0)), F.coalesce("all", F.lit(0.0))
    mean_in, mean_out = s / F.col("n_in"), F.coalesce(F.try_divide(a - s, F.col("n_all") - F.col("n_in")), F.lit(0.0))
    out = out.select("cell_type", "gene_id", (F.coalesce("k", F.lit(0)) / F.col("n_in")).alias("share"), (mean_in / (mean_out + 1e-6)).alias("fold_change"))
    return out.withColumn("ok", (F.col("share") > 0.8) & (F.col("fold_change") > 5))


def strict_annotation(scores: DataFrame) -> DataFrame:
    """scores: cell_id, cell_type, pos, neg. The type of the best pos - neg/2 if it is above 0 and leads by over 0.5, else Ambiguous."""
    order = Window.partitionBy("cell_id").orderBy(F.desc("s"), "cell_type")
    s = scores.withColumn("s", F.col("pos") - 0.5 * F.col("neg")).withColumn("r", F.row_number().over(order)).where("r <= 2")
    best = s.groupBy("cell_id").agg(F.max(F.when(F.col("r") == 1, F.col("cell_type"))).alias("t"), F.max(F.when(F.col("r") == 1, F.col("s"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("b"))
    return best.select("cell_id", F.when((F.col("a") > 0) & (F.col("a") > F.coalesce(F.col("b"), F.lit(float("-inf"))) + 0.5), F.col("t")).otherwise("Ambiguous").alias("cell_type"))


def region_means(proportions: DataFrame, regions: DataFrame) -> DataFrame:
    return proportions.join(regions, "spot_id").groupBy("region", "cell_type").agg(F.avg("proportion").alias("mean_proportion"))


def marker_correlation(counts: DataFrame, proportions: DataFrame, markers: DataFrame, parts: int | None = None) -> DataFrame:
    """cell_type, gene_id, r between a marker's counts and its type's proportion over all spots."""
    wanted = markers.select("cell_type", "gene_id").distinct()
    return gene_correlation(counts, proportions, wanted.select("gene_id").distinct(), parts).join(wanted, ["cell_type", "gene_id"], "left_semi")


def coherence(proportions: DataFrame, edges: DataFrame) -> DataFrame:
    """cell_type, coherence: the correlation of a type's proportion with its neighbours'."""
    a = proportions.select(F.col("spot_id").alias("i"), "cell_type", F.col("proportion").alias("x"))
    b = proportions.select(F.col("spot_id").alias("j"), "cell_type", F.col("proportion").alias("y"))
    return edges.join(a, "i").join(b, ["j", "cell_type"]).groupBy("cell_type").agg(pearson(F.col("x"), F.col("y")).alias("coherence"))


def gene_correlation(counts: DataFrame, proportions: DataFrame, genes: DataFrame, parts: int | None = None) -> DataFrame:
    """cell_type, gene_id, r of every gene's counts with every type's proportion, from sums over the stored counts only.

    parts: into so many parts the counts come dealt by spot_id; they stay so until they are summed, whatever few bytes they take packed.
    """
    y, p = F.col("proportion"), F.col("proportion") - F.col("mean")
    types = proportions.groupBy("cell_type").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("vy"), (F.max(y) == F.min(y)).alias("flat"))
    if parts is not None:
        proportions = proportions.repartition(parts, "spot_id")
    if genes.count() <= FEW_GENES:
        counts = counts.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi")
    # Tens of types at most.
    rows = counts.join(proportions, "spot_id").join(F.broadcast(types.select("cell_type", "mean")), "cell_type")
    v = F.col("value")
    sums = rows.groupBy("cell_type", "gene_id").agg(F.count("*").alias("k"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum(v * p).alias("c"), (F.max(v) == F.min(v)).alias("same"), F.max(v == 0).alias("zeros"))
    n, s = F.col("n"), F.col("s")
    vx = F.col("q") / n - (s / n) * (s / n)
    constant = F.col("k").isNull() | F.col("flat") | (F.col("same") & ((F.col("k") == n) | F.col("zeros")))
    r = F.try_divide(F.col("c") / n, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.col("vy")))
    every = genes.select("gene_id").join(F.broadcast(types)).join(sums, ["cell_type", "gene_id"], "left")
    return every.select("cell_type", "gene_id", F.when(constant, 0.0).otherwise(F.coalesce(r, F.lit(0.0))).alias("r"))
