"""Reading counts, locations and labelled references; aligning genes; writing results.

counts: spot_id, gene_id, value (zeros left out). spots: spot_id, coords array<double>, a row
for every spot. ref_counts: cell_id, gene_id, value. ref_cells: cell_id, cell_type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mixspark.functions.columns import argmax
from mixspark.functions.lineage import cut


def load_spots(df: DataFrame, id_col: str, coord_key: str = "spatial") -> DataFrame:
    """spot_id and coords, from the first of: an array column coord_key, one X_spatial, columns x and y, array_row and array_col."""
    for names in ([coord_key], ["X_spatial"], ["x", "y"], ["array_row", "array_col"]):
        if all(n in df.columns for n in names):
            coords = F.col(names[0]).cast("array<double>") if len(names) == 1 else F.array(*[F.col(n).cast("double") for n in names])
            return df.select(F.col(id_col).cast("long").alias("spot_id"), coords.alias("coords"))
    raise ValueError("no coordinates found")


def reference_signatures(ref_counts: DataFrame, ref_cells: DataFrame, method: str = "mean") -> DataFrame:
    """cell_type, gene_id, value: the mean or sum over all cells of a type, those without a stored count included."""
    if method not in ("mean", "sum"):
        raise ValueError(f"unknown method: {method}")
    return signatures_of(ref_counts.join(ref_cells, "cell_id"), ref_cells, method)


def signatures_of(labelled: DataFrame, ref_cells: DataFrame, method: str = "mean") -> DataFrame:
    """reference_signatures of counts that come with their cell's type: cell_type, gene_id, value, in any number of rows."""
    sums = labelled.groupBy("cell_type", "gene_id").agg(F.sum("value").alias("value"))
    if method == "sum":
        return sums
    cells = ref_cells.groupBy("cell_type").agg(F.countDistinct("cell_id").alias("n"))
    return sums.join(cells, "cell_type").select("cell_type", "gene_id", (F.col("value") / F.col("n")).alias("value"))


def gene_major(signatures: DataFrame, types: list[str]) -> DataFrame:
    """gene_id, x: a row for each gene with its values in the order of types, zeros where there are none."""
    wide = signatures.groupBy("gene_id").pivot("cell_type", types).agg(F.sum("value"))
    return wide.select("gene_id", F.array(*[F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in types]).alias("x"))


def cell_types(ref_cells: DataFrame) -> list[str]:
    """The sorted names of the types: as many as a reference has labels."""
    return sorted(r[0] for r in ref_cells.select("cell_type").distinct().collect())


def align_genes(left: DataFrame, right: DataFrame, order: str = "name") -> DataFrame:
    """gene, left_idx, right_idx, gene_id of the names on both sides (columns gene, idx); of repeated names the first.

    gene_id counts in the order of names, or with order "left" in that of the left side. No common name is an error.
    """
    if order not in ("name", "left"):
        raise ValueError(f"unknown order: {order}")
    a = left.groupBy("gene").agg(F.min("idx").alias("left_idx"))
    b = right.groupBy("gene").agg(F.min("idx").alias("right_idx"))
    both = a.join(b, "gene")
    if both.isEmpty():
        raise ValueError("the sides have no gene in common")
    # The genes of an alignment are tens of thousands at most: one ordered partition numbers them.
    return both.withColumn("gene_id", (F.row_number().over(Window.orderBy("gene" if order == "name" else "left_idx")) - 1).cast("int"))


def by_alignment(counts: DataFrame, aligned: DataFrame, side: str) -> DataFrame:
    """Counts whose gene ids are those of an alignment, side "left" or "right"; genes that aren't in it are gone."""
    number = aligned.select(F.col(f"{side}_idx").alias("gene_id"), F.col("gene_id").cast("long").alias("_to"))
    return counts.join(number, "gene_id").drop("gene_id").withColumnRenamed("_to", "gene_id")


@dataclass(frozen=True)
class Prepared:
    """What an estimator fits on; genes: gene_id, gene of the names that both sides have."""

    counts: DataFrame
    signatures: DataFrame
    spots: DataFrame
    types: list[str]
    genes: DataFrame


def prepare_data(counts: DataFrame, genes: DataFrame, ref_counts: DataFrame, ref_genes: DataFrame, ref_cells: DataFrame, spots: DataFrame) -> Prepared:
    """Counts and mean signatures over the genes that both sides name (genes, ref_genes: gene_id, gene), in the order of names."""
    left, right = (g.select("gene", F.col("gene_id").alias("idx")) for g in (genes, ref_genes))
    aligned = cut(align_genes(left, right))
    types = cell_types(ref_cells)
    reference = reference_signatures(by_alignment(ref_counts, aligned, "right"), ref_cells)
    # A gene that no reference cell has is a row of zeros.
    every = aligned.select(F.col("gene_id").cast("long").alias("gene_id"), "gene")
    zeros = F.array(*[F.lit(0.0)] * len(types))
    signatures = every.select("gene_id").join(gene_major(reference, types), "gene_id", "left").select("gene_id", F.coalesce("x", zeros).alias("x"))
    return Prepared(by_alignment(counts, aligned, "left").select("spot_id", "gene_id", "value"), signatures, spots, types, every)


def unique_names(genes: DataFrame, name: str = "gene") -> DataFrame:
    """genes (gene_id and a name) whose repeated names get -1, -2 and so on behind them, in the order of ids."""
    r = F.row_number().over(Window.partitionBy(name).orderBy("gene_id")) - 1
    return genes.withColumn("_r", r).withColumn(name, F.when(F.col("_r") > 0, F.concat(F.col(name), F.lit("-"), F.col("_r"))).otherwise(F.col(name))).drop("_r")


def load_binned(positions: DataFrame, counts: DataFrame, genes: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Counts and coordinates (pxl_col_in_fullres, pxl_row_in_fullres) of the barcodes that both have; with genes, these too, with unique names."""
    spots = positions.join(counts.select("barcode").distinct(), "barcode", "left_semi")
    found = counts.join(positions.select("barcode"), "barcode", "left_semi"), spots.select("barcode", F.array(F.col("pxl_col_in_fullres").cast("double"), F.col("pxl_row_in_fullres").cast("double")).alias("coords"))
    return found if genes is None else (*found, unique_names(genes))


def prepare_reference(raw: DataFrame, processed: DataFrame, label: str) -> DataFrame:
    """Raw cells that also occur among the processed ones, with their label there; of repeated cells the last one (largest pos)."""
    last = processed.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("pos")))).where("_r = 1")
    return raw.join(last.select("cell", F.col(label).alias("cell_type")), "cell")


def long_proportions(beta: DataFrame, types: list[str] | None = None, values: str = "p") -> DataFrame:
    """spot_id, cell_type, proportion; without names the types are CellType_0, CellType_1 and so on."""
    out = beta.select("spot_id", F.posexplode(values).alias("k", "proportion"))
    name = F.get(F.array(*[F.lit(t) for t in types]), F.col("k")) if types else F.concat(F.lit("CellType_"), F.col("k"))
    return out.select("spot_id", name.alias("cell_type"), "proportion")


def result_table(beta: DataFrame, spots: DataFrame, types: list[str] | None = None, values: str = "p") -> DataFrame:
    """spot_id, a column for each type, dominant (the first of the largest), and x, y where spots have two coordinates or more.

    beta: spot_id and an array of proportions. As many rows as spots, and arrays as long as there
    are types, or it is an error.
    """
    sizes = beta.agg(F.min(F.size(values)), F.max(F.size(values)), F.count("*"), F.count_if(F.col(values).isNull())).first()
    if sizes[3] or sizes[0] != sizes[1]:
        raise ValueError("the proportions must have one length")
    if types is not None and sizes[0] != len(types):
        raise ValueError(f"{sizes[0]} proportions for {len(types)} types")
    if sizes[2] != spots.count() or not beta.join(spots, "spot_id", "left_anti").isEmpty():
        raise ValueError("the proportions must have a row for every spot")
    names = types or [f"CellType_{k}" for k in range(sizes[0] or 0)]
    wide = [F.get(values, F.lit(k)).alias(n) for k, n in enumerate(names)]
    dominant = F.get(F.array(*[F.lit(n) for n in names]), argmax(F.col(values))).alias("dominant")
    xy = [F.get("coords", F.lit(k)).alias(c) for k, c in enumerate("xy")]
    return beta.join(spots.select("spot_id", "coords"), "spot_id").select("spot_id", *wide, dominant, *xy)


def write_results(beta: DataFrame, spots: DataFrame, path: str, types: list[str] | None = None, fmt: str = "parquet") -> None:
    """The result table, as Parquet or CSV with a header."""
    out = result_table(beta, spots, types).write.mode("overwrite")
    (out.option("header", True) if fmt == "csv" else out).format(fmt).save(path)
