"""What the operators share: reading tables, held-out rows, cutting lineage, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mixspark.functions.lineage import cut, shared_folder

__all__ = ["carried", "cut", "held_out", "shared_folder", "small", "table", "text_bytes", "training_sample"]

#: Rows up to which a side of a join is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; a null id is never held out."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Bytes of all texts and 16 for each row, counted: what the optimiser guesses is wrong after joins and for compressed files."""
    return df.agg(F.sum(F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16)).first()[0] or 0


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, hinted for broadcast only where its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def carried(docs: DataFrame, own: tuple[str, ...], carry: tuple[str, ...], schema: str) -> tuple[list[str], StructType]:
    """Names and schema of an operator's own columns and, after them, of those of docs it carries along."""
    if clash := set(own) & set(carry):
        raise ValueError(f"columns that can't be carried: {sorted(clash)}")
    return [*own, *carry], StructType([*StructType.fromDDL(schema).fields, *(docs.schema[c] for c in carry)])


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, max_bytes: int) -> DataFrame:
    """At most so many labelled documents (id, text, label), each text whole and of at most max_bytes.

    The ids are the first in the order of a hash, so the sample is the same on every
    run; an id labelled more than once counts with its largest label, one of several
    texts with the least of them.
    """
    picked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    return (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .where(F.octet_length("_text") <= max_bytes)
        .join(F.broadcast(picked), "_id")
        .groupBy("_id")
        .agg(F.min("_text").alias("_text"), F.min("_label").alias("_label"))
    )
