"""A corpus from raw documents: by language, by quality, without near copies, packed into sequences.

Every stage takes what the one before it kept, as a table with the columns of documents;
run() and its callers write each stage's rows and read them again. The last one returns
the pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.llm import jaccard_join, language_id, packing, quality
from mixspark.llm.common import cut, held_out, shared_folder, table

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = tuple(COLUMNS[1:])
#: Below this score a language is not taken as identified.
LEAST_LANGUAGE_SCORE = 0.5
LEAST_QUALITY = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: neither without letters nor in doubt between languages. Each row goes or stays by its own text."""
    model = language_id.fit(docs, ~held_out("doc_id", 4, 2))
    found = language_id.identify(docs, model, carry=CARRIED)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good. Each row goes or stays by its own text."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return quality.score(docs, model, carry=CARRIED).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Of rows that repeat its id the one with the least text stays (null before all; then
    the least lang, source, n_chars). Rows without an id are in no group and stay.
    """
    found = jaccard_join.similar(docs, counted=False)
    ids = cut(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")))
    once, repeated = ids.where("rows = 1").select("doc_id"), ids.where("rows > 1").select("doc_id")
    kept = docs.where("doc_id IS NOT NULL").join(once, "doc_id", "left_semi").select(*COLUMNS)
    least = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*CARRIED)).alias("_row")).select("doc_id", "_row.*")
    return kept.unionByName(least.select(*COLUMNS)).unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("quality", good), ("near_copies", distinct), ("packing", packed)]
#: Trained models have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again, and then those before them deleted."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
