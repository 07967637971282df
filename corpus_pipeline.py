"""Text corpus pipeline: rules, shared lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next stage's
documents. All but the last keep the columns of `documents`. Every stage works on whatever its predecessor kept.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm import lines, ngram_join, packing, quality, secrets
from folioframe.llm.common import fresh
from folioframe.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the strict policy; the others go.

    A null or empty text has no words and goes, repeated rows share a verdict, a very long text is measured whole, an empty table stays empty. The
    columns ride along in one struct, so that none can clash with a measurement.
    """
    row = "whole_row"
    entries = quality.ledger(docs.select("text", F.struct(*docs.columns).alias(row)), keep=(row,))
    return quality.apply_policy(entries, "strict@1").where("kept").select(f"{row}.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that ten or more sources share; such a line stays in its first document. No document goes."""
    return lines.remove_boilerplate(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Documents without a word and rows without a doc_id are in no group and stay; of equal rows with one doc_id one stays.
    """
    mark, whole, nth = (fresh(docs, n) for n in ("text_mark", "drop_whole", "nth"))
    told = ngram_join.superfluous(docs).select(F.col("key").alias("doc_id"), F.col("mark").alias(mark), F.col("whole").alias(whole))
    rest = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit("")))).join(told, ["doc_id", mark], "left").where(f"{whole} IS NULL OR NOT {whole}")
    copies = rest.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(whole)))
    return copies.where(F.col(whole).isNull() | (F.col(nth) == 1)).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark; no document goes."""
    mark, spans = fresh(docs, "text_mark"), fresh(docs, "secret_spans")
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    found = secrets.find_secrets(marked, keep=("doc_id", mark)).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(f"{mark}_id"), F.col(mark).alias(f"{mark}_of")).agg(F.first("spans").alias(spans))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(f"{mark}_id")) & (F.col(mark) == F.col(f"{mark}_of")), "left")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans)))
    return joined.select(*[clean.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids: where each one goes and the checksum of its ids.

    The ids themselves are left out; `packing.pack(..., with_ids=True)` carries them through its shuffles.
    """
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("packing", pack_sequences),
]
#: Byte-level ids cannot be said in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        path = f"{base}/{at}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
