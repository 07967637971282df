"""File manifests: kinds by magic bytes and the retention scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path; columns that are not used are never read, so metadata scans stay cheap."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )


def sniff(files: DataFrame) -> DataFrame:
    """pdf or image by the first bytes behind leading blanks, however many there are."""
    pdf = F.decode("content", "ISO-8859-1").rlike(r"^[\x09-\x0D\x20]*+%PDF")
    return files.withColumn("source_type", F.when(pdf, "pdf").otherwise("image")).drop("content")


def retention_scan(files: DataFrame, hours: int = 24, shown: int = 200, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Totals of files not changed for the given hours before `now`, and the first `shown` of them by path (dry run only)."""
    limit = (F.current_timestamp() if now is None else now) - F.make_interval(hours=F.lit(max(1, hours)))
    old = files.filter(F.col("modificationTime") <= limit).select("path", "modificationTime", "length")
    totals = old.agg(
        F.count("*").alias("candidate_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("candidate_bytes"),
        (F.count("*") > shown).alias("truncated"),
    )
    return totals, old.orderBy("path").limit(shown)
