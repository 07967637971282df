"""Language of documents that were not learned from."""

from pyspark.sql import functions as F

from folioframe.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    told = queries.QUERIES["op3_language_id"](spark, SF).join(docs, "doc_id").where("held_out AND lang IS NOT NULL")
    right, rejected, n = told.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count_if("rejected"), F.count(F.lit(1))).first()
    assert n > 100 and right / n >= 0.95 and rejected <= 0.1 * n
    assert told.where("score < 0 OR score > 1").count() == 0
