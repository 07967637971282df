"""Inputs of the registered queries, derived from the given tables.

The tables hold no page layouts, so each input is computed from whole tables by plain arithmetic. Every
derivation exists twice, as a DataFrame here and as a common table expression for the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str, *names: str) -> str:
    """The query with the common table expressions it needs, each after those it builds on."""
    done: list[str] = []

    def add(name: str) -> None:
        if name not in done:
            for other in SQL[name][1]:
                add(other)
            done.append(name)

    for name in names:
        add(name)
    ctes = [f"{name} AS MATERIALIZED ({SQL[name][0]})" for name in done]
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*ctes, text[len("WITH RECURSIVE "):]])
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join([*ctes, text[len("WITH "):]])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + text


def sql(name: str, text: str, *needs: str) -> None:
    SQL[name] = (" ".join(text.split()), needs)


# --- page layouts ------------------------------------------------------------------------------------

sql("regions", """
SELECT l_orderkey AS page_id, l_linenumber AS region_id,
       CASE min(l_returnflag) WHEN 'A' THEN 'text' WHEN 'R' THEN 'table' ELSE 'image' END AS label,
       CAST(min(l_partkey) % 70 AS DOUBLE) / 100 AS x_ratio,
       CAST((min(l_suppkey) * 7 + l_linenumber * 11) % 85 AS DOUBLE) / 100 AS y_ratio,
       CAST(5 + (min(l_partkey) % 6) * 5 AS DOUBLE) / 100 AS width_ratio,
       CAST(2 + (min(l_suppkey) % 5) * 3 AS DOUBLE) / 100 AS height_ratio,
       CAST(50 + (min(l_partkey) % 50) AS DOUBLE) / 100 AS confidence
FROM lineitem GROUP BY l_orderkey, l_linenumber""")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    part, supp = F.min("l_partkey"), F.min("l_suppkey")
    # The least flag as a number, so that the aggregation can hash instead of sort.
    flag = F.chr(F.min(F.ascii("l_returnflag")))
    grouped = lines.groupBy(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("region_id")).agg(
        flag.alias("flag"), part.alias("part"), supp.alias("supp")
    )

    def share(value):
        return value.cast("double") / 100

    return grouped.select(
        "page_id",
        "region_id",
        F.when(F.col("flag") == "A", "text").when(F.col("flag") == "R", "table").otherwise("image").alias("label"),
        share(F.col("part") % 70).alias("x_ratio"),
        share((F.col("supp") * 7 + F.col("region_id") * 11) % 85).alias("y_ratio"),
        share(5 + (F.col("part") % 6) * 5).alias("width_ratio"),
        share(2 + (F.col("supp") % 5) * 3).alias("height_ratio"),
        share(50 + F.col("part") % 50).alias("confidence"),
    )


sql("layout_pages", """
SELECT o_orderkey AS page_id, o_custkey AS doc_id, CAST(o_orderkey % 3 AS INT) + 1 AS page_number,
       800 + CAST(o_orderkey % 5 AS INT) * 50 AS image_width,
       1000 + CAST(o_custkey % 4 AS INT) * 100 AS image_height FROM orders""")


def layout_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_from_orders(table(spark, sf, "orders"))


def pages_from_orders(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "o_orderkey AS page_id", "o_custkey AS doc_id", "cast(o_orderkey % 3 AS int) + 1 AS page_number",
        "800 + cast(o_orderkey % 5 AS int) * 50 AS image_width", "1000 + cast(o_custkey % 4 AS int) * 100 AS image_height",
    )


# A template belongs to a nation; its page n is the first page n that a customer of the nation sent.
sql("template_pages", """
SELECT min(o.o_orderkey) AS template_page_id, CAST(c.c_nationkey AS BIGINT) AS template_id,
       CAST(o.o_orderkey % 3 AS INT) + 1 AS page_number
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
GROUP BY c.c_nationkey, CAST(o.o_orderkey % 3 AS INT) + 1""")


def template_pages(spark: SparkSession, sf: str) -> DataFrame:
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    page = ((F.col("o_orderkey") % 3).cast("int") + 1).alias("page_number")
    return (
        joined.groupBy(F.col("c_nationkey").cast("bigint").alias("template_id"), page)
        .agg(F.min("o_orderkey").alias("template_page_id"))
        .select("template_page_id", "template_id", "page_number")
    )


sql("template_versions", """
SELECT CAST(n_nationkey AS BIGINT) AS template_id, CAST(n_regionkey AS BIGINT) AS group_id, n_name AS version_name,
       CAST(n_nationkey % 7 AS INT) + 1 AS version_number,
       CASE WHEN n_nationkey % 4 = 0 THEN 'draft' ELSE 'active' END AS status,
       CASE WHEN n_nationkey % 5 = 0 THEN 'main_page' WHEN n_nationkey % 5 = 1 THEN NULL ELSE 'all_pages' END
         AS detection_mode,
       1 AS main_page_number,
       CAST(50 + (n_nationkey % 5) * 10 AS DOUBLE) / 100 AS similarity_threshold,
       CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST(n_nationkey % 11 AS DOUBLE) / 10 END
         AS final_confidence_threshold,
       CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST(n_nationkey % 8 AS DOUBLE) / 5 END AS layout_weight,
       CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE CAST(n_nationkey % 4 AS DOUBLE) / 5 END AS text_anchor_weight,
       CAST(n_nationkey % 3 AS DOUBLE) / 5 AS image_anchor_weight
FROM nation""")


def template_versions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        key.cast("bigint").alias("template_id"),
        F.col("n_regionkey").cast("bigint").alias("group_id"),
        F.col("n_name").alias("version_name"),
        ((key % 7).cast("int") + 1).alias("version_number"),
        F.when(key % 4 == 0, "draft").otherwise("active").alias("status"),
        F.when(key % 5 == 0, "main_page").when(key % 5 == 1, None).otherwise("all_pages").alias("detection_mode"),
        F.lit(1).alias("main_page_number"),
        ((50 + (key % 5) * 10).cast("double") / 100).alias("similarity_threshold"),
        F.when(key % 6 == 0, None).otherwise((key % 11).cast("double") / 10).alias("final_confidence_threshold"),
        F.when(key % 7 == 0, None).otherwise((key % 8).cast("double") / 5).alias("layout_weight"),
        F.when(key % 9 == 0, None).otherwise((key % 4).cast("double") / 5).alias("text_anchor_weight"),
        ((key % 3).cast("double") / 5).alias("image_anchor_weight"),
    )
