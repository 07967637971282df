"""Cross-site boilerplate lines, found by how many distinct sites hold a line.

All of it is DataFrame work. A line is a piece between line ends that holds a word; its key is a 96-bit hash. Lines that come too rarely or from one site
alone are put aside by one aggregation (count, smallest and largest site). For the rest a HyperLogLog sketch of the sites is built per line and
merged by aggregation, from rows reduced to distinct (line, site) before they move. An estimate clearly above or below the threshold decides;
lines near it get an exact distinct count. A boilerplate line then stays only in the document with the smallest key that has it.

A line that holds a large share of all rows is reduced inside each task, and the joins on the line key are plain ones, which adaptive execution splits.

Defined results: a null text is an empty text and stays null; a null site counts as no site; a row with a null key never is the first holder; rows
with equal keys and texts get equal results; line ends between kept lines stay; an empty table gives an empty table; all columns of the input
are kept and own column names never clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import cut_lineage, fresh

LG_K = 11  # relative error about 2.3 %
BAND = 0.12  # five standard errors


def _line_rows(docs: DataFrame, key: str, site: str, text: str) -> DataFrame:
    """(h1, h2, site, key, mark, place) of every line with a word."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(
        F.col(key).alias("key"), F.xxhash64(body).alias("mark"), F.when(F.col(site).isNotNull(), F.xxhash64(site)).alias("site"),
        F.posexplode(F.split(body, "\n", -1)).alias("place", "line"),
    )
    return cut.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "site", "key", "mark", "place")


def spread_lines(rows: DataFrame, min_sites: int, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first): lines on at least `min_sites` distinct sites, with the smallest key that holds them."""
    line = ["h1", "h2"]
    several = rows.groupBy(*line).agg(
        F.count("site").alias("n"), F.min("site").alias("lo"), F.max("site").alias("hi"), F.min("key").alias("first"),
    ).where((F.col("n") >= min_sites) & ((F.col("lo") != F.col("hi")) | F.lit(min_sites <= 1))).select(*line, "first")
    at_sites = rows.select(*line, "site").where(F.col("site").isNotNull()).join(several.select(*line), line, "left_semi").groupBy(*line, "site").agg(F.count(F.lit(1)).alias("n"))
    at_sites = cut_lineage(at_sites.select(*line, "site"))
    guess = at_sites.groupBy(*line).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    slack = F.greatest(F.lit(1.0), F.col("sites") * BAND)
    guess = guess.withColumn("near", F.abs(F.col("sites") - min_sites) <= slack)
    exact = at_sites.join(guess.where("near").select(*line), line, "left_semi").groupBy(*line).agg(F.count(F.lit(1)).alias("exact"))
    sure = guess.where(~F.col("near") & (F.col("sites") > min_sites)).select(*line)
    return several.join(sure.union(exact.where(F.col("exact") >= min_sites).select(*line)), line, "left_semi")


def remove_boilerplate(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = 10) -> DataFrame:
    """All columns of `docs`, the text without boilerplate lines, and n_lines and n_removed (renamed if taken)."""
    rows = _line_rows(docs, key, site, text)
    spread = cut_lineage(spread_lines(rows, min_sites))
    hit = rows.select("h1", "h2", "key", "mark", "place").join(spread, ["h1", "h2"])
    hit = hit.where(F.col("key").isNull() | F.col("first").isNull() | (F.col("key") > F.col("first")))
    gone_name, key_name, mark_name = fresh(docs, "gone_lines"), fresh(docs, "gone_key"), fresh(docs, "gone_mark")
    gone = hit.groupBy(F.col("key").alias(key_name), F.col("mark").alias(mark_name)).agg(F.collect_set("place").alias(gone_name))
    body = F.coalesce(F.col(text), F.lit(""))
    own_mark = fresh(docs, "text_mark")
    joined = docs.withColumn(own_mark, F.xxhash64(body)).join(
        gone, F.col(key).eqNullSafe(F.col(key_name)) & (F.col(own_mark) == F.col(mark_name)), "left",
    )
    n_lines, n_removed = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    pieces = fresh(docs, "pieces")
    joined = joined.withColumn(pieces, F.split(body, "\n", -1))
    return joined.select(
        *[_without(F.col(text), F.col(pieces), F.col(gone_name)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size(F.regexp_extract_all(body, F.lit(r"(?dm)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"), F.lit(0))).cast("long").alias(n_lines),
        F.coalesce(F.size(F.col(gone_name)).cast("long"), F.lit(0)).alias(n_removed),
    )


def _without(text: Column, pieces: Column, gone: Column) -> Column:
    """Lines at places that are not gone; a hash set, not a scan per line."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(pieces, i)), "\n")
    return F.when(gone.isNull(), text).otherwise(kept)
