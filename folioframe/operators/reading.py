"""Reading order of detected text boxes and the text of a region read segment by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioframe.functions.geometry import PIXEL
from folioframe.functions.numeric import rnd_sql, units
from folioframe.operators.spatial import PIXEL_TILE
from folioframe.operators.suppress import DETECTED_DUPLICATE, greedy_keep

# Tolerance of a line against the tallest box, and the length a reading needs.
LINE_SHARE = 0.6
SHORT_TEXT = 2


def sort_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes without duplicates in reading order: the first line near enough takes a box, lines by centre.

    A vertical gap above the largest possible tolerance separates lines for good, so each stretch between
    such gaps is folded on its own; boxes that survived deduplication cannot pile up inside one.
    """
    kept = greedy_keep(boxes, ["group_id"], "box_id", PIXEL, PIXEL_TILE, DETECTED_DUPLICATE)
    tall = kept.groupBy("group_id").agg(F.expr(f"greatest(8D, max(height) * {LINE_SHARE}D)").alias("reach"))
    centred = kept.withColumn("cy", F.expr("y + height / 2"))
    levels = centred.select("group_id", "cy").distinct().join(tall, "group_id")
    order = W.partitionBy("group_id").orderBy("cy")
    stretches = levels.withColumn("opens", F.when(F.col("cy") - F.lag("cy").over(order) > F.col("reach"), 1).otherwise(0)).withColumn(
        "stretch", F.sum("opens").over(order)
    ).select("group_id", "cy", "stretch")
    packed = centred.join(stretches, ["group_id", "cy"]).groupBy("group_id", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("cy", "x", "box_id", "height"))).alias("items")
    )
    line = "struct<s:double,n:bigint,h:double>"
    fold = f"""aggregate(items, named_struct('lines', cast(array() AS array<{line}>), 'picks', cast(array() AS array<int>)), (a, e) ->
      element_at(transform(array(cast(array_position(transform(a.lines, l -> abs(e.cy - l.s / l.n) <= greatest(8D, greatest(l.h, e.height) * {LINE_SHARE}D)), true) AS int)), hit ->
        named_struct(
          'lines', CASE WHEN hit = 0 THEN concat(a.lines, array(named_struct('s', e.cy, 'n', 1L, 'h', e.height)))
             ELSE transform(a.lines, (l, i) -> CASE WHEN i + 1 = hit THEN named_struct('s', l.s + e.cy, 'n', l.n + 1, 'h', greatest(l.h, e.height)) ELSE l END) END,
          'picks', concat(a.picks, array(CASE WHEN hit = 0 THEN size(a.lines) + 1 ELSE hit END)))), 1))"""
    folded = packed.withColumn("f", F.expr(fold)).selectExpr(
        "group_id", "inline(transform(items, (e, i) -> named_struct('box_id', e.box_id, 'x', e.x, 'centre', get(f.lines, get(f.picks, i) - 1).s / get(f.lines, get(f.picks, i) - 1).n)))"
    )
    final = W.partitionBy("group_id").orderBy("centre", "x", "box_id")
    return folded.select("group_id", "box_id", F.row_number().over(final).alias("place"))


def region_texts(segments: DataFrame) -> DataFrame:
    """One text per region: segments joined in order, mean confidence of the non-empty ones, fallback flag.

    segments: roi_id, place, text, confidence, fallback.
    """
    spoken = F.trim("text") != ""
    return segments.groupBy("roi_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(CASE WHEN trim(text) <> '' THEN struct(place, trim(text) AS t) END)), s -> s.t), ' ')").alias("text"),
        F.count_if(spoken).alias("recognized"), F.count_if(~spoken).alias("empty"),
        F.sum(F.when(spoken, units(F.col("confidence"), 4))).alias("total"), F.max("fallback").alias("fallback"),
    ).selectExpr(
        "roi_id", "text", "recognized", "empty", rnd_sql("coalesce(total / 10000D / nullif(recognized, 0), 0D)", 4) + " AS confidence",
        f"NOT fallback AND length(text) <= {SHORT_TEXT} AS needs_full_reading",
    )
