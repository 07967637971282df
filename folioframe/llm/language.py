"""Language by compression: the zstandard dictionary of a language that makes a text smallest names it.

Fitting reads labelled rows: per language at most 2 * `sample_rows` distinct texts are drawn by a hash of the text, so neither null nor repeated
keys matter, and fill a raw-content dictionary of at most `dictionary_bytes`; a text that does not fit any more is passed over. A text longer
than an eighth of the dictionary gives eight pieces of whole words spread over it, at most as long as that eighth together.
Prediction reads every whole text and nothing but the text. The margin between the smallest and the second smallest size, as a
share of the second, is the score; a margin below `reject_below` marks the row as rejected, its best guess is kept.

Texts are compared as lower-case letter runs, so marks, digits and capitals weigh the same in every language.

Defined results: `und`, score 0 and rejected for a null text or one without a letter; ties go to the language that sorts first;
without any labelled row every text is `und`; repeated rows and null keys are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import fresh, slices

UNKNOWN = "und"
PIECES = 8


def letters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+", " "))


def draw_texts(labelled: DataFrame, sample_rows: int, most_chars: int) -> DataFrame:
    """(lang, draw, body): at most 2 * sample_rows distinct texts a language, long ones as `PIECES` spread pieces of `most_chars` together."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("draw"), "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()}
    if not counts:
        return rows.select("lang", "draw", F.col("text").alias("body"))
    # The share is a little larger than the bound asks for, because the counts are estimates; the rank is the bound.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1 << 30, (3 * sample_rows << 30) // max(1, n) + 1))])
    drawn = rows.where(F.pmod("draw", F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("lang", "draw", letters(F.col("text")).alias("body"))
    drawn = drawn.groupBy("lang", "body").agg(F.min("draw").alias("draw"))  # texts of the same letters once
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("draw", F.lit(1 << 30)), "draw", "body"))
    kept = drawn.withColumn("nth", nth).where(F.col("nth") <= 2 * sample_rows).drop("nth")
    piece = max(1, most_chars // PIECES - 1)
    length = F.length("body")
    at = [(F.lit(1) + F.floor((length - piece) * i / (PIECES - 1))).cast("int") for i in range(PIECES)]
    # Pieces lose the words they cut.
    spread = F.concat_ws(" ", *[F.regexp_replace(F.substring("body", start, F.lit(piece)), "^[^ ]* | [^ ]*$", "") for start in at])
    return kept.select("lang", "draw", F.when(length <= most_chars, F.col("body")).otherwise(spread).alias("body"))


def fit(labelled: DataFrame, sample_rows: int = 400, dictionary_bytes: int = 96 << 10) -> dict[str, bytes]:
    """Dictionary content per language, from a hash-drawn sample of at most 2 * sample_rows texts a language."""
    found: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for row in sorted(draw_texts(labelled, sample_rows, dictionary_bytes // 8).collect(), key=lambda r: (r["lang"], r["draw"] % (1 << 30), r["body"])):
        body = row["body"].encode("utf-8", "surrogatepass") + b" "
        if size.get(row["lang"], 0) + len(body) <= dictionary_bytes:
            found.setdefault(row["lang"], []).append(body)
            size[row["lang"]] = size.get(row["lang"], 0) + len(body)
    return {lang: b"".join(found[lang]) for lang in sorted(found) if size[lang] >= 8}


def predict(docs: DataFrame, dictionaries: dict[str, bytes], level: int = 3, reject_below: float = 0.02,
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, lang_pred, score and rejected for every row."""
    text = fresh(docs, "letters")
    source = docs.select(*keep, letters(F.col("text")).alias(text))
    schema = source.drop(text).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches):
        coders = []
        for lang, content in dictionaries.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            coders.append((lang, zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False)))

        def judge(body: str) -> tuple[str, float, bool]:
            if not body or not coders:
                return UNKNOWN, 0.0, True
            raw = body.encode("utf-8", "surrogatepass")
            sizes = sorted((len(coder.compress(raw)), lang) for lang, coder in coders)
            second = sizes[1][0] if len(sizes) > 1 else len(raw)
            margin = min(1.0, max(0.0, (second - sizes[0][0]) / max(1, second)))
            return sizes[0][1], margin, margin < reject_below

        for batch in batches:
            for part in slices(batch, text):
                at = part.schema.get_field_index(text)
                judged = [judge(t) for t in part.column(at).to_pylist()]
                columns = [c for i, c in enumerate(part.columns) if i != at]
                extra = [pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64()), pa.array([j[2] for j in judged], pa.bool_())]
                names = [n for n in part.schema.names if n != text]
                yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, "lang_pred", "score", "rejected"])

    return source.mapInArrow(run, schema)
