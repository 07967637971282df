"""Text normalisation and fuzzy comparison.

Everything runs in the JVM except three Arrow functions: compatibility normalisation, the
sequence-matcher ratio and pattern search with Python syntax. Rows that do not need them send a null.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters dropped from anchors, thresholds of anchor matching, label words kept in noise.
ZERO_WIDTH = "​‌‍﻿"
EXACT_THRESHOLD = 0.95
DEFAULT_THRESHOLD = 0.70
SIMILARITY_GUARD = 0.25
WORD = r"\p{L}\p{N}_"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFKC", value), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)],
        dtype="float64",
    )


@F.pandas_udf(T.BooleanType())
def _pattern_found(pattern: pd.Series, text: pd.Series) -> pd.Series:
    def search(p, t):
        if p is None or t is None:
            return None
        try:
            return re.search(p, t, flags=re.IGNORECASE) is not None
        except re.error:
            return False

    return pd.Series([search(p, t) for p, t in zip(pattern, text)], dtype="object")


def nfkc(text: Column) -> Column:
    """Compatibility normal form; plain ASCII never leaves the JVM."""
    foreign = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(foreign, text)), text)


def anchor_form(text: Column) -> Column:
    """Lower case without blanks and zero-width characters."""
    plain = F.translate(nfkc(F.coalesce(text, F.lit(""))), ZERO_WIDTH, "")
    return F.regexp_replace(F.lower(plain), r"(?U)\s+", "")


def similarity_form(anchor: Column) -> Column:
    """Only letters, digits and underscores of an anchor form."""
    return F.regexp_replace(anchor, f"[^{WORD}]", "")


def ratio_bound(a: Column, b: Column) -> Column:
    """Upper bound of the sequence ratio from lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))


def sequence_ratio(a: Column, b: Column, wanted: Column) -> Column:
    """Sequence-matcher ratio where wanted; null elsewhere."""
    both = (F.length(a) > 0) & (F.length(b) > 0)
    value = _sequence_ratio(F.when(wanted & both & (a != b), a), F.when(wanted & both & (a != b), b))
    return (
        F.when(wanted & (a == b), F.lit(1.0))
        .when(wanted & ~both, F.lit(0.0))
        .otherwise(value)
    )


def normalised_readings(readings: DataFrame) -> DataFrame:
    """Adds the anchor and similarity forms of expected_text and actual_text."""
    forms = readings.withColumn("expected", anchor_form(F.col("expected_text"))).withColumn(
        "actual", anchor_form(F.col("actual_text"))
    )
    return forms.withColumn("expected_key", similarity_form(F.col("expected"))).withColumn(
        "actual_key", similarity_form(F.col("actual"))
    )


def score_readings(readings: DataFrame) -> DataFrame:
    """Anchor match scores by match type.

    A pair whose length bound stays below the guard scores 0 whatever its ratio is, so the ratio is only
    computed for the rest; text_similarity is null for pairs decided that way.
    """
    base = normalised_readings(readings)
    kind = F.lower(F.trim(F.coalesce("match_type", F.lit("contains"))))
    base = base.withColumn("kind", F.when(kind.isin("exact", "regex", "fuzzy"), kind).otherwise("contains"))
    settled = (
        (F.col("expected") == "")
        | (F.col("actual") == "")
        | (F.col("kind") == "regex")
        | ((F.col("kind") == "exact") & (F.col("expected") == F.col("actual")))
        | ((F.col("kind") == "contains") & F.contains(F.col("actual"), F.col("expected")))
    )
    bound = ratio_bound(F.col("expected_key"), F.col("actual_key"))
    wanted = ~settled & (bound >= SIMILARITY_GUARD - 1e-4)
    literal = ~F.col("expected").rlike(r"[.^$*+?{}\[\]\\|()]")
    search = (F.col("kind") == "regex") & (F.col("expected") != "") & (F.col("actual") != "")
    found = _pattern_found(F.when(search & ~literal, F.col("expected")), F.when(search & ~literal, F.col("actual")))
    scored = base.withColumn("ratio", sequence_ratio(F.col("expected_key"), F.col("actual_key"), wanted)).withColumn(
        "found", F.coalesce(found, F.when(search, F.contains(F.col("actual"), F.col("expected"))))
    )
    share = "length(actual_key) / greatest(length(expected_key), 1)"
    raw = F.expr(f"""
      CASE WHEN expected = '' OR actual = '' THEN 0D
           WHEN kind = 'exact' THEN CASE WHEN actual = expected THEN 1D ELSE ratio END
           WHEN kind = 'regex' THEN CASE WHEN found THEN 1D ELSE 0D END
           WHEN kind = 'fuzzy' THEN ratio
           WHEN contains(actual, expected) THEN 1D
           WHEN contains(expected, actual) AND {share} >= 0.75 THEN greatest(ratio, 0.90D)
           WHEN contains(expected, actual) AND {share} >= 0.50 THEN greatest(ratio, 0.70D)
           WHEN contains(expected, actual) THEN ratio
           WHEN ratio >= 0.70 THEN greatest(ratio, 0.75D) ELSE ratio END""")
    limit = F.expr(
        f"CASE WHEN kind = 'exact' AND expected <> '' AND actual <> ''"
        f" THEN greatest(coalesce(nullif(threshold, 0D), {DEFAULT_THRESHOLD}D), {EXACT_THRESHOLD}D)"
        f" ELSE coalesce(nullif(threshold, 0D), {DEFAULT_THRESHOLD}D) END"
    )
    similarity = F.floor(raw * 10000 + 0.5) / 10000.0
    out = scored.withColumn("text_similarity", similarity).withColumn("limit", limit)
    out = out.withColumn(
        "score", F.when(F.col("text_similarity") >= SIMILARITY_GUARD, F.col("text_similarity")).otherwise(F.lit(0.0))
    ).withColumn("passed", F.col("score") >= F.col("limit"))
    reason = (
        F.when(F.col("passed"), "passed")
        .when(F.col("text_similarity") >= SIMILARITY_GUARD, "below_threshold")
        .otherwise("low_text_similarity")
    )
    return out.withColumn("failure_reason", reason).drop("ratio", "found")


# Noise characters of scanned lines, Thai letters, words that keep a following single letter.
NOISE = r".·•…_\-=~*|/\\:;,"
THAI = "ก-๛"
LABEL_WORDS = ("ประเภท", "type", "class", "grade", "group", "category", "หมวด", "กลุ่ม", "ระดับ")
BLANKS = r"[ \t\r\f\x0B]+"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def squeeze_lines(text: Column) -> Column:
    """Trim and squeeze blanks per line, drop blank lines."""
    lines = F.transform(F.split(text, LINE_ENDS), lambda l: F.trim(F.regexp_replace(l, BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def drop_noise(text: Column) -> Column:
    """Remove runs of dots and dashes, punctuation-only lines and tokens, and stray letters in Thai lines."""
    word = WORD + THAI
    run = rf"(?U)(?<![{word}])[\s{NOISE}]{{3,}}(?![{word}])"

    def clean_line(line: Column) -> Column:
        spaced = F.trim(F.regexp_replace(F.regexp_replace(line, run, " "), BLANKS, " "))
        dotted = (F.length(spaced) >= 2) & spaced.rlike(rf"(?U)^[\s{NOISE}]+$")
        tokens = F.filter(F.split(spaced, " "), lambda t: (t != "") & ~t.rlike(rf"^[{NOISE}]{{2,}}$"))

        def keep(kept: Column, token: Column) -> Column:
            # A lone letter stays only behind a label word.
            before = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")), "^[ :：-]+|[ :：-]+$", ""))
            stray = token.rlike("^[A-Za-z]$") & ~before.isin(*LABEL_WORDS)
            return F.when(stray, kept).otherwise(F.concat(kept, F.array(token)))

        thai = F.aggregate(tokens, F.array().cast("array<string>"), keep)
        words = F.when(spaced.rlike(f"[{THAI}]"), thai).otherwise(tokens)
        return F.when(dotted, F.lit("")).otherwise(F.array_join(words, " "))

    lines = F.transform(F.split(text, LINE_ENDS), clean_line)
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")


def normalise_text(text: Column, cleanup: bool = True) -> Column:
    """Compatibility form, squeezed lines and, unless switched off, noise removal."""
    squeezed = squeeze_lines(nfkc(F.coalesce(text, F.lit(""))))
    return drop_noise(squeezed) if cleanup else squeezed
