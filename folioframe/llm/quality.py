"""Rule bitmask ledger: every rule is evaluated once per document, policies and ablations then read bits only.

All of it is DataFrame work. Measurements come from whole texts; a rule is one bit, failures are one integer, a policy
is a named, versioned mask, and an ablation is an aggregate over distinct failure patterns (at most one row per pattern).

Defined results: a null or blank text has no words and fails `too_short`; repeated rows are judged row by row; a null
doc_id is passed through; an empty table gives an empty ledger; other columns of the input, whatever their names, are
neither read nor returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import words

SHINGLE = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_upper", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("too_short", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "100 * n_symbols > 20 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule("exclamation", "100 * n_exclaim > 50 * n_words"),
    Rule("capitals", "n_letters >= 20 AND 100 * n_upper > 60 * n_letters"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("few_letters", "100 * n_letters < 25 * word_chars"),
)
BASE = ("too_short", "repeated_windows")
#: Versioned policies: the rules that count. A ledger written once serves all of them.
POLICIES = {
    "base@1": BASE,
    "strict@1": tuple(r.name for r in RULES),
    "lines@1": (*BASE, "repeated_lines"),
}


def mask_of(rule_names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bits[n] for n in set(rule_names))


def _count_of(text: Column, kept: str) -> Column:
    """How many characters of a class a text has; `kept` is the complement class."""
    return F.length(F.regexp_replace(text, kept, "")).cast("long")


def _repeated_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from `tokens`: words lying in a 5-word window that the text holds at least twice.

    Window hashes settle most texts: all distinct means no repeat. Otherwise (hash, place) packed in one long is sorted,
    neighbours of equal hash are the only candidates, and those are compared word by word, so a collision changes nothing.
    """
    at = lambda array, i: F.get(F.col(array), i)
    df = df.withColumn("word_keys", F.transform("tokens", lambda w: F.xxhash64(w)))
    inner = F.slice("word_keys", F.lit(1), F.greatest(F.lit(0), F.size("word_keys") - (SHINGLE - 1)))
    df = df.withColumn(
        "window_keys",
        F.transform(inner, lambda x, i: F.xxhash64(x, *[at("word_keys", i + k) for k in range(1, SHINGLE)])),
    )
    df = df.withColumn("repeats", F.size(F.array_distinct("window_keys")) < F.size("window_keys"))
    df = df.withColumn("place_bits", F.length(F.bin(F.size("window_keys").cast("long"))))
    packed = F.transform(
        "window_keys",
        lambda h, i: F.call_function("shiftleft", h, F.col("place_bits")).bitwiseOR(i.cast("long")),
    )
    none = F.array().cast("array<bigint>")
    df = df.withColumn("ranked", F.when(F.col("repeats"), F.sort_array(packed)).otherwise(none))
    key = lambda x: F.call_function("shiftrightunsigned", x, F.col("place_bits"))
    near = lambda x, i: F.coalesce(key(x) == key(at("ranked", i - 1)), F.lit(False)) | F.coalesce(key(x) == key(at("ranked", i + 1)), F.lit(False))
    df = df.withColumn("likely", F.filter("ranked", near))
    place = lambda x: (x - F.call_function("shiftleft", key(x), F.col("place_bits"))).cast("int")
    df = df.withColumn(
        "exact",
        F.sort_array(F.transform("likely", lambda x: F.struct(F.slice("tokens", place(x) + 1, SHINGLE).alias("w"), place(x).alias("p")))),
    )
    same = lambda x, i: F.coalesce(x["w"] == at("exact", i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == at("exact", i + 1)["w"], F.lit(False))
    df = df.withColumn("places", F.sort_array(F.transform(F.filter("exact", same), lambda x: x["p"])))
    spans = F.transform("places", lambda p, i: F.least(F.lit(SHINGLE), F.coalesce(at("places", i + 1) - p, F.lit(SHINGLE))))
    return df.withColumn("n_repeat_words", F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of `docs`: the `keep` columns, all measurements and `fail_bits`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    renamed = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    df = docs.select(*renamed, text.alias("body")).withColumn("tokens", words(F.col("body")))
    # A line with a word, at most once per line: the anchor holds only at line starts, so blank runs stay linear.
    lines = F.regexp_extract_all(F.col("body"), F.lit(r"(?dm)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"), F.lit(0))
    df = df.withColumn("lines", lines)
    df = _repeated_words(df)
    measures = F.struct(
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        _count_of(F.col("body"), r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
        _count_of(F.col("body"), r"[^!]+").alias("n_exclaim"),
        _count_of(F.col("body"), r"[^\p{Lu}]+").alias("n_upper"),
        _count_of(F.col("body"), r"[^\p{L}]+").alias("n_letters"),
    )
    # The generator is a fence: a later filter on a verdict must not be pushed into the measurements and repeat them.
    df = df.select(*[f"__keep{i}" for i in range(len(keep))], F.explode(F.array(measures)).alias("m")).select(*[f"__keep{i}" for i in range(len(keep))], "m.*")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return df.select(
        *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)],
        *MEASURES, bits.alias("fail_bits"),
    )


def apply_policy(entries: DataFrame, policy: str = "strict@1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `base_failed` and the verdict `kept` of one policy; no rule is evaluated again."""
    base, mask = mask_of(BASE, rules), mask_of(POLICIES[policy], rules)
    failed = F.col("fail_bits").bitwiseAND(base) != 0
    return entries.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("fail_bits").bitwiseAND(mask) == 0))


def ablations(entries: DataFrame, policy: str = "strict@1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: how many documents fail it, fail nothing else, and pass once it is taken out.

    Failure patterns are counted first, so the rules meet at most one row per pattern, not per document.
    """
    mask = mask_of(POLICIES[policy], rules)
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1])
    each = patterns.withColumn("r", F.explode(listed)).select("bits", "n", "r.rule", "r.bit")
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule", "bit").agg(
        hit(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        hit(F.col("bits") == F.col("bit")).alias("n_only_this"),
        hit(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
    )
