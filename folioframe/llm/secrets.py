"""Secrets in text: fixed patterns, and a battery of randomness tests over long tokens.

All of it is DataFrame work. One pass over the texts yields, per match, the length of the gap before it and the match itself; places are running
sums over those few rows. Other long tokens are candidates: their encoding is inferred (hexadecimal, base 32, base 62, base 64), and
three tests look for structure in the symbol numbers: chi-squared against a uniform alphabet, runs above and below the
middle, and lag-one serial correlation. A token's p-value is the smallest of the three, times three. Which tokens count as structured is decided per
length class by the Benjamini-Hochberg rule over all candidates of the corpus, read from a histogram of p-values (a bounded number of
bins), so random strings are lost at a controlled rate at every length. Tokens that stay unstructured are reported as `random`.

Defined results: a null text is empty; repeated rows are searched each; spans count code points, end exclusive; random spans never overlap pattern
spans; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut_lineage

KINDS = ("assign", "access", "hex", "random")
# Fixed patterns of the contract: whole match, then the group whose length counts, and the least length.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{32,})"
# A token of 20 or more symbols with a digit or an inner capital.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9]|[A-Za-z+/_-]*[a-z][A-Z])([A-Za-z0-9+/_-]{20,})={0,2}"
PATTERNS = ((ASSIGN, 8), (ACCESS, 16), (HEX, 32), (TOKEN, 20))
FALSE_DISCOVERY_RATE = 0.05
BINS_PER_DECADE, LAST_BIN = 20, 139


def _matches(body: Column, kind: int) -> Column:
    """Array of (kind, nth, gap, size, value) for the matches of one pattern, left to right; \\G keeps the scan linear."""
    pattern = PATTERNS[kind][0]
    scan = F.lit(rf"(?s)\G(.*?)({pattern})")
    part = lambda i: F.regexp_extract_all(body, scan, F.lit(i))
    zipped = F.arrays_zip(
        F.transform(part(1), lambda g: F.length(g)).alias("gap"), F.transform(part(2), lambda h: F.length(h)).alias("size"), part(3).alias("value"),
    )
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value")))
    return F.when(body.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,value:string>>"))


def matches(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rid, keep columns and (kind, start, stop, value) per match; one row with a null kind for a row without matches."""
    kept = [F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)]
    texts = docs.select(*kept, F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col("text"), F.lit("")).alias("body"))
    rows = texts.select("rid", *[f"__keep{i}" for i in range(len(keep))], F.explode_outer(F.concat(*[_matches(F.col("body"), k) for k in range(len(PATTERNS))])).alias("m"))
    rows = rows.select("rid", *[f"__keep{i}" for i in range(len(keep))], "m.*")
    before = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(before)
    placed = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    least = F.element_at(F.array(*[F.lit(n) for _, n in PATTERNS]), F.col("kind") + 1)
    # A failing match is dropped only now, after it took its place in the scan; the row itself stays.
    good = F.col("kind").isNotNull() & (F.length("value") >= least)
    named = {c: F.when(good, F.col(c)).alias(c) for c in ("kind", "start", "stop", "value")}
    return placed.select("rid", *[f"__keep{i}" for i in range(len(keep))], *named.values())


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value is above z, by a rational approximation good to 1e-7."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(candidates: DataFrame) -> DataFrame:
    """`candidates` (with `value`) and encoding, n_symbols, p: the smallest p-value of the three tests, corrected for three."""
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    alphabets = {"decimal": digits, "hex": digits + "abcdef", "base32": up + "234567", "base62": up + low + digits, "base64": up + low + digits + "+/"}
    v = F.regexp_replace("value", "=+$", "")
    encoding = (
        F.when(v.rlike("^[0-9]+$"), "decimal").when(v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(v.rlike("^[A-Z2-7]+$"), "base32")
        .when(v.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64")
    )
    df = candidates.withColumn("encoding", encoding)
    df = df.withColumn("plain", F.when(F.col("encoding") == "hex", F.lower(v)).otherwise(F.translate(v, "-_", "+/")))
    letters = F.element_at(F.create_map(*[F.lit(x) for pair in alphabets.items() for x in pair]), F.col("encoding"))
    df = df.withColumn("letters", letters).withColumn("width", F.length("letters")).withColumn("n_symbols", F.length("plain"))
    symbols = F.transform(F.split("plain", ""), lambda c: F.call_function("instr", F.col("letters"), c) - 1)
    df = df.withColumn("xs", symbols)
    zero = F.lit(0.0)
    squares = F.aggregate(F.sequence(F.lit(0), F.col("width") - 1), zero, lambda a, k: a + F.pow(F.size(F.filter("xs", lambda x: x == k)).cast("double"), F.lit(2)))
    high = lambda x: (x * 2 >= F.col("width")).cast("int")
    nxt = lambda i: F.get(F.col("xs"), i + 1)
    df = df.withColumns({
        "squares": squares,
        "s1": F.aggregate("xs", zero, lambda a, x: a + x),
        "s2": F.aggregate("xs", zero, lambda a, x: a + x * x),
        "n_high": F.aggregate("xs", zero, lambda a, x: a + high(x)),
        "s12": F.aggregate(F.transform("xs", lambda x, i: x * F.coalesce(nxt(i), F.get(F.col("xs"), F.lit(0)))), zero, lambda a, x: a + x),
        "runs": F.aggregate(F.transform("xs", lambda x, i: F.when(nxt(i).isNotNull() & (high(x) != high(nxt(i))), 1).otherwise(0)), F.lit(1.0), lambda a, x: a + x),
    })
    n, freedom = F.col("n_symbols").cast("double"), (F.col("width") - 1).cast("double")
    chi = F.col("width") * F.col("squares") / n - n
    z_chi = (F.pow(chi / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    n1, n2 = F.col("n_high"), n - F.col("n_high")
    mean = 2 * n1 * n2 / n + 1
    z_runs = (F.col("runs") - mean) / F.sqrt((mean - 1) * (mean - 2) / (n - 1))
    p_runs = F.when((n1 < 1) | (n2 < 1) | (mean <= 2), 0.0).otherwise(2 * _upper_tail(F.abs(z_runs)))
    spread = n * F.col("s2") - F.col("s1") * F.col("s1")
    r = (n * F.col("s12") - F.col("s1") * F.col("s1")) / spread
    z_serial = (r + 1 / (n - 1)) * (n - 1) / F.sqrt(n * (n - 3) / (n + 1))
    p_serial = F.when(spread <= 0, 0.0).otherwise(2 * _upper_tail(F.abs(z_serial)))
    p = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), p_runs, p_serial))
    return df.withColumn("p", F.when(F.col("encoding") == "decimal", 0.0).otherwise(p)).select(*candidates.columns, "encoding", "n_symbols", "p")


def unstructured(tested: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Rows of `tested` that the Benjamini-Hochberg rule does not call structured, decided inside each length class."""
    bin_of = F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(F.col("p"), F.lit(1e-30))) * BINS_PER_DECADE)).cast("int")
    size_class = F.least(F.lit(8), F.floor(F.log2(F.col("n_symbols") / 5.0))).cast("int")
    binned = tested.withColumn("p_bin", bin_of).withColumn("size_class", size_class)
    held = binned.groupBy("size_class", "p_bin").agg(F.count(F.lit(1)).alias("n"))  # at most 9 * 140 rows
    per_class = Window.partitionBy("size_class")
    at_least = F.sum("n").over(per_class.orderBy(F.col("p_bin").desc()))
    edge = F.pow(F.lit(10.0), -F.col("p_bin") / F.lit(float(BINS_PER_DECADE)))
    passing = held.withColumn("k", at_least).withColumn("m", F.sum("n").over(per_class)).where(edge * F.col("m") <= rate * F.col("k"))
    limits = passing.groupBy("size_class").agg(F.min("p_bin").alias("from_bin"))
    return binned.join(F.broadcast(limits), "size_class", "left").where(F.col("from_bin").isNull() | (F.col("p_bin") < F.col("from_bin"))).drop("from_bin", "p_bin", "size_class")


def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """keep columns and `spans`, an array of (start, kind, stop, furthest stop before it) by start, then kind, for every row."""
    placed = cut_lineage(matches(docs, keep))
    kept = [f"__keep{i}" for i in range(len(keep))]
    by_start = Window.partitionBy("rid").orderBy("start", "kind")
    fixed = F.col("kind") < 3
    ahead = F.max(F.when(fixed, F.col("stop"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(fixed, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(ahead, F.lit(-1)) <= F.col("start")) & (F.coalesce(behind, F.col("stop")) >= F.col("stop"))
    found = placed.where(F.col("kind").isNotNull()).withColumn("clear", clear)
    secret = unstructured(battery(found.where((F.col("kind") == 3) & F.col("clear"))), rate)
    spans = found.where(fixed).select("rid", "start", "kind", "stop").unionByName(secret.select("rid", "start", "kind", "stop"))
    spans = spans.withColumn("before", F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    listed = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop", "before"))).alias("spans"))
    rows = placed.groupBy("rid").agg(*[F.first(c).alias(c) for c in kept])
    empty = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint,before:bigint>>")
    return rows.join(listed, "rid", "left").select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)], F.coalesce(F.col("spans"), empty).alias("spans"),
    )


def spell(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap give one mark."""
    opens = F.filter(spans, lambda s: s["start"] >= s["before"])
    before = lambda s: F.substring(text, (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int"))
    end = F.array_max(F.transform(spans, lambda s: s["stop"]))
    tail = F.substring(text, (end + 1).cast("int"), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(F.transform(opens, lambda s: F.concat(before(s), F.lit(mark))), ""), tail))
