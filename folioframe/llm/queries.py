"""The registered queries of the text operators, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe, language, lines, lm, ngram_join, packing, pair_bpe, prefix_trie, quality, secrets, substring, topk, vector_codes
from folioframe.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS tokens FROM d),
p AS (SELECT rid, unnest(generate_series(1, len(tokens) - 4)) AS i, tokens FROM w WHERE len(tokens) >= 5),
g AS (SELECT rid, i, array_to_string(tokens[i:i + 4], ' ') AS g FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c >= 2),
c AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(generate_series(i, i + 4)) AS at FROM r) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, CAST(len(tokens) AS BIGINT) AS n_words, CAST(length(array_to_string(tokens, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(body, '[^!]+', '', 'g')) AS n_exclaim,
         length(regexp_replace(body, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(body, '[^\p{L}]+', '', 'g')) AS n_letters
  FROM d JOIN w USING (rid) LEFT JOIN c USING (rid) LEFT JOIN l USING (rid)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END) + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_exclaim > 50 * n_words THEN 16 ELSE 0 END) + (CASE WHEN n_letters >= 20 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 100 * n_letters < 25 * word_chars THEN 128 ELSE 0 END) AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


@query("op1_quality_rules", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document and the verdict of the strict policy."""
    entries = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), "strict@1")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", "base_failed", "kept",
    )


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    dictionaries = language.fit(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text"), dictionaries).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected",
    )


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    both = bpe.decode(encoded, path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS tokens FROM documents),
p AS (SELECT rid, doc_id, unnest(generate_series(1, len(tokens) - 49)) AS i, tokens FROM d WHERE len(tokens) >= 50),
h AS (SELECT rid, doc_id, i, md5(array_to_string(tokens[i:i + 49], ' ')) AS h FROM p),
f AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE doc_id > first),
c AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 49)) AS place FROM f),
g AS (SELECT rid, count(*) AS n, list(place) AS gone FROM c GROUP BY rid)
SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN tokens
         ELSE list_transform(list_filter(generate_series(1, len(tokens)), lambda x: NOT list_contains(gone, x)), lambda x: tokens[x]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""


@query("op5_substring_dedup", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that an earlier one starts too."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op6_exact_topk", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every 50th one."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and frequency scores of every document, learned from the nine tenths that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    scored = lm.score(docs, docs.where(~held_out), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return scored.withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: those of the fixed patterns as counts and a digest, and all of them spelled out."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.spell(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        secrets.spell(F.col("spans")).alias("spans"),
    )


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, source, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS place FROM d),
w AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT line, min(doc_id) AS first FROM w GROUP BY line HAVING count(DISTINCT source) >= 10),
g AS (SELECT rid, list(place) AS gone, count(*) AS n FROM w JOIN s USING (line) WHERE doc_id > first GROUP BY rid),
c AS (SELECT rid, count(*) AS n_lines FROM w GROUP BY rid)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n, 0) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN coalesce(text, '')
         ELSE array_to_string(list_transform(list_filter(generate_series(1, len(lines)), lambda x: NOT list_contains(gone, x)), lambda x: lines[x]), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g USING (rid) LEFT JOIN c USING (rid)
"""


@query("op9_line_dedup", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that ten or more sources share, which stay in the first document only."""
    kept = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


@query("op10_ngram_jaccard")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose word 5-gram sets are at least three quarters alike."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_pair_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the tokenizer file and the text they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = pair_bpe.decode(pair_bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Twin of the product codes; each round is one more pair of common table expressions."""
    sql = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)),
p AS (SELECT rid, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x FROM k, range({parts}) t(part)),
b0 AS (SELECT part, rid - 1 AS entry, x AS e FROM p WHERE rid <= {entries})"""
    for i in range(rounds + 1):
        sql += f""",
d{i} AS (SELECT rid, p.part, entry, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - e[i]) * (x[i] - e[i]))) AS far FROM p JOIN b{i} b ON p.part = b.part),
a{i} AS (SELECT rid, part, arg_min(entry, far * 1000 + entry) AS entry, min(far) AS far, any_value(x) AS x FROM d{i} GROUP BY rid, part)"""
        if i < rounds:
            sql += f""",
m{i} AS (SELECT part, entry, list(CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY place) AS e FROM (
  SELECT part, entry, place, sum(c) AS total, count(*) AS n FROM (SELECT part, entry, unnest(x) AS c, unnest(range(1, len(x) + 1)) AS place FROM a{i}) GROUP BY part, entry, place) GROUP BY part, entry),
b{i + 1} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN m{i} m ON b.part = m.part AND b.entry = m.entry)"""
    return sql + f""",
c AS (SELECT rid, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
s AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN c USING (rid), s
"""


@query("op12_vector_codes", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(None).cast("string")
    for n, of_length in books.items():
        digest = F.when(F.col("n") == n, vector_codes.digest(of_length)).otherwise(digest)
    return coded.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'h': md5(md5(role) || md5(text)), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY i) AS turns FROM t GROUP BY c),
-- crc32 bit by bit: a step of -1 shifts, any other value is a byte to mix in
k AS (SELECT c, xor(list_reduce([4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM o),
r AS (SELECT o.c, coalesce(b.turns[1:h], []) || o.turns[h + 1:] AS turns FROM o JOIN k USING (c) LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM r),
q AS (SELECT c, depth, len(turns) AS total, [x.h for x in turns[1:depth]] AS path, CASE WHEN depth = 0 THEN 0 ELSE turns[depth].w END AS w FROM p),
n AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE total = depth), '')) AS ends_sha256 FROM q GROUP BY path, depth),
m AS (SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children FROM n
      LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = n.path[1:n.depth - 1]
      LEFT JOIN (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1) k ON k.path = n.path),
z AS (SELECT a.path[1:d] AS path, d AS depth, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * w) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) a GROUP BY 1, 2)
SELECT conv_id, m.depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM m JOIN z ON z.path = m.path AND z.depth = m.depth
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
