"""Tokenizer-file BPE, product codes and prefix tries against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
from compare import rows_of
from pyspark.sql import functions as F

from folioframe.llm import common, pair_bpe, prefix_trie, queries, vector_codes

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of([tuple(r) for r in df.collect()], df.columns) == rows_of(result.fetchall(), names)


# --- op11 ---

def test_pair_bpe_as_the_library(spark):
    """Plain call of the library, literals of added tokens and characters that regex libraries disagree about included."""
    library = tokenizers.Tokenizer.from_file(MODEL)
    rng = random.Random(4)
    bits = [*"abcdeT   \n\n\t'sd1239.,!-", "<|endoftext|>", " <|endoftext|>", "\x1c", "\x85", "　", "é", "漢", "😀", "՘", "ᲊ", "‍", "ｆ", "½", "\r", "\x0b", "\x00", " the", "ing"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "x" * 30_000, "ab " * 20_000, "é" * 5_000]
    rows = [(None if i == 3 else i, t, "c", "d") for i, t in enumerate(texts)] + [(7, "again", "c", "d")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string").repartition(4)
    got = pair_bpe.decode(pair_bpe.encode(docs, MODEL), MODEL).collect()

    def want(k, t):
        ids = library.encode(t or "", add_special_tokens=False).ids
        return k, np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)

    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == Counter(want(k, t) for k, t, *_ in rows)
    assert pair_bpe.encode(docs.where("false"), MODEL).count() == 0


def test_pair_bpe_decodes_any_ids():
    library, codec = tokenizers.Tokenizer.from_file(MODEL), pair_bpe.Codec(pair_bpe.read_file(MODEL))
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.randrange(50_257) for _ in range(rng.randint(0, 20))]
        assert codec.decode(np.array(ids, dtype="<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_pair_bpe_pattern_below_the_limit():
    codec = pair_bpe.Codec(pair_bpe.read_file(MODEL))
    for c in map(chr, range(0x530)):
        text = f"a{c}b {c}{c} 1{c}2{c} !{c} c{c}\n{c} "
        assert not pair_bpe.BEYOND.search(text) and codec.pattern(text) == [text[lo:hi] for _, (lo, hi) in codec.library(text)]


def test_remembered_results_are_bounded_in_bytes():
    calls = []
    held = common.Remembered(lambda k: calls.append(k) or k * 2, limit=4000, longest=1000)
    for i in range(200):
        assert held[f"key{i}"] == f"key{i}" * 2
        assert held["often"] == "oftenoften"
    assert held["x" * 5000] == "x" * 10_000 and "x" * 5000 not in held
    assert held.held <= 4000 and calls.count("often") == 1 and len(held) + len(held.older) < 60


# --- op12 ---

def plain_codes(rows, parts, entries, rounds, scale=256):
    """{row number: (code, error, label_error)} and codebooks of rows (key, vector, label) of one length."""
    kept = [(k, [math.floor(scale * x) for x in v], lab, i) for i, (k, v, lab) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width:(p + 1) * width]
    books = [[cut(v, p) for _, v, *_ in kept[:entries]] for p in range(parts)]

    def near(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, *_ in kept:
                groups[near(p, cut(v, p))[0]].append(cut(v, p))
            for e, members in groups.items():
                new[p][e] = [sum(c) // len(members) for c in zip(*members)]
        books = new
    found = {i: [near(p, cut(v, p)) for p in range(parts)] for _, v, _, i in kept}
    error = {i: sum(d for _, d in f) for i, f in found.items()}
    by_label = Counter()
    for _, _, lab, i in kept:
        by_label[lab] += error[i]
    return {i: ("".join(f"{e:02x}" for e, _ in found[i]), error[i], by_label[lab]) for _, _, lab, i in kept}, books


def vector_rows():
    rng = random.Random(8)
    draw = lambda: [round(rng.gauss(0, 0.3), 2) for _ in range(8)]
    rows = [(i * 3 % 101, draw(), i % 3) for i in range(90)]
    rows += [(500 + i, [0.25] * 8, None) for i in range(60)]  # one vector many times, one label for all of them
    rows += [(7, draw(), 1), (7, draw(), 1), (None, draw(), 2), (None, draw(), None), (900, None, 1), (901, [0.1] * 7 + [None], 1),
             (902, [0.1] * 7 + [float("nan")], 1), (903, [float("-inf")] + [0.1] * 7, 1), (904, [-0.001] * 8, 1)]
    return rows


@pytest.mark.parametrize("entries", [12, 200])
def test_vector_codes(spark, entries):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, n int").repartition(6)
    coded, books = vector_codes.compress(df, parts=4, entries=entries)
    want, want_books = plain_codes(rows, 4, entries, 2)
    assert [[list(map(int, e)) for e in b] for b in books[8]] == want_books
    got = Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded.collect())
    assert got == Counter((rows[i][0], *w) for i, w in want.items())


def test_vector_codes_of_other_shapes(spark):
    """Several lengths, one that does not divide, empty vectors, components near the end of 64 bits, an empty table."""
    rows = [(1, [0.5, 1.5, 2.5], 1), (2, [0.5, 1.0, 2.0], 1), (3, [], 2), (4, [1e300, -1e300], 2), (5, [1.0, 2.0], None), (6, [1.0, 2.5], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(df, parts=2, entries=1)
    got = {r["vec_id"]: r for r in coded.collect()}
    assert set(books) == {0, 2, 3} and set(got) == {1, 2, 3, 4, 5, 6}
    assert got[3]["code"] == "0000" and got[3]["error"] == 0 and [len(b[0]) for b in books[3]] == [1, 2]
    assert max(r["error"] for r in got.values()) == vector_codes.TOP
    assert vector_codes.compress(df.where("false"))[0].count() == 0


def test_grid_cells_leave_few_entries():
    rng = np.random.default_rng(2)
    grid, points = vector_codes.Grid(rng.integers(-90, 90, size=(64, 4))), rng.integers(-90, 90, size=(3000, 4))
    best, error = grid.nearest(points)
    far = ((points[:, None] - grid.entries) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert grid.evaluated < 0.4 * grid.asked


# --- op13 ---

def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    count = lambda t: len(t.encode().split())
    out = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        children = {p for p in below if len(p) == len(path) + 1}
        leaves = sum(not any(q[:len(p)] == p and len(q) == len(p) + 1 for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * count(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in who if len(rebuilt[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talk_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(-45, 90), *range(200, 210), 1005, 10**15]:
        said = [rng.choice("ab") for _ in range(rng.randint(1, 5))]
        rows += [(c, i if i else None, "user" if i % 2 == 0 else None, f"word {s} {s}") for i, s in enumerate(said)]
    for c in range(300, 340):  # many copies of one conversation, and of one first turn
        rows += [(c, 0, "user", "hello there"), (c, 1, "bot", "hi")] if c % 4 else [(c, 0, "user", "hello there"), (c, 1, "bot", f"no {c}")]
    rows += [(777, i, "user", f"t {i % 3}") for i in range(120)]  # one conversation over many blocks
    rows += [(800, 1, "b", "x"), (800, 1, "a", "y"), (800, 1, "a", "x"), (800, 1, "a", "x"), (800, None, None, None)]  # ties and repeats
    rows += [(None, 1, "user", "lost"), (None, None, None, None), (911, 0, "user", "one"), (912, 5, None, ""), (913, 2, "", None)]
    return rows


@pytest.mark.parametrize("block, whole", [(1 << 16, 1 << 17), (16, 8)])
def test_prefix_trie(spark, block, whole):
    """Also with blocks so small that conversations, families and chains cross them and the coin rounds run."""
    rows = talk_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, number int, n int").repartition(5)
    got = prefix_trie.trie(df, block, whole)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)
    assert prefix_trie.trie(df.where("false")).count() == 0


def test_packed_ids_hash_as_one_string(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PACKED", 20)
    ends = spark.range(0, 400).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).cast("long").alias("depth"), F.lit(5).cast("long").alias("s1"), F.lit(6).cast("long").alias("s2"))
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends.repartition(7)).collect()}
    assert got == {d: hashlib.sha256(",".join(str(i) for i in range(400) if (i % 3 == 0) == (d == 1)).encode()).hexdigest() for d in (1, 2)}
