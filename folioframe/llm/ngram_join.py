"""Near-duplicate documents by Jaccard similarity of word shingles, bounded by count vectors in R-tree leaves.

A document is the set of its distinct 5-word shingles. Documents with equal sets are one node. The tokens of a node are hashed into `GROUPS` groups; the group
counts are its point. For two points the summed coordinate minima bound the overlap from above, and for two leaves of points the minima of
their upper corners do, so a leaf pair or a pair of points below the needed overlap is dropped without looking at the sets. Pairs that
stay meet a finer bound, marks in about eight to sixteen bits a token, delivered once per cell of a grid of node blocks, and what is left is verified on the
sets themselves.

In many dimensions an R-tree over all points prunes little before its leaves: any two texts of a length are about as far apart as any other
two, and a search visits all leaves. So points meet only where they can be linked at all: two sets with similarity s or more share one of the first
n - ceil(s * n) + 1 tokens in any common order, which loses no link. The order puts tokens that fill crowded counters of a fixed-size table last; the
table is counted over all documents and decides nothing but the order. Points that share a token form a bucket.

Large groups of near copies would make all pairs of a bucket survive. Therefore every node is first verified against the first node of its buckets (one
pair per node, then those still apart), and only buckets that still hold several components go to the leaves, where pairs
of one component are not looked at again. A passage shared by a few documents makes many buckets of the same members; one bucket of each member set is kept,
since the members alone decide which pairs meet.

Defined results: a null or blank text has no shingles, an empty set, and links with nothing; fewer than five words are one shingle; repeated rows and equal
texts are one node; a row with a null key gets a null component and links with nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import SPACE_LIST, cut_lineage, slices
from folioframe.llm.graph import components
from folioframe.llm.substring import run_hashes

SHINGLE, GROUPS, LEAF = 5, 128, 32
#: Places of a token among its set's tokens are told in this many steps, in the last bits of the token.
PLACE_BITS = 8
PLACES = 1 << PLACE_BITS
TABLE_BITS, SLICE = 20, 4096
#: Rows up to which the wanted texts or pairs are broadcast (24 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 400_000
#: A grid cell of the finer bound holds about this many bytes of marks per side, and about this many pairs.
BLOCK_BYTES, CELL_PAIRS = 8 << 20, 500_000
#: Pairs that a task of the leaves gathers to drop repeats among them (16 bytes each).
HELD_PAIRS = 2_000_000

#: Bytes hashed at a time; a chunk ends at a blank.
CHUNK = 2 << 20
_STEP = 0x9E3779B97F4A7C15
_BLANK = np.isin(np.arange(256), [ord(c) for c in SPACE_LIST])
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
_powers: list[np.ndarray] = []


def _steps(length: int) -> list[np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, kept per worker."""
    if not _powers or len(_powers[0]) < length:
        _powers.clear()
        for base in (_STEP, pow(_STEP, -1, 1 << 64)):
            row = np.full(max(length, CHUNK + 4096), base, dtype=np.uint64)
            row[0] = 1
            _powers.append(np.multiply.accumulate(row))
    return _powers


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word: differences of one running polynomial, moved back to the word's first byte and mixed."""
    data = np.frombuffer(raw, dtype=np.uint8)
    blank, at, firsts, values = _BLANK[data], 0, [], []
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        if stop < len(data):
            rest = blank[stop:]
            ahead = int(rest.argmax())
            stop = stop + ahead if rest[ahead] else len(data)
        power, back = _steps(stop - at)
        edges = np.flatnonzero(np.diff(blank[at:stop], prepend=True, append=True))
        first, end = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_VALUE[data[at:stop]] * power[:stop - at], dtype=np.uint64)])
            h = (run[end] - run[first]) * back[first]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        firsts.append(first + at)
        values.append(h)
        at = stop
    if not firsts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    return np.concatenate(firsts), np.concatenate(values)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of every text of a slice; all texts are hashed in one go."""
    raw = [(r or b"").lower() for r in column.cast(pa.binary()).to_pylist()]
    firsts, values = word_hashes(b"\n".join(raw))
    cuts = np.searchsorted(firsts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    runs, out = run_hashes(values, SHINGLE), []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if high - low < SHINGLE:
            out.append(np.array([xxhash.xxh3_64_intdigest(values[low:high].tobytes(), seed=1)] if high > low else [], dtype=np.uint64))
            continue
        s = np.sort(runs[low:high - SHINGLE + 1])
        out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
    return out


def _name(s: np.ndarray) -> int | None:
    """Node of a set; none for an empty one."""
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else None


def pack_point(counts: np.ndarray) -> bytes:
    """Group counts as bytes, one each where all are small, else four each."""
    return counts.astype("<u1" if counts.max() < 256 else "<i4").tobytes()


def unpack_points(packed: list[bytes]) -> np.ndarray:
    """One row of GROUPS counts per point."""
    out = np.empty((len(packed), GROUPS), dtype=np.int32)
    for row, p in zip(out, packed):
        row[:] = np.frombuffer(p, dtype="<u1" if len(p) == GROUPS else "<i4")
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _slots(sets: np.ndarray) -> np.ndarray:
    return (sets >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _texts(docs: DataFrame, key: str) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("key"), body.alias("body"), F.xxhash64(body).alias("mark"))


def points(texts: DataFrame) -> DataFrame:
    """Per row: key, mark, n, node, point; and slices of the counter table (rows with a slice number)."""
    schema = "key long, mark long, n long, node long, point binary, slice int, counts binary"

    def run(batches):
        table, local = np.zeros(1 << TABLE_BITS, dtype=np.uint32), set()
        for batch in batches:
            for part in slices(batch, "body"):
                rows, fresh = [], []
                for s in shingle_sets(part.column(1)):
                    node = _name(s)
                    rows.append((len(s), node, pack_point(np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)) if len(s) else None))
                    if node is not None and node not in local:  # copies count once per task
                        local.add(node)
                        fresh.append(_slots(s))
                if fresh:
                    table += np.bincount(np.concatenate(fresh), minlength=len(table)).astype(np.uint32)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["key", "mark", "n", "node", "point", "slice", "counts"])
        used = [(i, table[i * SLICE:(i + 1) * SLICE]) for i in range(len(table) // SLICE)]
        used = [(i, t) for i, t in used if t.any()]
        gone = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*gone, pa.array([i for i, _ in used], pa.int32()), pa.array([t.tobytes() for _, t in used], pa.binary())],
            names=["key", "mark", "n", "node", "point", "slice", "counts"])

    return texts.mapInArrow(run, schema)


def crowding(seen: DataFrame) -> np.ndarray:
    """Level of every counter of the table: 0 up to about four times the mean, then one more per doubling. Its size is fixed."""
    import pandas as pd

    def add(frame):
        total = sum(np.frombuffer(c, dtype=np.uint32).astype(np.int64) for c in frame["counts"])
        return pd.DataFrame({"slice": [int(frame["slice"].iloc[0])], "counts": [total.astype("<i8").tobytes()]})

    table = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    for row in seen.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        table[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = np.frombuffer(row["counts"], dtype="<i8")
    mean = max(1.0, table.sum() / len(table))
    return np.log2(np.maximum(1.0, table / mean / 2)).astype(np.uint8)


def buckets(texts: DataFrame, levels: np.ndarray, share: int) -> DataFrame:
    """(token, node, place, hub) of all nodes that share a prefix token with another; hub is the first node of the token.

    `place` is the share of the node's tokens that come before this one in the common order, in parts of PLACES, rounded down. It takes the last bits of the token's
    hash, so that it costs no room in the shuffle; tokens that differ in these bits only share a bucket.
    """
    order = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        local = set()
        for batch in batches:
            for part in slices(batch, "body"):
                tokens, nodes = [], []
                for s in shingle_sets(part.column(1)):
                    node = _name(s)
                    if node is None or node in local:
                        continue
                    local.add(node)
                    length = len(s) - -(-share * len(s) // 100) + 1
                    first = s[np.argsort(order.value[_slots(s)], kind="stable")[:length]]
                    place = (np.arange(len(first)) * PLACES // len(s)).astype(np.uint64)
                    tokens.append(((first & ~np.uint64(PLACES - 1)) | place).view(np.int64))
                    nodes.append(np.full(len(first), node, dtype=np.int64))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], names=["placed", "node"])

    token = F.shiftright("placed", PLACE_BITS)
    rows = texts.mapInArrow(run, "placed long, node long").repartition(token)
    rows = rows.select(token.alias("token"), "node", F.col("placed").bitwiseAND(PLACES - 1).cast("short").alias("place"))
    at = Window.partitionBy("token").orderBy("node", "place")
    rows = rows.withColumn("before", F.lag("node").over(at)).withColumn("after", F.lead("node").over(at)).withColumn("hub", F.first("node").over(at))
    new = F.col("before").isNull() | (F.col("before") != F.col("node"))
    shared = F.col("before").isNotNull() | (F.col("after").isNotNull() & (F.col("after") != F.col("node")))
    return rows.where(new & shared).select("token", "node", "place", "hub")


def _bounded(pairs: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose sizes and summed coordinate minima still allow the similarity."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("point").alias("ap"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("point").alias("bp"))
    sized = pairs.join(a, "a").join(b, "b").where((100 * F.least("an", "bn") >= share * F.greatest("an", "bn")))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            p, q = (unpack_points(cols[c].to_pylist()) for c in ("ap", "bp"))
            bound = np.minimum(p, q).sum(axis=1, dtype=np.int64)
            total = cols["an"].to_numpy() + cols["bn"].to_numpy()
            keep = pa.array((100 + share) * bound >= share * total)
            yield pa.RecordBatch.from_arrays([cols["a"].filter(keep), cols["b"].filter(keep)], names=["a", "b"])

    return sized.select("a", "b", "an", "bn", "ap", "bp").mapInArrow(run, "a long, b long")


def pack_marks(s: np.ndarray) -> bytes:
    """One bit per group that holds a token, in a power of two of groups, eight to sixteen per token and 1024 at least."""
    groups = max(1024, 1 << (8 * len(s) - 1).bit_length())
    bits = np.zeros(groups, dtype=bool)
    bits[(s % np.uint64(groups)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bounded_by_marks(a: np.ndarray, b: np.ndarray, node: np.ndarray, n: np.ndarray, marks: list[bytes], share: int) -> np.ndarray:
    """Which pairs (a[i], b[i]) the marks still allow.

    Common tokens lie in groups marked on both sides; a group holds one of them more only where both sets have a further token there, so the overlap is at most the
    common marks plus the smaller number of tokens without a mark of their own. The longer marks are folded to the length of the shorter ones.
    """
    order = np.argsort(node)
    i, j = order[np.searchsorted(node, a, sorter=order)], order[np.searchsorted(node, b, sorter=order)]
    size = np.array([len(m) for m in marks], dtype=np.int64)
    width, keep = np.minimum(size[i], size[j]), np.zeros(len(a), dtype=bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        used = np.unique(np.concatenate([i[at], j[at]]))
        rows = np.stack([np.bitwise_or.reduce(np.frombuffer(marks[u], dtype=np.uint64).reshape(-1, w // 8), axis=0) for u in used.tolist()])
        spare = n[used] - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        step = max(1, (4 << 20) // w)
        for k in (at[x:x + step] for x in range(0, len(at), step)):
            p, q = np.searchsorted(used, i[k]), np.searchsorted(used, j[k])
            bound = np.bitwise_count(rows[p] & rows[q]).sum(axis=1, dtype=np.int64) + np.minimum(spare[p], spare[q])
            keep[k] = (100 + share) * bound >= share * (n[i[k]] + n[j[k]])
    return keep


def _marked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) that the marks still allow.

    The nodes of the pairs are dealt to blocks by a hash, the pairs to the cells (block of a, block of b). Marks of a node are sent once to every cell that holds a
    pair of it. The number of blocks grows with the bytes of marks and with the pairs, so that a cell stays small.
    """
    used = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    used = cut_lineage(nodes.select("node", "n", "key", "mark").join(used, "node", "left_semi"))

    def mark(batches):
        for batch in batches:
            for part in slices(batch, "body"):
                made = [pack_marks(s) for s in shingle_sets(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["node", "n", "marks"])

    held = texts.join(_small(used), ["key", "mark"]).select("node", "n", "body").mapInArrow(mark, "node long, n long, marks binary")
    held = cut_lineage(held)
    volume = held.agg(F.sum(F.length("marks"))).first()[0] or 0
    blocks = max(1, -(-volume // BLOCK_BYTES), int(np.ceil((pairs.count() / CELL_PAIRS) ** 0.5)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cells = pairs.select("a", "b", block("a").alias("row"), block("b").alias("col"))
    ends = [cells.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col(c).alias("node")) for c in ("a", "b")]
    sent = ends[0].union(ends[1]).distinct().join(held, "node").select("to_row", "to_col", "node", "n", "marks")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        if len(a) == 0:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        keep = bounded_by_marks(a, b, right.column("node").to_numpy(), right.column("n").to_numpy(), right.column("marks").to_pylist(), share)
        return pa.table({"a": a[keep], "b": b[keep]})

    return cells.groupBy("row", "col").cogroup(sent.groupBy("to_row", "to_col")).applyInArrow(run, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint where its row count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, share: int, bounded: bool = False) -> DataFrame:
    """The pairs (a, b) that are linked, decided on the sets. Texts of other nodes are dropped at the scan.

    `bounded` says that sizes and summed minima have been compared for these pairs already.
    """
    pairs = cut_lineage(_marked(cut_lineage(pairs if bounded else _bounded(pairs, nodes, share)), nodes, texts, share))
    place = nodes.select("node", "key", "mark")
    left = cut_lineage(pairs.join(place.withColumnRenamed("node", "a"), "a"))
    right = cut_lineage(pairs.select("b").distinct().join(place.withColumnRenamed("node", "b"), "b"))
    body_a = texts.join(_small(left), ["key", "mark"]).select("a", "b", F.col("body").alias("one"))
    body_b = texts.join(_small(right), ["key", "mark"]).select("b", F.col("body").alias("two"))

    def run(batches):
        known: dict = {}  # rows come sorted by b
        for part in (p for batch in batches for p in slices(batch, "one")):
            kept = []
            for i, (a, b, x) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), shingle_sets(part.column(2)))):
                if b not in known:
                    known = {b: shingle_sets(part.column(3).slice(i, 1))[0]}
                y = known[b]
                common = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * common >= share * (len(x) + len(y) - common):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=["a", "b"])

    joined = body_a.join(body_b.hint("shuffle_merge"), "b").select("a", "b", "one", "two")
    return cut_lineage(joined.mapInArrow(run, "a long, b long").distinct())


def leaf_pairs(members: DataFrame, share: int) -> DataFrame:
    """(a, b) of different components that may be linked, from `members` (token, node, n, point, component and, if known, place).

    A leaf holds up to LEAF members of a bucket, next to each other in size; its corner is the largest count per group. Leaf pairs are cut by
    size and by the corners' bound before any two points are compared. In the bucket of the first token that two sets have in common their overlap is
    at most what either set has from there on, so a pair whose places are too far back here is left to an earlier bucket, or is in none.
    """
    if "place" not in members.columns:
        members = members.withColumn("place", F.lit(0).cast("short"))
    at = Window.partitionBy("token").orderBy("n", "node")
    ranked = members.withColumn("leaf", F.floor((F.row_number().over(at) - 1) / LEAF)).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token")))
    leaves = ranked.groupBy("token", "leaf").agg(
        F.collect_list(F.struct("node", "n", "component", "place", "point")).alias("held"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("c").alias("c"),
    )
    leaves = cut_lineage(leaves)
    several = leaves.where(F.col("c") > LEAF)  # most buckets are one leaf and need no join
    other = several.select("token", F.col("leaf").alias("leaf2"), F.col("held").alias("held2"), F.col("low").alias("low2"))
    across = several.join(other, "token").where((F.col("leaf") < F.col("leaf2")) & (100 * F.col("high") >= share * F.col("low2")))
    inner = leaves.where(F.size("held") > 1).select("held", F.lit(None).cast(leaves.schema["held"].dataType).alias("held2"))

    def arrays(held):
        return (np.array([h["node"] for h in held], dtype=np.int64), np.array([h["n"] for h in held], dtype=np.int64),
                np.array([h["component"] for h in held], dtype=np.int64), np.array([PLACES - h["place"] for h in held], dtype=np.int64),
                unpack_points([h["point"] for h in held]))

    def told(found):
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n1, s1, c1, r1, p1 = arrays(one)
                n2, s2, c2, r2, p2 = arrays(two) if two is not None else (n1, s1, c1, r1, p1)
                sizes = s1[:, None] + s2[None, :]
                behind = (100 + share) * np.minimum((s1 * r1)[:, None], s2 * r2) >= PLACES * share * sizes
                behind &= (100 * np.minimum(s1[:, None], s2) >= share * np.maximum(s1[:, None], s2)) & (c1[:, None] != c2)
                if not behind.any():
                    continue
                corner = int(np.minimum(p1.max(axis=0), p2.max(axis=0)).sum())
                if (100 + share) * corner < share * int(s1.min() + s2.min()):
                    continue
                i, j = np.nonzero(behind)
                ok = (100 + share) * np.minimum(p1[i], p2[j]).sum(axis=1) >= share * sizes[i, j]
                i, j = i[ok], j[ok]
                a, b = np.maximum(n1[i], n2[j]), np.minimum(n1[i], n2[j])
                found.append(np.stack([a, b], axis=1))
                held += len(a)
                if held > HELD_PAIRS:  # a pair of many buckets is told once
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = len(found[0])
                    if held > HELD_PAIRS // 2:
                        yield told(found)
                        found, held = [], 0
        if found:
            yield told(found)

    return across.select("held", "held2").union(inner).mapInArrow(run, "a long, b long").distinct()


def _apart(shared: DataFrame, tied: DataFrame) -> DataFrame:
    """Bucket rows with their component (a node without links is its own)."""
    return shared.join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", share: int = 75) -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable by links of `share` percent or more) for every row."""
    rows, named = linked(docs, key, share)
    smallest = named.groupBy("component").agg(F.min("key").alias("component_id"))
    out = rows.select("key", "n", "node").join(named.join(smallest, "component").select("node", "component_id"), "node", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def superfluous(docs: DataFrame, key: str = "doc_id", share: int = 75) -> DataFrame:
    """(key, mark, whole): texts to drop so that one row of each group stays, the one with the smallest (key, mark).

    `mark` is xxhash64 of the text (null as empty). Where `whole` is false the text itself stays, but only once: it comes in several rows.
    """
    rows, named = linked(docs, key, share)
    texts = rows.where("node IS NOT NULL AND key IS NOT NULL").groupBy("key", "mark", "node").agg(F.count(F.lit(1)).alias("copies"))
    texts = cut_lineage(texts.join(named.select("node", "component"), "node").select("key", "mark", "copies", "component"))
    first = texts.groupBy("component").agg(F.min(F.struct("key", "mark")).alias("first"))
    told = texts.join(first, "component").withColumn("whole", F.struct("key", "mark") != F.col("first"))
    return told.where(F.col("whole") | (F.col("copies") > 1)).select("key", "mark", "whole")


def linked(docs: DataFrame, key: str, share: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their node, and every node with its smallest key and its component."""
    texts = _texts(docs, key)
    seen = cut_lineage(points(texts))
    rows = seen.where("slice IS NULL")
    nodes = cut_lineage(
        rows.where("node IS NOT NULL AND key IS NOT NULL").groupBy("node").agg(F.min(F.struct("key", "mark", "n", "point")).alias("r")).select("node", "r.*"),
    )
    shared = cut_lineage(buckets(texts.where("key IS NOT NULL"), crowding(seen), share))

    # One pair per node: the hub it meets in most buckets.
    votes = shared.where("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("v")).select(F.col("node").alias("a"), F.col("v.hub").alias("b"))
    links = verify(best, nodes, texts, share)
    tied = cut_lineage(components(links))
    # Nodes still apart from a hub of theirs.
    open_rows = _apart(shared, tied).join(tied.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    second = open_rows.where(F.col("component") != F.coalesce("hub_component", "hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = links.union(verify(second.join(best, ["a", "b"], "left_anti"), nodes, texts, share))
    tied = cut_lineage(components(links))
    # Buckets that still hold several components: leaves and bounds.
    labelled = cut_lineage(_apart(shared, tied))
    # The smaller set of a linked pair has its first common token no further back than (100 - share) / (100 + share): buckets without such a member go.
    # One bucket of each member set, named by its size and two hashes: the one whose token comes first in the common order, so in every member.
    mixed = labelled.groupBy("token").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("c"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        F.sum("place").alias("places"), F.min("place").alias("least"),
    ).where((F.col("lo") != F.col("hi")) & ((PLACES - F.col("least")) * (100 + share) >= 2 * share * PLACES)).groupBy("c", "x", "y").agg(F.min_by("token", F.struct("places", "token")).alias("token")).select("token")
    members = labelled.join(mixed, "token", "left_semi").join(nodes.select("node", "n", "point"), "node").select("token", "node", "n", "point", "component", "place")
    last = leaf_pairs(members, share)
    tried = best.union(second).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = links.union(verify(last.join(tried, ["a", "b"], "left_anti"), nodes, texts, share, bounded=True))
    tied = components(links)

    named = nodes.select("node", "key").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows, cut_lineage(named)
