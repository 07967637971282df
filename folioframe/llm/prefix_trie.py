"""Prefix trie of conversations by the Euler-tour technique.

Turns are numbered by one range sort, so a conversation of any length lies in many blocks of numbers. A prefix is named by its depth and two 64-bit
exclusive-or sums of hashes of (place, role, text): such sums compose over blocks, and the parent's name follows from a node's own name and last turn.
A node is owned by its smallest member, and nodes are numbered by (owner, depth): the nodes of one owner are a path, so most parents are the number
before, and only the tops of the paths look their parent up.

The tour has an enter and an exit arc per node (numbers 2n and 2n+1), each naming the arc that follows; children come by owner. Ranking that list:
blocks of arc numbers chain what stays inside a block, the heads of those chains form a shorter list, and rounds of coin flips take out arcs whose
predecessor can skip them until a list of proven size is left, which one task ranks; then ranks are handed back in reverse. Prefix sums over the ranks
give the leaves and savings of a subtree as a difference between its exit and its enter arc.

A name that many rows share is never one task: rows are numbered in its order, cut into blocks of numbers, and what belongs to the name is copied to
the blocks it covers. The members that end in a node are packed into short strings by a range sort; only those strings meet in one task, which reads
them as a sorted stream into one hash.

Defined results: rows without a conversation id take no part; a null role or text is empty; a null turn comes first, rows of one turn number are ordered
by role and text, repeated rows are turns each; an empty table has no nodes; other columns are not read. Equal names stand for equal prefixes but for a
collision of 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import cut_lineage, words

NAME = ("depth", "s1", "s2")
PACKED = 8192  # characters of packed ids a row


def numbered(df: DataFrame, order: list[Column], name: str, ranges: list[Column] | None = None) -> DataFrame:
    """Rows numbered from 0 in an order, written once. `ranges` are keys that cut the order into tasks (the order itself if not given)."""
    sorted_rows = df.repartitionByRange(*(ranges or order)).sortWithinPartitions(*order)
    placed = cut_lineage(sorted_rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at")))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    shifts = tasks.select("__part", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    # One row for each task of the sort.
    return placed.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def beside(df: DataFrame, number: str, step: int, values: dict[str, Column], block: int) -> DataFrame:
    """Values of the row whose number is one less (step -1) or one more (step 1); null where there is none."""
    edge = block - 1 if step < 0 else 0
    copied = F.when(F.col(number) % block == edge, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("__copy", F.explode(copied)).withColumn("__block", F.floor(F.col(number) / block) - F.col("__copy") * step)
    order = Window.partitionBy("__block").orderBy(number)
    near = {k: (F.lag if step < 0 else F.lead)(v).over(order) for k, v in values.items()}
    return rows.withColumns(near).where("__copy = 0").drop("__copy", "__block")


def spread(df: DataFrame, first: str, count: str, block: int) -> DataFrame:
    """A row for every block that the numbers first .. first + count - 1 touch."""
    last = F.floor((F.col(first) + F.col(count) - 1) / block)
    return df.withColumn("block", F.explode(F.sequence(F.floor(F.col(first) / block), last)))


def _salted(depth: Column, turn: tuple[Column, Column]) -> tuple[Column, Column]:
    """Hashes of a turn at a place."""
    return F.xxhash64(depth.cast("long"), *turn), F.xxhash64(F.lit(1).cast("long"), depth.cast("long"), *turn)


def number_turns(conversations: DataFrame) -> DataFrame:
    """number, conv_id, h1, h2 (hashes of role and text) and words of every turn, numbered by conversation and turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    before = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    held = turns.repartitionByRange(*before, F.substring("text", 1, 32)).sortWithinPartitions(*before, "text")
    narrow = held.select(
        "conv_id", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.size(words(F.col("text"))).cast("long").alias("words"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
    )
    # The order is fixed by task and place once written; numbering them needs no texts.
    placed = cut_lineage(narrow)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    shifts = tasks.select("part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(shifts), "part").select((F.col("at") + F.col("shift")).alias("number"), "conv_id", "h1", "h2", "words")


def rebuild(turns: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, total, s1, s2, t1, t2, words) of every rebuilt turn, and (conv_id, total) of every conversation.

    A conversation takes the first h turns of its base, then its own after its first h.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("number"))
    tops = turns.where("conv_id % 20 = 0").withColumn("nth", nth).where("nth <= 3")  # h is 3 at most; tasks send three rows a conversation
    tops = tops.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("nth", "h1", "h2", "words"))).alias("top"))
    told = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("first"))
    told = told.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    told = told.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(tops, "base", "left")
    told = told.withColumn("top", F.when(F.col("top").isNull() | (F.col("h") == 0), F.array().cast(tops.schema["top"].dataType)).otherwise(F.slice("top", 1, F.greatest("h", F.lit(1)))))
    told = told.withColumn("b", F.size("top"))

    def upto(which: int):
        zero = F.lit(0).cast("long")
        one = lambda t: _salted(t["nth"], (t["h1"], t["h2"]))[which]
        return lambda i: F.aggregate(F.slice("top", 1, i), zero, lambda s, t: s.bitwiseXOR(one(t)))

    s1, s2 = upto(0), upto(1)
    told = cut_lineage(told.select(
        "conv_id", "n", "first", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"),
        F.transform("top", lambda t, i: F.struct(t["nth"].alias("depth"), s1(i + 1).alias("s1"), s2(i + 1).alias("s2"), t["h1"].alias("h1"), t["h2"].alias("h2"), t["words"].alias("words"))).alias("top"),
    ))
    taken = told.select("conv_id", "total", F.inline("top"))
    taken = taken.withColumns(dict(zip(("t1", "t2"), _salted(F.col("depth"), (F.col("h1"), F.col("h2"))))))
    last = F.try_element_at("top", F.lit(-1))
    wide = spread(told.select("conv_id", "n", "first", "h", "b", "total", F.coalesce(last["s1"], F.lit(0)).alias("p1"), F.coalesce(last["s2"], F.lit(0)).alias("p2")), "first", "n", block)
    own = turns.withColumn("block", F.floor(F.col("number") / block)).join(wide, ["conv_id", "block"])
    place = F.col("number") - F.col("first") + 1
    own = own.where(place > F.col("h")).withColumn("depth", F.col("b") + place - F.col("h"))
    own = own.withColumns(dict(zip(("t1", "t2"), _salted(F.col("depth"), (F.col("h1"), F.col("h2"))))))
    inside = Window.partitionBy("conv_id", "block").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    carried = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(c) for x, c in (("x1", "c1"), ("x2", "c2"))])
    own = own.withColumn("r1", F.bit_xor("t1").over(inside)).withColumn("r2", F.bit_xor("t2").over(inside)).join(carried, ["conv_id", "block"])
    own = own.select("conv_id", "depth", "total", *[F.col(f"p{i}").bitwiseXOR(F.col(f"c{i}")).bitwiseXOR(F.col(f"r{i}")).alias(f"s{i}") for i in (1, 2)], "t1", "t2", "words")
    taken = taken.select("conv_id", F.col("depth").cast("long").alias("depth"), "total", "s1", "s2", "t1", "t2", "words")
    return cut_lineage(own.unionByName(taken)), told.select("conv_id", "total")


def end_digests(ends: DataFrame) -> DataFrame:
    """NAME and ends_sha256 of each name in (conv_id, depth, s1, s2): the hash of its ids in order, joined by commas."""
    keys = [*NAME, "conv_id"]
    dealt = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def pack(batches):
        now, first, ids, size = None, None, [], 0
        out = []

        def close():
            out.append((*now, first, ",".join(ids)))

        for batch in batches:
            for *name, conv in zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]):
                if name != now or size > PACKED:
                    if ids:
                        close()
                    now, first, ids, size = name, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(packed.names, r)) for r in out])
                out.clear()
        if ids:
            close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(packed.names, r)) for r in out])

    packed = ends.select(*NAME, F.col("conv_id").alias("first_id"), F.lit("").alias("ids")).schema
    runs = dealt.mapInArrow(pack, packed).repartition(*NAME).sortWithinPartitions(*NAME, "first_id")
    hashed = ends.select(*NAME, F.lit("").alias("ends_sha256")).schema

    def digest(batches):
        now, state, out = None, None, []
        for batch in batches:
            for *name, ids in zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*NAME, "ids")]):
                if name != now:
                    if state is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, r)) for r in out])
                out = []
        if state is not None:
            out.append((*now, state.hexdigest()))
            yield pa.RecordBatch.from_pylist([dict(zip(hashed.names, r)) for r in out])

    return runs.mapInArrow(digest, hashed)


def number_nodes(rebuilt: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Every distinct prefix with its number n by (owner, depth), whether it is the top of its owner's path, and its parent's name."""
    nodes = rebuilt.groupBy(*NAME).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner"), F.first("words").alias("words"), F.first("t1").alias("t1"), F.first("t2").alias("t2"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("owner")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NAME], "n_convs", "owner", *[zero.alias(c) for c in ("words", "t1", "t2")])
    named = nodes.unionByName(root).select(
        *NAME, "n_convs", "owner", "words", (F.col("depth") - 1).alias("up"), F.col("s1").bitwiseXOR(F.col("t1")).alias("u1"), F.col("s2").bitwiseXOR(F.col("t2")).alias("u2"),
    )
    placed = numbered(named, [F.col("owner"), F.col("depth")], "n")
    owners = beside(placed, "n", -1, {"left_owner": F.col("owner")}, block)
    owners = owners.withColumn("is_top", ~F.col("owner").eqNullSafe(F.col("left_owner"))).drop("left_owner")
    return cut_lineage(beside(owners, "n", 1, {"right_top": F.col("is_top")}, block))


def link(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes with n_children, parent (number), parent_owner, first_child, next_sibling (numbers); children are in order of their owners.

    The child that carries on its parent's path comes first and is the number after it; all others are tops.
    """
    under = numbered(nodes.where("is_top AND depth > 0").select("up", "u1", "u2", "owner", "n"), [F.col(c) for c in ("up", "u1", "u2", "owner")], "g")
    follows = [F.col(c).alias(f"_{c}") for c in ("up", "u1", "u2", "n")]
    under = beside(under, "g", 1, {"right": F.struct(*follows)}, block)
    same = (F.col("right._up") == F.col("up")) & (F.col("right._u1") == F.col("u1")) & (F.col("right._u2") == F.col("u2"))
    under = cut_lineage(under.select("up", "u1", "u2", "n", "g", F.when(same, F.col("right._n")).alias("next_top")))
    groups = under.groupBy(F.col("up").alias("depth"), F.col("u1").alias("s1"), F.col("u2").alias("s2")).agg(
        F.count(F.lit(1)).alias("tops"), F.min("g").alias("first_g"), F.min("n").alias("first_top"))
    held = nodes.join(groups, list(NAME), "left")
    carries_on = ~F.coalesce("right_top", F.lit(True))
    held = cut_lineage(held.select(
        *NAME, "n_convs", "owner", "words", "n", "is_top", "first_g", "tops", "first_top",
        (F.coalesce("tops", F.lit(0)) + carries_on.cast("int")).cast("long").alias("n_children"),
        F.when(carries_on, F.col("n") + 1).otherwise(F.col("first_top")).alias("first_child"),
    ))
    parents = spread(held.where("tops > 0").select(*NAME, F.col("n").alias("parent"), F.col("owner").alias("parent_owner"), "first_g", "tops"), "first_g", "tops", block)
    placed = under.withColumn("block", F.floor(F.col("g") / block)).withColumnsRenamed({"up": "depth", "u1": "s1", "u2": "s2"})
    ups = placed.join(parents, [*NAME, "block"]).select("n", "next_top", "parent", "parent_owner")
    joined = beside(held, "n", -1, {"left_top": F.col("first_top")}, block).join(ups, "n", "left")
    on_path = ~F.col("is_top")
    return cut_lineage(joined.select(
        *NAME, "n_convs", "owner", "words", "n", "n_children", "first_child",
        F.when(on_path, F.col("n") - 1).otherwise(F.col("parent")).alias("parent"),
        F.when(on_path, F.col("owner")).otherwise(F.col("parent_owner")).alias("parent_owner"),
        F.when(on_path, F.col("left_top")).otherwise(F.col("next_top")).alias("next_sibling"),
    ))


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs (id, next) of the Euler tour: 2n enters node n, 2n + 1 leaves it; the last arc's next is -1."""
    enter = F.coalesce(F.col("first_child") * 2, F.col("n") * 2 + 1)
    leave = F.coalesce(F.col("next_sibling") * 2, F.col("parent") * 2 + 1, F.lit(-1))
    arcs = F.array(F.struct((F.col("n") * 2).alias("id"), enter.alias("next")), F.struct((F.col("n") * 2 + 1).alias("id"), leave.alias("next")))
    return nodes.select(F.inline(arcs))


def _chains(frame: pd.DataFrame) -> pd.DataFrame:
    """Arcs of a block with the head and the offset of the chain they are in, and the chain's length and what follows it."""
    frame = frame.sort_values("id", ignore_index=True)
    ids, after = frame["id"].to_numpy(), frame["next"].to_numpy()
    place = np.minimum(np.searchsorted(ids, after), len(ids) - 1)
    inside = ids[place] == after
    follow = np.where(inside, place, -1).tolist()
    is_head = np.ones(len(ids), dtype=bool)
    is_head[place[inside]] = False
    head, offset, length, leads = (np.zeros(len(ids), dtype=np.int64) for _ in range(4))
    for start in np.flatnonzero(is_head).tolist():
        at, n, last = start, 0, start
        while at >= 0:
            head[at], offset[at], n, last = start, n, n + 1, at
            at = follow[at]
        length[start], leads[start] = n, after[last]
    return pd.DataFrame({"id": ids, "head": ids[head], "offset": offset, "length": length, "next": leads})


def _rank_whole(frame: pd.DataFrame) -> pd.DataFrame:
    """Ranks along a list (id, next, length) held by one task."""
    follow, length = dict(zip(frame["id"].tolist(), frame["next"].tolist())), dict(zip(frame["id"].tolist(), frame["length"].tolist()))
    at = next(iter(follow.keys() - set(follow.values())), -1)
    out, rank = [], 0
    while at >= 0:
        out.append((at, rank))
        rank += length[at]
        at = follow[at]
    return pd.DataFrame(out, columns=["id", "rank"]).astype("int64")


def rank_list(arcs: DataFrame, block: int = 1 << 16, whole: int = 1 << 17) -> DataFrame:
    """(id, rank) of every arc in a list (id, next), -1 being its end; ids of neighbours are best close together.

    `block` ids are chained by one task; lists of `whole` rows at most are ranked by one.
    """
    dealt = arcs.groupBy(F.floor(F.col("id") / block))
    chained = cut_lineage(dealt.applyInPandas(_chains, "id long, head long, offset long, length long, next long"))
    now = chained.where("id = head").select("id", "next", "length")
    taken = []
    while now.count() > whole:
        coin = lambda c: F.pmod(F.xxhash64(F.lit(len(taken)), F.col(c)), F.lit(2))
        skips = now.where(coin("id") == 0).select(F.col("id").alias("into"), F.col("next").alias("id"), F.col("length").alias("offset"))
        gone = cut_lineage(now.where(coin("id") == 1).join(skips, "id"))
        taken.append(gone.select("id", "into", "offset"))
        longer = gone.select(F.col("into").alias("id"), F.col("next").alias("new_next"), F.col("length").alias("more"))
        kept = now.join(gone.select("id"), "id", "left_anti").join(longer, "id", "left")
        hop = F.when(F.col("more").isNull(), F.col("next")).otherwise(F.col("new_next"))
        now = cut_lineage(kept.select("id", hop.alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
    ranks = now.withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(_rank_whole, "id long, rank long")
    for gone in reversed(taken):
        back = gone.join(ranks.withColumnRenamed("id", "into"), "into").select("id", (F.col("rank") + F.col("offset")).alias("rank"))
        ranks = cut_lineage(ranks.unionByName(back))
    return chained.join(ranks.withColumnRenamed("id", "head"), "head").select("id", (F.col("rank") + F.col("offset")).alias("rank"))


def prefix_sums(df: DataFrame, place: str, values: list[str], n: int, block: int) -> DataFrame:
    """Every value replaced by its sum up to and including the row; `place` numbers the n rows from 0."""
    up = f"{place}_up"
    split = df.withColumn(up, F.floor(F.col(place) / block))
    inside = Window.partitionBy(up).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = split.withColumns({v: F.sum(v).over(inside) for v in values})
    if n <= block:
        return sums.drop(up)
    totals = split.groupBy(up).agg(*[F.sum(v).alias(v) for v in values])
    carried = prefix_sums(totals, up, values, -(-n // block), block)
    carried = carried.select((F.col(up) + 1).alias(up), *[F.col(v).alias(f"__{v}") for v in values])
    both = sums.join(carried, up, "left")
    return both.withColumns({v: F.col(v) + F.coalesce(f"__{v}", F.lit(0)) for v in values}).select(*df.columns)


def trie(conversations: DataFrame, block: int = 1 << 16, whole: int = 1 << 17) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    turns = number_turns(conversations)
    rebuilt, convs = rebuild(turns, block)
    nodes = link(number_nodes(rebuilt, convs, block), block)
    n_nodes = nodes.count()
    value = {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}
    entered = nodes.select((F.col("n") * 2).alias("id"), *[v.alias(k) for k, v in value.items()])
    arcs = rank_list(tour(nodes), block, whole).join(entered, "id", "left")
    placed = arcs.select("id", "rank", *[F.coalesce(v, F.lit(0)).alias(v) for v in value], *[F.coalesce(v, F.lit(0)).alias(f"own_{v}") for v in value])
    summed = prefix_sums(placed, "rank", list(value), 2 * n_nodes, block)
    leaves = F.col("id") % 2 == 1
    inside = summed.groupBy(F.floor(F.col("id") / 2).alias("n")).agg(
        *[F.sum(F.when(leaves, F.col(v)).otherwise(F.col(f"own_{v}") - F.col(v))).alias(v) for v in value])
    zero = F.lit(0).cast("long")
    ends = rebuilt.where("depth = total").select("conv_id", *NAME).unionByName(convs.where("total = 0").select("conv_id", *[zero.alias(c) for c in NAME]))
    told = nodes.join(inside, "n").join(end_digests(ends), list(NAME), "left")
    return told.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent_owner").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaf").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
