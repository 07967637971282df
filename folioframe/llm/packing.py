"""Packing of token sequences by cutting-stock column generation over the length histogram.

A document is its ids by the byte-level tokenizer file and an end id (pre-tokens are merged by a faster library over the same vocabulary; the tests hold its ids
against the file's own library). Every full `size` ids are a sequence of their own; the rest, shorter than `size`, is packed whole.
Rests are counted in units of `size / UNITS` ids, rounded up; that histogram (at most UNITS numbers, whatever the corpus) is the demand of a linear
program whose columns are patterns, multisets of lengths that fit one sequence. A restricted program is solved by the revised simplex
method; a knapsack dynamic program prices new columns until none saves anything or the bound on what is left to save is below `gap`. Whole
parts of the solution are taken as they are; lengths left over, at most a few per pattern, are packed longest first.

Patterns are assigned to documents by rank: documents are range-sorted by (unit, key), each task numbers its rows, and the counts of the tasks
before it turn those into ranks within a length, so a length shared by a third of all documents is many tasks. A rank names sequence and slot
through tables of the size of the histogram; offsets are running sums inside a sequence, which holds `size` ids at most.

Defined results: a null text is empty and holds only the end id; repeated rows are packed each; null keys are passed through; an empty table gives
no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from folioframe.llm.bpe import Runs
from folioframe.llm.common import cut_lineage, slices

END_ID = 0
UNITS = 256


def read_model(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a byte-level tokenizer file. Its ids follow the order of its merges, so they serve as ranks.

    The file writes a byte as a character: visible Latin ones as themselves, all others from code 256 on, in order.
    """
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in model.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file and their ids. Only plain ones are known: found as they are, wherever they stand."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that is not plain")
    return {t["content"]: t["id"] for t in tokens}


class Pieces:
    """Ids of texts: literals of added tokens are ids of their own, the texts between them are encoded each."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int]):
        coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.runs = Runs(lambda text: np.array(coder.encode_ordinary(text), dtype="<u4").tobytes())
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        # The longest literal wins where several start.
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def text(self, text: str) -> bytes:
        if self.literal is None or not self.literal.search(text):
            return self.runs.text(text)
        return b"".join(self.added[p] if i % 2 else self.runs.text(p) for i, p in enumerate(self.literal.split(text)))


def tokenise(docs: DataFrame, path: str, size: int, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """keep columns, doc_tokens, rest, checks (crc32 of every piece's ids) and, if wanted, ids (binary, little-endian unsigned 32-bit)."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_model(path))  # a fixed file
    added = read_added(path)
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("doc_tokens", "long").add("rest", "integer").add("checks", ArrayType(LongType()))
    if with_ids:
        schema = schema.add("ids", "binary")

    def run(batches):
        pieces = Pieces(ranks.value, added)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "__text"):
                at = part.schema.get_field_index("__text")
                ids = [pieces.text(t) + end for t in part.column(at).to_pylist()]
                count = [len(i) // 4 for i in ids]
                checks = [[zlib.crc32(i[lo:lo + 4 * size]) for lo in range(0, len(i), 4 * size)] for i in ids]
                kept = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != at]
                extra = [("doc_tokens", pa.array(count, pa.int64())), ("rest", pa.array([c % size for c in count], pa.int32())), ("checks", pa.array(checks, pa.list_(pa.int64())))]
                if with_ids:
                    extra.append(("ids", pa.array(ids, pa.binary())))
                both = [*kept, *extra]
                yield pa.RecordBatch.from_arrays([v for _, v in both], names=[n for n, _ in both])

    return source.mapInArrow(run, schema)


def _price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[dict[int, int], float]:
    """The pattern worth most and its worth: an unbounded knapsack over fills."""
    best, last = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    for fill in range(1, size + 1):
        n = upto[fill]
        best[fill] = best[fill - 1]
        if n:
            options = best[fill - lengths[:n]] + values[:n]
            at = int(options.argmax())
            if options[at] > best[fill]:
                best[fill], last[fill] = options[at], lengths[at]
    fill, pattern = size, {}
    while fill > 0:
        n = int(last[fill])
        if n:
            pattern[n] = pattern.get(n, 0) + 1
        fill -= n or 1
    return pattern, float(best[size])


def solve(demand: dict[int, int], size: int, gap: float = 0.001, rounds: int = 2000) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) that cover the demand exactly; lengths and size in units.

    The first basis is the longest-first packing: each of its patterns uses up a length that no later one holds, so it is triangular; lengths used up
    together get a surplus column. Prices are smoothed towards the last good ones, starting from length / size.
    """
    left = {n: c for n, c in demand.items() if c > 0}
    if not left:
        return []
    lengths = np.array(sorted(left))
    need = np.array([left[n] for n in lengths], dtype=np.float64)
    row = {int(n): i for i, n in enumerate(lengths)}

    def column_of(pattern: dict[int, int]) -> np.ndarray:
        column = np.zeros(len(lengths))
        for n, k in pattern.items():
            column[row[n]] = k
        return column

    patterns: list[dict[int, int]] = []  # an empty pattern is a surplus column
    columns, amounts = [], []
    for pattern, times, used_up in _first_fit(left, size, whole=False):
        patterns += [pattern] + [{}] * (len(used_up) - 1)
        columns += [column_of(pattern)] + [-column_of({n: 1}) for n in used_up[1:]]
        amounts += [float(times)] + [0.0] * (len(used_up) - 1)
    inverse, amount = _inverse(np.array(columns).T), np.array(amounts)
    costs = np.array([1.0 if p else 0.0 for p in patterns])
    least = float((lengths * need).sum()) / size  # no packing needs fewer sequences
    centre = lengths / size
    for _ in range(rounds):
        now = float((costs * amount).sum())
        if now - least <= gap * now:
            break
        dual = (costs[:, None] * inverse).sum(axis=0)
        if dual.min() < -1e-7:
            pattern, column = {}, -column_of({int(lengths[dual.argmin()]): 1})
        else:
            mixed = 0.7 * centre + 0.3 * np.maximum(0, dual)
            pattern, worth = _price(mixed, lengths, size)
            least = max(least, float((mixed * need).sum()) / max(1.0, worth))  # prices over their best worth are feasible
            column = column_of(pattern)
            if (column * dual).sum() <= 1 + 1e-9:
                pattern, worth = _price(dual, lengths, size)
                least, centre = max(least, float((dual * need).sum()) / max(1.0, worth)), mixed
                column = column_of(pattern)
                if worth <= 1 + 1e-9:
                    break
        direction = (inverse * column).sum(axis=1)
        steps = np.full(len(amount), np.inf)
        np.divide(amount, direction, out=steps, where=direction > 1e-9)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        step = steps[out]
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        amount = np.maximum(0.0, amount - step * direction)
        amount[out], patterns[out], costs[out] = step, pattern, 1.0 if pattern else 0.0
    plan: list[tuple[dict[int, int], int]] = []
    for at in np.argsort(-amount, kind="stable"):
        pattern = patterns[at]
        times = min([int(amount[at] + 1e-6), *(left[n] // k for n, k in pattern.items())]) if pattern else 0
        if times > 0:
            plan.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times
    return plan + [(pattern, times) for pattern, times, _ in _first_fit(left, size)]


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan in plain array arithmetic; the driver's numeric library may run threads of its own otherwise."""
    n = len(matrix)
    both = np.hstack([matrix.astype(np.float64), np.eye(n)])
    for i in range(n):
        at = i + int(np.abs(both[i:, i]).argmax())
        both[[i, at]] = both[[at, i]]
        both[i] /= both[i, i]
        factor = both[:, i].copy()
        factor[i] = 0.0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[i]
    return both[:, n:]


def _first_fit(left: dict[int, int], size: int, whole: bool = True) -> list[tuple[dict[int, int], float, list[int]]]:
    """Longest first: (pattern, times, lengths it uses up). In fractions every pattern uses up a length; in whole numbers it may leave a part."""
    plan = []
    left = {n: c for n, c in left.items() if c > 0}
    while left:
        room, pattern = size, {}
        for n in sorted(left, reverse=True):
            k = min(left[n], room // n) if whole else room // n
            if k:
                pattern[n] = k
                room -= k * n
        times = min(left[n] // k if whole else left[n] / k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
        used_up = [n for n in pattern if left[n] < 1e-9]
        plan.append((pattern, times, used_up))
        left = {n: c for n, c in left.items() if c >= 1e-9}
    return plan


def _tables(plan: list[tuple[dict[int, int], int]]) -> tuple[dict[int, tuple[np.ndarray, ...]], int]:
    """Per length: first rank, first sequence, copies per sequence and first slot of each pattern that holds it; and the number of sequences."""
    rows: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        slot = 0
        for n in sorted(pattern, reverse=True):
            k = pattern[n]
            rows.setdefault(n, []).append((ranks.get(n, 0), sequence, k, slot))
            ranks[n] = ranks.get(n, 0) + k * times
            slot += k
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in rows.items()}, sequence


def _numbered(tokens: DataFrame, keep: tuple[str, ...], size: int) -> DataFrame:
    """Rows range-sorted by unit with their task, their place among the task's rows of that unit, and the full sequences before them in the task."""
    unit = F.ceil(F.col("rest") * UNITS / size).cast("int")
    ordered = tokens.withColumn("unit", unit).withColumn("uid", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange("unit", *keep, "uid").sortWithinPartitions("unit", *keep, "uid")
    schema = ordered.drop("uid").schema.add("part", "integer").add("nth", "long").add("full_before", "long")

    def run(batches):
        part_no, seen, last, full = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            names = batch.schema.names
            rest = batch.column(names.index("unit")).to_numpy()
            whole = batch.column(names.index("doc_tokens")).to_numpy() // size
            change = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]]))
            base = np.repeat(change, np.diff(np.concatenate([change, [len(rest)]])))
            nth = np.arange(len(rest)) - base
            if last is not None and rest[0] == last:
                nth[base == 0] += seen
            last, seen = rest[-1], int(nth[-1]) + 1
            before = full + np.cumsum(whole) - whole
            full += int(whole.sum())
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n != "uid"]
            kept += [("part", pa.array(np.full(len(rest), part_no, dtype=np.int32))), ("nth", pa.array(nth)), ("full_before", pa.array(before))]
            yield pa.RecordBatch.from_arrays([v for _, v in kept], names=[n for n, _ in kept])

    return cut_lineage(ordered.mapInArrow(run, schema))


def pack(docs: DataFrame, path: str, size: int = 1024, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """One row per piece: keep columns, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids of the piece if wanted)."""
    rows = _numbered(cut_lineage(tokenise(docs, path, size, keep, with_ids)), keep, size)
    demand = {r["unit"]: r["n"] for r in rows.where("unit > 0").groupBy("unit").agg(F.count(F.lit(1)).alias("n")).collect()}
    tables, packed = _tables(solve(demand, UNITS))
    # Tasks times lengths they hold: about one row per task and length.
    counts = rows.groupBy("unit", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("unit", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rank_before"))
    fulls = rows.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / size)).alias("full"))
    in_order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    fulls = fulls.select("part", F.coalesce(F.sum("full").over(in_order), F.lit(0)).alias("part_before"))
    placed = rows.join(ranks, ["unit", "part"]).join(fulls, "part").withColumn("rank", F.col("nth") + F.col("rank_before"))
    schema = placed.drop("nth", "part", "rank_before").schema.add("rest_sequence", "long").add("slot", "long")

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            unit, rank = batch.column(names.index("unit")).to_numpy(), batch.column(names.index("rank")).to_numpy()
            sequence, slot = np.zeros(len(unit), dtype=np.int64), np.zeros(len(unit), dtype=np.int64)
            for n in np.unique(unit[unit > 0]):
                mine = unit == n
                first, base, copies, start = tables[int(n)]
                at = np.searchsorted(first, rank[mine], side="right") - 1
                inside = rank[mine] - first[at]
                sequence[mine] = base[at] + inside // copies[at]
                slot[mine] = start[at] + inside % copies[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence), pa.array(slot)], names=[*names, "rest_sequence", "slot"])

    found = placed.drop("nth", "part", "rank_before").mapInArrow(run, schema)
    own = [f"__keep{i}" for i in range(len(keep))]
    # Documents without a rest would share sequence 0: each gets a group of its own.
    group = F.when(F.col("unit") > 0, F.col("rest_sequence")).otherwise(-1 - F.col("full_before") - F.col("part_before"))
    inside = Window.partitionBy(group).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    pieces = found.withColumn("rest_offset", F.coalesce(F.sum("rest").over(inside), F.lit(0))).select(
        *[F.col(c).alias(n) for c, n in zip(keep, own)], "doc_tokens", "rest_sequence", "rest_offset",
        (F.col("part_before") + F.col("full_before") + packed).alias("full_sequence"),
        *(["ids"] if with_ids else []), F.posexplode("checks").alias("piece", "crc"),
    )
    start = (F.col("piece") * size).cast("long")
    whole = start + size <= F.col("doc_tokens")
    length = F.least(F.lit(size).cast("long"), F.col("doc_tokens") - start)
    return pieces.select(
        *[F.col(n).alias(c) for c, n in zip(keep, own)], start.alias("start"), length.alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        F.when(whole, F.col("full_sequence") + F.col("piece")).otherwise(F.col("rest_sequence")).alias("sequence_id"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("rest_offset")).alias("offset"),
        *([F.substring("ids", (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids")] if with_ids else []),
    )
