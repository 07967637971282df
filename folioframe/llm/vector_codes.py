"""Product codes of vectors with memoised grid cells.

A vector is cut into parts; a codebook per part position is learned in rounds of nearest-entry assignment and componentwise floor means. For the
nearest entry, a part falls into a coarse cell of a grid. For a cell seen first, every entry's least and greatest squared distance to the cell's box
decide: an entry whose least is above the smallest greatest can be nearest nowhere in the box. The entries left over are remembered per cell, and only
they are evaluated exactly. Cells are found by a 64-bit hash and compared in full, so a collision costs a second look and no wrong answer.

Every round is one pass over the vectors. A task keeps sums per (vector length, part, entry) and hands over at most entries x length rows, so neither
a hot vector nor a hot label is a hot key; the codebooks (entries x length numbers for each vector length) are the only thing the driver holds. No
intermediate table is written: a lost executor repeats its own tasks.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; a null key is kept and sorts last; equal keys sort
by vector; repeated rows are rows each. Vectors of different lengths have codebooks of their own, and part p of a vector of n components is
[p*n/parts, (p+1)*n/parts), rounded down, so equal where n divides and empty where it does not reach. Fewer rows than entries give fewer entries. Whole components are clipped to
64 bits; where squares could pass 2^53 plain integers are used, and errors are clipped to 64 bits. Null labels are a label. An empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import cut_lineage

TOP = (1 << 63) - 1
SAFE = 1 << 20  # below it, squared distances of any part of under 2,000 components are exact in 64 bits and far from their end
CELLS = 1 << 14  # cells remembered per part, 64 bytes of entries each


def bounds(n: int, parts: int) -> list[int]:
    return [p * n // parts for p in range(parts + 1)]


class Grid:
    """Nearest codebook entry for one part position; `evaluated` counts exact distances."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.wide = entries.dtype == object or (entries.size > 0 and int(np.abs(entries).max()) >= SAFE)
        gaps = [int(((entries - e) ** 2).sum(axis=1)[np.arange(len(entries)) != i].min()) for i, e in enumerate(entries)] if len(entries) > 1 and not self.wide else [0]
        # A cell about a third of the usual distance between neighbouring entries leaves few of them.
        self.side = max(1, int(np.sqrt(np.median(gaps)) / 3))
        rng = np.random.default_rng(12)
        self.factors = rng.integers(1, 1 << 62, size=entries.shape[1], dtype=np.int64).astype(np.uint64) | np.uint64(1)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.evaluated = self.asked = 0

    def candidates(self, cell: np.ndarray) -> np.ndarray:
        """Entries that are not dominated in the box of a cell, in order."""
        low = cell * self.side
        high = low + (self.side - 1)
        below, above = low - self.entries, self.entries - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=1)
        greatest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=1)
        return np.flatnonzero(least <= greatest.min())

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per point; ties go to the lower entry."""
        self.asked += len(points) * len(self.entries)
        if self.wide or (points.size and int(np.abs(points).max()) >= SAFE):
            return self.plain(points)
        cells = np.floor_divide(points, self.side)
        keys = (cells.astype(np.uint64) * self.factors).sum(axis=1, dtype=np.uint64)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > CELLS:
            self.known.clear()
        lists, width = [], 1
        for key, at in zip(distinct.tolist(), first.tolist()):
            held = self.known.get(key)
            if held is None or not np.array_equal(held[0], cells[at]):
                held = self.known[key] = (cells[at].copy(), self.candidates(cells[at]).astype(np.uint16))
            lists.append(held[1])
            width = max(width, len(held[1]))
        sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        flat, starts = np.concatenate(lists).astype(np.int64), np.cumsum(sizes) - sizes
        best = np.zeros(len(points), dtype=np.int64)
        error = np.full(len(points), TOP, dtype=np.int64)
        for nth in range(width):  # the nth candidate of every point that has so many
            rows = np.flatnonzero(sizes[place] > nth)
            entry = flat[starts[place[rows]] + nth]
            distance = ((points[rows] - self.entries[entry]) ** 2).sum(axis=1)
            better = distance < error[rows]
            best[rows[better]], error[rows[better]] = entry[better], distance[better]
            self.evaluated += len(rows)
        other = np.flatnonzero((cells != cells[first][place]).any(axis=1))  # another cell with the same hash
        if len(other):
            best[other], error[other] = self.plain(points[other])
        return best, error

    def plain(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every entry, in plain integers."""
        self.evaluated += len(points) * len(self.entries)
        entries = [[int(x) for x in e] for e in self.entries]
        best, error = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=object)
        for i, point in enumerate(points.tolist()):
            far = [sum((int(x) - y) ** 2 for x, y in zip(point, e)) for e in entries]
            error[i] = min(far)
            best[i] = far.index(error[i])
        return best, error


class Coder:
    """Grids of all part positions for the vector lengths that have codebooks."""

    def __init__(self, codebooks: dict[int, list[np.ndarray]], parts: int):
        self.cuts = {n: bounds(n, parts) for n in codebooks}
        self.grids = {n: [Grid(b) for b in books] for n, books in codebooks.items()}

    def assign(self, vectors: np.ndarray):
        """(entry per row and part, error per row) of vectors of one length."""
        n = vectors.shape[1]
        found = [g.nearest(vectors[:, lo:hi]) for g, lo, hi in zip(self.grids[n], self.cuts[n], self.cuts[n][1:])]
        return np.stack([b for b, _ in found], axis=1), sum(e for _, e in found)


def quantised(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """vec_id, label and v (whole components) of every sound row."""
    value = F.col(vector).cast("array<double>")
    sound = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda x: F.greatest(F.least(F.floor(x * F.lit(float(scale))), F.lit(TOP)), F.lit(-TOP))
    return vectors.where(F.col(vector).isNotNull()).where(sound).select(
        F.col(key).alias("vec_id"), F.col(label).alias("label"), F.transform(value, whole).alias("v"),
    )


def _by_length(batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) of each length in a batch."""
    column = batch.column(batch.schema.get_field_index("v"))
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0), dtype=np.int64)))
    return out


def first_codebooks(points: DataFrame, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """Parts of the `entries` vectors with the smallest keys, for each vector length."""
    size = F.size("v")
    lengths = [r["n"] for r in points.select(size.alias("n")).distinct().collect()]
    books = {}
    for n in lengths:
        # A top-n query: every task sends `entries` rows at most.
        rows = points.where(size == n).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        whole = np.array([r["v"] for r in rows], dtype=np.int64).reshape(len(rows), n)
        books[n] = [whole[:, lo:hi] for lo, hi in zip(bounds(n, parts), bounds(n, parts)[1:])]
    return books


def improve(points: DataFrame, books: dict[int, list[np.ndarray]], parts: int) -> dict[int, list[np.ndarray]]:
    """One round: every entry becomes the floor mean of the parts nearest to it; an entry without parts stays."""
    held = points.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        coder = Coder(held.value, parts)
        counts = {(n, p): np.zeros(len(b), dtype=object) for n, bs in held.value.items() for p, b in enumerate(bs)}
        sums = {(n, p): np.zeros(b.shape, dtype=object) for n, bs in held.value.items() for p, b in enumerate(bs)}
        for batch in batches:
            for _, vectors in _by_length(batch):
                n = vectors.shape[1]
                entry, _ = coder.assign(vectors)
                for p, (lo, hi) in enumerate(zip(coder.cuts[n], coder.cuts[n][1:])):
                    size = len(counts[n, p])
                    counts[n, p] += np.bincount(entry[:, p], minlength=size).astype(object)
                    part = vectors[:, lo:hi]
                    near = np.zeros((size, hi - lo), dtype=object if part.size and int(np.abs(part).max()) >= SAFE else np.int64)
                    np.add.at(near, entry[:, p], part.astype(near.dtype))
                    sums[n, p] += near.astype(object)
        rows = [(n, p, e, i, str(s), int(c[e])) for (n, p), c in counts.items() for e in np.flatnonzero(c).tolist() for i, s in enumerate(sums[n, p][e])]
        names = ["n", "part", "entry", "place", "total", "members"]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=names)

    told = points.select("v").mapInArrow(run, "n long, part long, entry long, place long, total string, members long")
    means = told.groupBy("n", "part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
    better = {n: [b.copy() for b in bs] for n, bs in books.items()}
    for r in means.collect():  # entries x length rows for each vector length
        better[r["n"]][r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["members"]
    held.unpersist()
    return better


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of the decimal components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def train(points: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> dict[int, list[np.ndarray]]:
    """Codebooks by vector length: an array (entry, place) for each part."""
    books = first_codebooks(points, parts, entries)
    for _ in range(rounds):
        books = improve(points, books, parts)
    return books


def encode(points: DataFrame, books: dict[int, list[np.ndarray]], parts: int = 16) -> DataFrame:
    """vec_id, label, n (vector length), code (two hex digits a part) and error of every row."""
    held = points.sparkSession.sparkContext.broadcast(books)
    schema = points.select("vec_id", "label").schema.add("n", "integer").add("code", "string").add("error", "long")

    def run(batches):
        coder = Coder(held.value, parts)
        for batch in batches:
            code = np.zeros(batch.num_rows, dtype=object)
            error, size = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int32)
            for rows, vectors in _by_length(batch):
                entry, far = coder.assign(vectors)
                digits = entry.astype(np.uint8).tobytes().hex()
                width = 2 * entry.shape[1]
                code[rows] = [digits[i * width:(i + 1) * width] for i in range(len(rows))]
                error[rows] = np.minimum(far, TOP).astype(np.int64)
                size[rows] = vectors.shape[1]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(code.tolist(), pa.string()), pa.array(error)], names=["vec_id", "label", "n", "code", "error"])

    return points.mapInArrow(run, schema)


def with_label_errors(coded: DataFrame, salts: int = 64) -> DataFrame:
    """The coded rows and `label_error`, the error summed over rows of an equal label (nulls together).

    Labels are summed before the shuffle; their totals are copied per salt, so the rows of a hot label go to many tasks.
    """
    label, salt = "__label", "__salt"
    totals = coded.groupBy(F.col("label").alias(label)).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("__sum"))
    copies = totals.withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    both = spread.join(copies, spread["label"].eqNullSafe(copies[label]) & (spread[salt] == copies["__of"]))
    return both.select(*coded.columns, F.least("__sum", F.lit(TOP)).cast("long").alias("label_error"))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
             parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(vec_id, label, n, code, error, label_error of every sound row; the codebooks by vector length)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part")
    points = quantised(vectors, key, vector, label, scale)
    books = train(points, parts, entries, rounds)
    return with_label_errors(cut_lineage(encode(points, books, parts))), books
