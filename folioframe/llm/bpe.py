"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: one displacement per bucket, as many slots as
tokens), which resolves a pre-token that is a vocabulary entry at once. Tier two merges the bytes of any other pre-token:
a doubly linked list of parts and a heap of (rank, place), stale heap entries being skipped.

A text is cut at single blanks and line ends before the pattern runs: a run that starts with one blank and a non-blank
splits into pre-tokens alone as it does inside the text, so its ids can be remembered. A text with longer blank runs is
split by the pattern as a whole.

The rank file is read on the driver (its path is a parameter) and broadcast; its size does not depend on the data.

Defined results: a null text is an empty text and has no ids; repeated rows give repeated rows; a null key is passed through;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from folioframe.llm.common import slices

MASK = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


@dataclass
class PerfectHash:
    """Token -> place in `tokens`, for the tokens it was built from; any other byte string gives None."""

    tokens: list[bytes]
    shifts: list[int]
    ids: list[int]

    @classmethod
    def build(cls, ranks: dict[bytes, int]) -> PerfectHash:
        names = list(ranks)
        n, n_buckets = max(1, len(names)), max(1, len(names) // 2)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(n_buckets)]
        for name in names:
            h = xxhash.xxh3_64_intdigest(name)
            buckets[h % n_buckets].append((h, name))
        slots: list[bytes | None] = [None] * n
        shifts = [0] * n_buckets
        order = sorted(range(n_buckets), key=lambda b: -len(buckets[b]))
        free_from = 0
        for b in order:
            members = buckets[b]
            if len(members) > 1:
                shift = 1
                while True:
                    places = [cls.place(h, shift, n) for h, _ in members]
                    if len(set(places)) == len(places) and all(slots[p] is None for p in places):
                        break
                    shift += 1
                shifts[b] = shift
                for p, (_, name) in zip(places, members):
                    slots[p] = name
            elif members:  # alone in its bucket: any free slot, named directly
                while slots[free_from] is not None:
                    free_from += 1
                slots[free_from] = members[0][1]
                shifts[b] = -free_from - 1
        return cls([s if s is not None else b"" for s in slots], shifts, [ranks[s] if s is not None else -1 for s in slots])

    @staticmethod
    def place(h: int, shift: int, n: int) -> int:
        return ((((h ^ (shift * ODD)) & MASK) * ODD & MASK) >> 32) % n

    def get(self, name: bytes) -> int | None:
        h = xxhash.xxh3_64_intdigest(name)
        shift = self.shifts[h % len(self.shifts)]
        at = -shift - 1 if shift < 0 else self.place(h, shift, len(self.tokens))
        return self.ids[at] if self.tokens[at] == name and self.ids[at] >= 0 else None


def merge_bytes(piece: bytes, vocabulary: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost on ties, over a linked list of parts."""
    n = len(piece)
    ends = list(range(1, n + 1))  # part i is piece[i:ends[i]]
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = vocabulary.get(piece[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i]:
            continue
        j = ends[i]
        if j >= n or ends[j] != stop:
            continue
        alive[j] = False
        ends[i] = stop
        if stop < n:
            before[stop] = i
            rank = vocabulary.get(piece[i:ends[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[stop]))
        h = before[i]
        if h >= 0:
            rank = vocabulary.get(piece[h:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, h, stop))
    out, i = [], 0
    while i < n:
        out.append(vocabulary[piece[i:ends[i]]])
        i = ends[i]
    return out


class Runs(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes, from a function that splits any string; remembers runs up to a bound.

    A key is a run after a blank, or one that starts with its line end; the value is None where blanks reach into the next run.
    """

    def __init__(self, split, bound: int = 400_000):
        super().__init__()
        self.split, self.bound, self.older = split, bound, {}

    def __missing__(self, run: str) -> bytes | None:
        if len(self) >= self.bound:  # the last generation stays at hand, so that frequent runs outlive the change
            self.older = dict(self)
            self.clear()
        if run in self.older:
            value = self[run] = self.older[run]
            return value
        body = run[1:] if run[:1] == "\n" else run
        if not body or body[0].isspace() or body[-1].isspace():
            value = None
        else:
            value = self.split(run if run[0] == "\n" else " " + run)
        self[run] = value
        return value

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.replace("\n", " \n").split(" ")
        if not parts[0] or parts[0][-1].isspace():
            return self.split(text)
        try:
            return self.split(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))
        except TypeError:  # a run that cannot be split alone
            return self.split(text)


class Encoder:
    """Byte-level BPE of strings by the two tiers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.hash, self.pattern = ranks, PerfectHash.build(ranks), regex.compile(pattern)
        self.text = Runs(self.split).text

    def piece(self, piece: bytes) -> list[int]:
        known = self.hash.get(piece)
        return [known] if known is not None else merge_bytes(piece, self.ranks)

    def split(self, text: str) -> bytes:
        ids = [i for p in self.pattern.findall(text) for i in self.piece(p.encode("utf-8", "surrogatepass"))]
        return np.array(ids, dtype="<u4").tobytes()


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank per line of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    key = (getattr(ranks, "id", id(ranks)), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value, pattern)
    return _ENCODERS[key]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and `ids` (binary, little-endian unsigned 32-bit) of every row's whole text."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path))
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    schema = source.drop("__text").schema.add("ids", "binary")

    def run(batches):
        encoder = _encoder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, "__text"):
                at = part.schema.get_field_index("__text")
                ids = [encoder.text(t) for t in part.column(at).to_pylist()]
                columns = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for n in part.schema.names if n != "__text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=[*names, "ids"])

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` and `decoded`, the bytes that its `ids` stand for."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))
    schema = StructType([*encoded.schema.fields, StructField("decoded", BinaryType())])

    def run(batches):
        ordered = sorted((i, t) for t, i in vocabulary.value.items())
        flat = np.frombuffer(b"".join(t for _, t in ordered), dtype=np.uint8)
        lengths = np.zeros(ordered[-1][0] + 1, dtype=np.int64)
        for i, t in ordered:
            lengths[i] = len(t)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for part in slices(batch, "ids"):
                texts = []
                for raw in part.column(at).to_pylist():
                    ids = np.frombuffer(raw or b"", dtype="<u4")
                    sizes = lengths[ids]
                    run_to = np.cumsum(sizes)
                    index = np.repeat(starts[ids] - run_to + sizes, sizes) + np.arange(int(run_to[-1]) if ids.size else 0)
                    texts.append(flat[index].tobytes())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
