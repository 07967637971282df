"""Helpers shared by the text operators."""

from __future__ import annotations

import itertools
import sys

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.session import cut_lineage

__all__ = ["WORD", "SPACE_LIST", "words", "table", "crc_mod", "fresh", "split_words", "WordHashes", "Remembered", "difference_cover", "slices", "cut_lineage"]

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_LIST = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words of a text in order; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo a number: the split into training and held-out rows."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in itertools.chain([stem], (f"{stem}_{i}" for i in itertools.count(1))) if n.lower() not in taken)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.split() cuts at exactly the six ASCII blanks, bytes.lower() changes A-Z only."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound and then started anew."""

    def __init__(self, bound: int = 1 << 17):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


class Remembered(dict):
    """Results of a function by argument, bounded in bytes.

    Two generations: once the newer one holds `limit` bytes it becomes the older one, which still answers until the next change, so that
    frequent arguments outlive it. An argument and result of more than `longest` bytes together are computed each time.
    """

    def __init__(self, compute, limit: int = 64 << 20, longest: int = 1 << 12):
        super().__init__()
        self.compute, self.limit, self.longest, self.held, self.older = compute, limit, longest, 0, {}

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.compute(key)
        cost = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if cost <= self.longest:
            if self.held + cost > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = value
            self.held += cost
        return value


def difference_cover(period: int) -> list[int]:
    """A smallest set D in 0..period-1 such that every shift is a difference of two members, found by search."""

    def grow(chosen: list[int], seen: frozenset[int], size: int) -> list[int] | None:
        if len(seen) == period:
            return chosen
        if len(chosen) == size:
            return None
        room = size - len(chosen)
        if len(seen) + sum(2 * (len(chosen) + i) for i in range(room)) < period:
            return None
        for x in range(chosen[-1] + 1, period):
            more = {(x - y) % period for y in chosen} | {(y - x) % period for y in chosen}
            if found := grow([*chosen, x], seen | more, size):
                return found
        return None

    for size in range(1, period + 1):
        if found := grow([0], frozenset([0]), size):
            return found
    return list(range(period))


def slices(batch, column: str, limit: int = 2 << 20):
    """Cut a record batch into runs of rows whose texts hold about `limit` bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0))
    run = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(run, run[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
