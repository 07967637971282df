"""Removal of long passages that an earlier document already has, found through difference-cover anchors.

A window is `window` consecutive words. Anchors are the `window - period + 1` words at the places whose number modulo `period` lies in a
difference cover: for any two places some shift below `period` brings both onto the cover, so two equal windows always share an aligned anchor.
Only about sqrt(period) / period of the places are hashed in the first pass. An anchor held by two documents then extends: every
window around it is compared through a 96-bit key, and the smallest document with that key keeps the words.

Texts travel compressed, and only hashes travel with them: a document sends each of its anchors and windows once, however often it repeats them, and finds the
places of those that come back by hashing its text again. All steps are shuffles by key; nothing of the corpus is gathered on the driver.

Defined results: a null text has no words; a row with a null key is kept whole and removes nothing; rows with equal keys never remove from
each other; a text shorter than a window stays as it is; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.llm.common import WordHashes, difference_cover, slices, split_words

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def run_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `length` words, by doubling: a long run is two shorter ones."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power, size, block = _ODD[seed], 1, hashes
        done, total, scale = 0, np.zeros(n, dtype=np.uint64), np.uint64(1)
        while True:
            if length & size:
                total += scale * block[done:done + n]
                scale *= power
                done += size
            size *= 2
            if size > length:
                break
            half = size // 2
            block = block[:-half] + power * block[half:]
            power *= power
        total ^= total >> np.uint64(33)
        total *= np.uint64(0xFF51AFD7ED558CCD)
        total ^= total >> np.uint64(33)
    return total


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _texts(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("body"))


def _packed(texts: DataFrame) -> DataFrame:
    """(key, body) with the body compressed, for shuffles."""

    def run(batches):
        coder = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "body"):
                bodies = [coder.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield _batch({"key": part.column(0), "body": pa.array(bodies, pa.binary())})

    return texts.mapInArrow(run, "key long, body binary")


def _unpack(raw: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(raw).split() if raw else []


def _cover_hashes(w: np.ndarray, window: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cover places of a text and the hashes of the anchors there."""
    length = window - period + 1
    places = (np.arange(0, len(w), period)[:, None] + cover).ravel()
    places = places[places <= len(w) - length]
    return places, run_hashes(w, length)[places].view(np.int64)


def anchors(texts: DataFrame, window: int, period: int) -> DataFrame:
    """(anchor, key) for each distinct anchor at a cover place of each text that has a window."""
    cover = np.array(difference_cover(period))

    def run(batches):
        memory = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                hs, ks = [], []
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = memory.array(split_words(body))
                    if len(w) >= window:
                        hs.append(np.unique(_cover_hashes(w, window, period, cover)[1]))
                        ks.append(np.full(len(hs[-1]), key, dtype=np.int64))
                if hs:
                    yield _batch({"anchor": pa.array(np.concatenate(hs)), "key": pa.array(np.concatenate(ks))})

    return texts.where(F.col("key").isNotNull()).mapInArrow(run, "anchor long, key long")


def repeated_windows(texts: DataFrame, window: int = 50, period: int = 31) -> DataFrame:
    """(key, repeated): hashes of the windows of a key whose words also start in a document with a smaller key."""
    same = Window.partitionBy("anchor")
    shared = (
        anchors(texts, window, period)
        .withColumn("low", F.min("key").over(same)).withColumn("high", F.max("key").over(same))
        .where(F.col("low") != F.col("high")).groupBy("key").agg(F.collect_list("anchor").alias("near"))
    )
    around = _packed(texts).join(shared, "key").select("key", "body", "near")
    cover = np.array(difference_cover(period))

    def extend(batches):
        memory = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                rows = []
                for key, body, near in zip(*(part.column(i).to_pylist() for i in range(3))):
                    w = memory.array(_unpack(body))
                    n = len(w) - window + 1
                    if n <= 0:
                        continue
                    places, hashes = _cover_hashes(w, window, period, cover)
                    places = places[np.isin(hashes, np.array(near, dtype=np.int64))]
                    edge = np.zeros(len(w) + period + 1, dtype=np.int32)
                    np.add.at(edge, np.maximum(0, places - period + 1), 1)
                    np.add.at(edge, places + 1, -1)
                    starts = np.flatnonzero(np.cumsum(edge)[:n] > 0)
                    one, first = np.unique(run_hashes(w, window)[starts], return_index=True)
                    two = (run_hashes(w, window, 1) >> np.uint64(33)).astype(np.int32)[starts[first]]
                    rows.append((one.view(np.int64), two, np.full(len(one), key, dtype=np.int64)))
                if rows:
                    yield _batch({n: pa.array(np.concatenate(c)) for n, c in zip(("one", "two", "key"), zip(*rows))})

    windows = around.mapInArrow(extend, "one long, two int, key long")
    first = F.min("key").over(Window.partitionBy("one", "two"))
    later = windows.withColumn("first", first).where(F.col("key") > F.col("first"))
    return later.groupBy("key").agg(F.collect_list("one").alias("repeated"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", window: int = 50, period: int = 31) -> DataFrame:
    """key, n_words, n_removed and kept_text (kept words joined by one blank) for every row."""
    texts = _texts(docs, key)
    joined = _packed(texts).join(repeated_windows(texts, window, period), "key", "left").select("key", "body", "repeated")

    def cut(batches):
        memory = WordHashes()
        for batch in batches:
            for part in slices(batch, "body"):
                counts, gone, kept = [], [], []
                for body, repeated in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    tokens = _unpack(body)
                    removed, n = 0, len(tokens)
                    if repeated and n >= window:
                        own = run_hashes(memory.array(tokens), window).view(np.int64)
                        place = np.flatnonzero(np.isin(own, np.array(repeated, dtype=np.int64)))
                        edge = np.zeros(n + 1, dtype=np.int32)
                        np.add.at(edge, place, 1)
                        np.add.at(edge, place + window, -1)
                        stay = np.cumsum(edge)[:-1] == 0
                        removed = int(n - stay.sum())
                        tokens = [t for t, s in zip(tokens, stay) if s]
                    counts.append(n)
                    gone.append(removed)
                    kept.append(b" ".join(tokens))
                yield _batch({"key": part.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_text": pa.array(kept, pa.binary())})

    out = joined.mapInArrow(cut, "key long, n_words long, n_removed long, kept_text binary")
    return out.withColumnRenamed("key", key)
