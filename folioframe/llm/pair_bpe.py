"""BPE encoding and decoding by a tokenizer file: a queue of merge ranks over a linked list of symbols.

A pre-token starts as one symbol per character of the file's byte alphabet. The symbols form a doubly linked list; a priority queue holds
(rank, place) of every neighbouring pair that the file can merge. The lowest rank, leftmost on ties, is taken out; an entry whose pair has changed
since is stale and skipped; a merge replaces the left symbol, unlinks the right one and queues the two new pairs. Decoding concatenates the
vocabulary strings of the ids, written as the bytes they stand for, and reads them as UTF-8, broken sequences as U+FFFD.

Where pre-tokens end is asked of the file's own pre-tokenizer, because regular-expression libraries know different versions of the character classes;
below U+0530, where they agree, a compiled pattern answers. Literals of added tokens are ids of their own and cut the text. Runs between single blanks
are split alone; runs and pre-tokens are remembered, bounded in bytes (`common.Remembered`).

The tokenizer file is read on the driver (its path is a parameter) and broadcast; its size does not depend on the data.

Defined results: a null text is an empty text and has no ids; repeated rows give repeated rows; null keys are passed through; an empty table gives
an empty table; columns other than `keep` and text are not read. Unknown ids decode to nothing.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.bpe import Runs
from folioframe.llm.common import Remembered, slices

SHIFT = 32
BEYOND = re.compile("[\u0530-\U0010ffff]")


def read_file(path: str) -> str:
    """The text of a byte-level BPE tokenizer file, after a check that it asks for nothing that this module leaves out."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    told = json.loads(text)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or told.get("normalizer"):
        raise ValueError("not a plain byte-level BPE file")
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("a BPE option that is not supported")
    if any(t.get(k) for t in told.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("an added token that is not plain")
    return text


def merge(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Symbols after all merges; `pairs` maps left << 32 | right to (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        found = pairs.get(symbols[i] << SHIFT | symbols[i + 1])
        if found is not None:
            queue.append(found[0] << SHIFT | i)
    heapq.heapify(queue)
    while queue:
        top = heapq.heappop(queue)
        i = top & (1 << SHIFT) - 1
        j = after[i]
        if symbols[i] < 0 or j < 0:
            continue  # stale: merged away, or nothing to its right any more
        found = pairs.get(symbols[i] << SHIFT | symbols[j])
        if found is None or found[0] != top >> SHIFT:
            continue  # stale: another pair stands here now
        symbols[i], symbols[j] = found[1], -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            found = pairs.get(symbols[i] << SHIFT | symbols[k])
            if found is not None:
                heapq.heappush(queue, found[0] << SHIFT | i)
        h = before[i]
        if h >= 0:
            found = pairs.get(symbols[h] << SHIFT | symbols[i])
            if found is not None:
                heapq.heappush(queue, found[0] << SHIFT | h)
    out, i = [], 0
    while i >= 0:
        out.append(symbols[i])
        i = after[i]
    return out


class BoundedRuns(Remembered):
    """`bpe.Runs` with a bound in bytes: ids of runs after a blank, None where blanks reach into the next run."""

    text = Runs.text

    def __init__(self, split):
        super().__init__(self.run)
        self.split = split

    def run(self, run: str) -> bytes | None:
        body = run[1:] if run[:1] == "\n" else run
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        return self.split(run if run[0] == "\n" else " " + run)


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, text: str):
        told = json.loads(text)
        vocabulary = told["model"]["vocab"]
        parts = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.pairs = {vocabulary[a] << SHIFT | vocabulary[b]: (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(parts)}
        self.library = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        self.pattern = regex.compile(public_tokenizers.PATTERN).findall
        self.pieces = Remembered(self.piece, limit=32 << 20)
        added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.added = {t: np.array([i], dtype="<u4").tobytes() for t, i in added.items()}
        # The longest literal wins where several start.
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.runs = BoundedRuns(self.split)
        # The alphabet writes a byte as a character: visible Latin ones as themselves, all others from code 256 on, in order.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        self.symbols = {b: vocabulary[c] for c, b in self.byte_of.items() if c in vocabulary}
        self.strings = {i: self.spell(t) for t, i in {**vocabulary, **added}.items()}

    def spell(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token) if all(c in self.byte_of for c in token) else token.encode()

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if BEYOND.search(text):
            return [text[lo:hi] for _, (lo, hi) in self.library(text)]
        return self.pattern(text)

    def piece(self, piece: str) -> bytes:
        merged = merge([self.symbols[b] for b in piece.encode() if b in self.symbols], self.pairs)
        return np.array(merged, dtype="<u4").tobytes()

    def split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))

    def encode(self, text: str) -> bytes:
        if self.literal is None or not self.literal.search(text):
            return self.runs.text(text)
        return b"".join(self.added[p] if i % 2 else self.runs.text(p) for i, p in enumerate(self.literal.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join([self.strings.get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(held) -> Codec:
    key = getattr(held, "id", id(held))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(held.value)
    return _CODECS[key]


def _map(table: DataFrame, path: str, column: str, name: str, kind: str, work, drop: bool) -> DataFrame:
    """The table with `name` computed from `column` row by row, in runs of rows of a bounded size; `column` itself goes if asked."""
    held = table.sparkSession.sparkContext.broadcast(read_file(path))
    schema = table.select(*[c for c in table.columns if not (drop and c == column)]).schema.add(name, kind)
    result = pa.binary() if kind == "binary" else pa.string()

    def run(batches):
        codec = _codec(held)
        for batch in batches:
            for part in slices(batch, column):
                at = part.schema.get_field_index(column)
                done = pa.array([work(codec, v) for v in part.column(at).to_pylist()], result)
                kept = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if not (drop and i == at)]
                yield pa.RecordBatch.from_arrays([*[v for _, v in kept], done], names=[*[n for n, _ in kept], name])

    return table.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns and `ids` (binary, little-endian unsigned 32-bit) of every row's whole text."""
    source = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    return _map(source, path, "__text", "ids", "binary", lambda codec, text: codec.encode(text), drop=True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of `encoded` and `decoded`, the text that its `ids` stand for."""
    return _map(encoded, path, "ids", "decoded", "string", lambda codec, ids: codec.decode(ids or b""), drop=False)
