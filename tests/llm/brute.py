"""Plain Python versions of the text operators, slow and short, for small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

BLANKS = " \t\n\x0b\f\r"


def words(text, lower=False):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found] if lower else found


def encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def shingle_set(text):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def components(rows, share=75):
    """{row number: (n_shingles, smallest key reachable)} for rows (key, text); every pair that shares a shingle is compared."""
    sets = [shingle_set(t) if k is not None else frozenset() for k, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    tried = set()
    for group in holders.values():
        group = sorted(group)
        for x, i in enumerate(group):
            for j in group[x + 1:]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(j)] = root(i)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            smallest[root(i)] = min(k, smallest.get(root(i), k))
    return {i: (len(shingle_set(t)), smallest.get(root(i)) if k is not None else None) for i, (k, t) in enumerate(rows)}


ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def fixed_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def spelled(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'random')[k]}:{a}:{b}" for a, k, b in spans)


def base_scores(rows, held_out):
    """(n_tokens, n_known, train_tokens, base_score) for rows (key, text)."""
    counts = Counter()
    for k, t in rows:
        if not held_out(k):
            counts.update([*words(t, lower=True), None])
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, t in rows:
        tokens = [*words(t, lower=True), None]
        out.append((len(tokens), sum(counts[x] > 0 for x in tokens), total,
                    sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in tokens)))
    return out


def crc(key):
    return zlib.crc32(("" if key is None else str(key)).encode())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
