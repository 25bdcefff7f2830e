"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows: list[tuple], window: int = 50) -> list[tuple]:
    """rows: (doc_id, text). doc_id, n_words, n_removed, kept_sha256 of each."""
    least: dict[tuple, int] = {}
    words = [WORD.findall(t or "") for _, t in rows]
    at = lambda d: float("-inf") if d is None else d
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, at(d)), at(d))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < at(d):
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(texts: list, size: int = 4) -> list[set]:
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    words = [WORD.findall((t or "").translate(lower)) for t in texts]
    return [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()} for w in words]


def jaccard_components(rows: list[tuple], size: int = 4, percent: int = 85) -> list[tuple]:
    """rows: (doc_id, text). doc_id, n_shingles, component_id of each."""
    sets = shingles([t for _, t in rows], size)
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by: dict[tuple, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)]


def line_dedup(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """rows: (doc_id, text). doc_id and the kept lines' text of each."""
    lines = [(d, n, line) for d, t in rows for n, line in enumerate((t or "").split("\n"))]
    lines.sort(key=lambda x: x[:2])
    sets = [frozenset(WORD.findall(x[2])) for x in lines]
    by: dict[str, list[int]] = {}
    gone: set[int] = set()
    for i, s in enumerate(sets):
        for j in {j for w in s for j in by.get(w, ())}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                gone.add(i)
                break
        for w in s:
            by.setdefault(w, []).append(i)
    kept: dict = {d: [] for d, _ in rows}
    for i, (d, _, line) in enumerate(lines):
        if i not in gone:
            kept[d].append(line)
    return [(d, "\n".join(kept[d])) for d, _ in rows]


def url_rules(rows: list[tuple], support: float, confidence: float, least: int) -> set[frozenset]:
    """rows: (items, block). The smallest sets of items that enough pages hold, most of them blocked."""
    subsets = lambda x: (frozenset(c) for k in range(1, len(x) + 1) for c in combinations(x, k))
    blocked = Counter(c for x, b in rows if b for c in subsets(x))
    enough = max(least, math.ceil(support * len(rows)))
    rules = {c for c, n in blocked.items() if n >= enough and n >= confidence * sum(c <= set(x) for x, _ in rows)}
    return {c for c in rules if not any(r < c for r in rules)}


def gram_counts(text: str, buckets: int) -> Counter:
    """Letter n-grams of one to three characters, within words and their edges, by bucket."""
    found: Counter = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        codes = [32, *map(ord, word), 32]
        keys = [c | 1 << 61 for c in codes[1:-1]]
        keys += [a << 21 | b | 1 << 62 for a, b in zip(codes, codes[1:], strict=False)]
        keys += [a << 42 | b << 21 | c for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)]
        found.update((k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - buckets.bit_length() + 1) for k in keys)
    return found


def language(text: str, model: dict) -> tuple[str, float, bool]:
    """Cosine with each centroid of the model, the best one's language, and whether it is too far."""
    n = gram_counts(text, len(model["idf"]))
    if not n:
        return "und", 0.0, True
    v = {k: math.log1p(c) * float(model["idf"][k]) for k, c in n.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    cos = [sum(x * float(c[k]) for k, x in v.items()) / norm for c in model["centroids"]]
    best = max(range(len(cos)), key=lambda i: (cos[i], -i))
    lang = int(model["of"][best])
    return model["languages"][lang], cos[best], cos[best] < float(model["limits"][lang][int(math.log2(len(n)))])


def phrases(text: str) -> set[str]:
    """LZ78: each phrase is the shortest piece that isn't known yet."""
    found, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in found:
            end += 1
        if end > len(text):
            break
        found.add(text[at:end])
        at = end
    return found


def signature(text: str, bins: int, empty: int, power: int) -> list[int]:
    """The low 16 bits of the least hash of the phrases in each bin."""
    mask, least = (1 << 64) - 1, {}

    def mixed(h: int) -> int:
        h = (h ^ h >> 31) * 0x7FB5D329728EA185 & mask
        h = (h ^ h >> 27) * 0x81DADEF4BC2DD44D & mask
        return h ^ h >> 33

    for p in phrases(text):
        h = mixed(sum(mixed(ord(c) + 0x632BE59BD9B4E019 & mask) * pow(power, i, 1 << 64) for i, c in enumerate(p)) & mask)
        b = h >> 64 - bins.bit_length() + 1
        least[b] = min(least.get(b, h), h)
    return [empty if b not in least else min(least[b] & 0xFFFF, empty - 1) for b in range(bins)]


def targets(sizes: dict, weights: tuple = (5, 2, 1), most: int = 3) -> dict:
    """sizes: of each source. Shares by weight; what is over most times a source's size goes to the others."""
    sources = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, free = {}, float(sum(sizes.values())), set(sources)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s], left = float(most * sizes[s]), left - most * sizes[s]
        free -= over
    return target


def taken(doc_id, rate: float, seed: str = "mix-1") -> int:
    """floor(rate) copies and one more by the draw of the document."""
    draw = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
    return math.floor(rate) + (draw < rate - math.floor(rate))
