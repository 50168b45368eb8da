"""Plain Python versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def windows(benchmark, size: int = 10) -> dict:
    found: dict = {}
    for item, text in benchmark:
        words = ALNUM.findall(lower(text))
        n = min(size, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            found.setdefault(tuple(words[at : at + n]), set()).add(item)
    return found


def contamination(text, known: dict):
    """Words, hit words, and sorted item names of one text."""
    words, hit, items = ALNUM.findall(lower(text)), set(), set()
    for n in {len(k) for k in known}:
        for at in range(len(words) - n + 1):
            if tuple(words[at : at + n]) in known:
                items |= known[tuple(words[at : at + n])]
                hit.update(range(at, at + n))
    return len(words), len(hit), sorted(str(i) for i in items if i is not None)


def fingerprint(text) -> int:
    words = SPACED.findall(lower(text))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    runs = runs or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict[int, int], most: int = 3) -> dict[int, int]:
    """Smallest id reachable by links of at most ``most`` differing bits."""
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    above = list(range(len(ids)))

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    for k in range(len(ids)):
        for other in np.nonzero(np.bitwise_count(values ^ values[k]) <= most)[0]:
            a, b = sorted((top(k), top(int(other))))
            above[b] = a
    return {ids[k]: ids[top(k)] for k in range(len(ids))}


def targets(sizes: dict, weights=(5, 2, 1), share=1.5) -> dict:
    """Targets per source by sharing out what stands above, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    given = {s: 0.0 for s in sizes}
    left = share * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in sizes if given[s] < 2 * sizes[s] - 1e-9]
        if not free:
            break
        total = sum(weight[s] for s in free)
        spare = 0.0
        for s in free:
            more = given[s] + left * weight[s] / total
            given[s] = min(more, 2 * sizes[s])
            spare += more - given[s]
        left = spare
    return given


def coin(doc_id, text) -> float:
    parts = ["mix", *([str(doc_id)] if doc_id is not None else [])]
    parts += [hashlib.md5(text.encode()).hexdigest()] if text is not None else []
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16) / 16**13


def copies(doc_id, text, rate: float) -> int:
    rate = min(rate, 2.0)
    return int(rate) + (coin(doc_id, text) < rate - int(rate))
