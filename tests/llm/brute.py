"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import xxhash

SPACE = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs: list[tuple[int, str | None]], distance: int = 3) -> dict[int, tuple[str, int]]:
    prints = [(i, fingerprint(t)) for i, t in docs]
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (a, fa) in enumerate(prints):
        for b, fb in prints[n + 1:]:
            if (fa ^ fb).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (f"{f:016x}", find(i)) for i, f in prints}


def remove_repeats(docs: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k:k + window]), i)
    out = {}
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


KINDS = ("assign", "access", "hex")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    letters = "(password|passwd|secret|token|api_?key)"
    letters = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in letters)
    patterns = (("assign", letters + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("access", "AKIA[A-Z0-9]+", 20),
                ("hex", "[0-9a-f]+", 24))
    spans = []
    for kind, pattern, least in patterns:
        for m in re.finditer(pattern, text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                spans.append((kind, m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def overlaps(docs: list, items: list, window: int = 20, share: float = 0.8) -> set[tuple[int, int]]:
    """(document, item) pairs with a window of words that are equal at their places.

    Every shift with three equal words in a row is tried; no other can do.
    """
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    places: dict[tuple, list] = {}
    texts = {i: split(u) for i, u in items}
    for i, v in texts.items():
        for k in range(len(v) - 2):
            places.setdefault(tuple(v[k:k + 3]), []).append((i, k))
    found = set()
    for d, t in docs:
        w = split(t)
        shifts = {(i, at - k) for at in range(len(w) - 2) for i, k in places.get(tuple(w[at:at + 3]), ())}
        for i, shift in shifts:
            v = texts[i]
            size = min(window, len(v))
            same = [0 <= k + shift < len(w) and w[k + shift] == x for k, x in enumerate(v)]
            if any(sum(same[k:k + size]) >= share * size for k in range(len(v) - size + 1)):
                found.add((d, i))
    return found
