"""Plain versions of the operators on small inputs."""

from __future__ import annotations

import hashlib


def substring(rows, window=50):
    first: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, words):
    w = bytes(text or "", "utf-8").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def near(rows, words=4, threshold=0.8):
    """[(doc_id, n_shingles, component_id, kept)] for rows with different ids."""
    sets = {d: shingle_set(t, words) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    common: dict = {}
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets.items())


def crafted_words(length=1024):
    """Two words of a and b whose hashes agree in polynomial schemes modulo a power of two (a sequence and its complement)."""
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
