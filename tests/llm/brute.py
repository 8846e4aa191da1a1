"""Plain versions of the operators, for small tables."""

import numpy as np
import xxhash


def components(ids, linked):
    """id -> smallest id reachable; linked(a, b) for pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = list(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def simhash(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low:
        if c in " \t\n\r\x0b\x0c":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if now:
        words.append(now)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def cosine_links(vectors, threshold=0.9):
    """(n_links, component) by id for {id: list or None}."""
    good = {}
    for i, v in vectors.items():
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x /= np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    link = lambda a, b: a in good and b in good and len(good[a]) == len(good[b]) and float(good[a] @ good[b]) >= threshold
    n = {a: sum(link(a, b) for b in vectors if b != a) for a in vectors}
    return n, components(vectors, link)
