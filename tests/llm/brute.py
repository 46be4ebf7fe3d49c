"""Plain versions of the corpus operators, for small tables."""

import collections
import hashlib


def words(text):
    return (text or "").encode().split()


def base(text):
    t, w = text or "", words(text)
    lines = [x for x in t.encode().split(b"\n") if x.split()]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, cover = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            cover |= {i, i + 1, i + 2}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def fold(b):
    return bytes(x + 32 if 65 <= x <= 90 else x for x in b)


def shingles(text, k=5):
    w = fold((text or "").encode()).split()
    if len(w) >= k:
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(docs, k=5):
    """doc_id -> (set size, smallest doc_id reachable) of (doc_id, text)."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def without_repeats(docs, k=20):
    """doc_id -> (words, removed, digest of the rest) of (doc_id, text)."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = words(t)
        cover = [False] * len(w)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if g in seen:
                cover[i : i + k] = [True] * k
            seen.add(g)
        out[d] = (len(w), sum(cover), hashlib.sha256(b" ".join(x for x, c in zip(w, cover) if not c)).hexdigest())
    return out
