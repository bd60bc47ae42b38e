"""Plain forms of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def shingle_set(text, size=5):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = words_of(w)
    if not w:
        return set()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}


def near_groups(docs, percent):
    sets = {d: shingle_set(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def sha(data):
    return hashlib.sha256(data).hexdigest()


def strip_words(docs, length=13):
    """{doc: (n_words, n_removed, sha256 of the kept words)}"""
    first = {}
    for d, t in docs:
        w = words_of(t)
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, t in docs:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def strip_bytes(docs, length=100):
    """{doc: (n_bytes, n_removed, n_spans, sha256 of the remaining bytes)}"""
    first = {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], (d, i))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def strip_rows(rows, length, size, same_text=False):
    """[units removed] of each (id, text) row; rows may share an id, and a null id is the largest.

    ``size`` is 1 for bytes; otherwise units are words.
    """
    units = [(t or "").encode() if size == 1 else words_of(t) for _, t in rows]
    rank = [(d is None, d or 0) for d, _ in rows]
    first, places = {}, []
    for r, u in zip(rank, units):
        mine = [(bytes(u[i : i + length]) if size == 1 else tuple(u[i : i + length]), (r, i if same_text else 0)) for i in range(len(u) - length + 1)]
        places.append(mine)
        for k, at in mine:
            first[k] = min(first.get(k, at), at)
    out = []
    for u, mine in zip(units, places):
        gone = [False] * len(u)
        for i, (k, at) in enumerate(mine):
            if first[k] < at:
                gone[i : i + length] = [True] * length
        out.append(sum(gone))
    return out
