"""Plain versions of the operators, for comparison."""

import hashlib
import re
from collections import defaultdict

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ITEM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def removed(rows, split, size):
    """rows: (id, text); per row the removal flags of its units."""
    first = {}
    units = [(i, split((t or "").encode())) for i, t in rows]
    for i, u in units:
        for j in range(len(u) - size + 1 if i is not None else 0):
            k = tuple(u[j:j + size])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, u in units:
        gone = [False] * len(u)
        for j in range(len(u) - size + 1 if i is not None else 0):
            if first[tuple(u[j:j + size])] < i:
                gone[j:j + size] = [True] * size
        out.append((i, u, gone))
    return out


def words_removed(rows, size=50):
    return sorted(((i, len(u), sum(g), sha(b" ".join(w for w, x in zip(u, g) if not x)))
                   for i, u, g in removed(rows, WORD.findall, size)), key=str)


def bytes_removed(rows, size=50):
    out = []
    for i, u, g in removed(rows, lambda b: b, size):
        spans = sum(x and not y for x, y in zip(g, [False, *g]))
        out.append((i, len(u), sum(g), spans, sha(bytes(c for c, x in zip(u, g) if not x))))
    return sorted(out, key=str)


def shingles(text, n=5):
    w = WORD.findall((text or "").encode())
    return {tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_classes(rows, num=4, den=5):
    """(doc_id, class, links) of rows with unique ids."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    links = dict.fromkeys(sets, 0)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            c = len(sets[a] & sets[b])
            if c and c * den >= num * (len(sets[a]) + len(sets[b]) - c):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sorted((i, top(i), links[i]) for i in sets)


def item_hits(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = ITEM.findall((t or "").encode().lower())
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            wins[tuple(w[k:k + n])].add(i)
    out = []
    for i, t in rows:
        w = ITEM.findall((t or "").encode().lower())
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                s = wins.get(tuple(w[k:k + n]))
                if s:
                    found |= s
                    hit[k:k + n] = [True] * n
        out.append((i, len(w), sum(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), any(hit)))
    return sorted(out, key=str)
