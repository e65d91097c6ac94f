"""Brute-force versions that several tests share."""

from collections import defaultdict

from panelforge.llm.common import ASCII_LOWER


def brute_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r["text"] or "").translate(ASCII_LOWER)].append(r["doc_id"])
    return groups


def brute_components(rows, words, percent=80):
    ids, sets = [], []
    for r in rows:
        w = (r["text"] or "").translate(ASCII_LOWER).encode().split()
        s = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        if r["doc_id"] is not None:
            ids.append(r["doc_id"])
            sets.append(s)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(ids[i]), root(ids[j])
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in zip(ids, sets, strict=True)}
