"""Brute-force components of texts linked by shingle similarity, for whole tables."""

from __future__ import annotations

import re
from collections import Counter


def shingle_sets(texts, words):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return sets


def components(docs, words, over, under):
    """doc_id -> (size of the set, smallest id reachable); every pair with a shared shingle
    is compared by counting what it shares."""
    sets, holders, root = shingle_sets([t for _, t in docs], words), {}, list(range(len(docs)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, own in enumerate(sets):
        shared = Counter()
        for e in own:
            shared.update(holders.get(e, ()))
            holders.setdefault(e, []).append(i)
        for j, n in shared.items():
            if under * n >= over * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)}
