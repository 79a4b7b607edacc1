"""Slow, plain versions of the text operators."""

import re


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def jaccard_components(rows, percent=80):
    """{row number: (size, least id)} for rows of (id, text); compares every two sets that share a shingle."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for held in holders.values():
        for a in range(len(held)):
            for b in range(a + 1, len(held)):
                if (held[a], held[b]) not in seen:
                    seen.add((held[a], held[b]))
                    s, t = sets[held[a]], sets[held[b]]
                    if 100 * len(s & t) >= percent * len(s | t):
                        parent[find(held[a])] = find(held[b])
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]
