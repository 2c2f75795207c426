"""Plain versions of the operators, for comparison on small tables."""

import re


def shingle_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    return out


def components(ids, sets, num, den):
    """Smallest id reachable from each row by links of similar sets."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = set()
    for rows in where.values():
        near.update((a, b) for k, a in enumerate(rows) for b in rows[k + 1 :])
    for a, b in near:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [least[find(i)] for i in range(len(ids))]


def repeated(texts, size):
    """For each text the bytes that stay, and its removed ranges."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - size + 1):
            s = b[i : i + size]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for b in data:
        ranges = []
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                if ranges and i <= ranges[-1][1]:
                    ranges[-1][1] = i + size
                else:
                    ranges.append([i, i + size])
        kept, at = b"", 0
        for a, e in ranges:
            kept, at = kept + b[at:a], e
        out.append((kept + b[at:], ranges))
    return out
