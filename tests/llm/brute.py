"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, k=5):
    w = words(text)
    return frozenset([tuple(w[i : i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []))


def components(pairs):
    """Of (doc_id, text): component of each doc_id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def dedup_lines(pairs):
    """Texts without the lines under later three-line windows, in the order of doc_id."""
    seen, out = set(), {}
    for i, t in sorted(pairs):
        if t is None:
            out[i] = None
            continue
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not any(w):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def repeated_spans(pairs, least=50):
    where = defaultdict(set)
    held = {i: words(t) for i, t in pairs}
    for i, w in held.items():
        for s in range(len(w) - least + 1):
            where[tuple(w[s : s + least])].add(i)
    out = []
    for i, w in held.items():
        spans, later = [], set()
        for s in range(len(w) - least + 1):
            docs = where[tuple(w[s : s + least])]
            if len(docs) > 1:
                if min(docs) != i:
                    later.update(range(s, s + least))
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        out += [(i, a, b, len([x for x in later if a <= x < b])) for a, b in spans]
    return sorted(out)
