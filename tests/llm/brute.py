"""Plain versions of the operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile("[^ \t-\r]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    words = WORD.findall(fold(text))
    if len(words) < n:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near(rows, n, percent):
    """(id, text) rows to (id, set size, component id); links by full comparison."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def repeats(rows, n=35):
    """(id, text) rows to (id, words, removed, digest of the rest)."""
    texts = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (doc_id, _), words in zip(rows, texts, strict=True):
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            if count[tuple(words[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def contained(rows, items, n=5, percent=80):
    out = []
    for doc_id, text in rows:
        own = shingles(text, n)
        for item_id, item in items:
            wanted = shingles(item, n)
            if wanted and 100 * len(own & wanted) >= percent * len(wanted):
                out.append((doc_id, item_id, len(wanted), len(own & wanted)))
    return out


ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for rank, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))


def quality_base(text):
    text = text or ""
    words = WORD.findall(text)
    count = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def targets(sizes, weights=(3, 1, 2), percent=150, times=2):
    """Source sizes to targets, by sharing the excess until no source is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()) * percent / 100, {}, list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > times * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = float(times * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in over]
    return out
