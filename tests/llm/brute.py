"""Plain versions of the operators, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows):
    """[(doc_id, n, component)] of rows (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                same = len(a & b)
                if 100 * same >= 80 * (len(a) + len(b) - same):
                    up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def substring(rows, k=13):
    """[(doc_id, n, removed, sha256)]: words covered by a window that a smaller document has."""
    key = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, float("inf")), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < key(d):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def exact(rows):
    """[(doc_id, keep_id, group size)]; null identifiers come last."""
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return [(d, low[norm(t)], len(groups[norm(t)])) for d, t in rows]


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target}: shares by weight; what is above `most` times a source's
    size goes to the others by weight, again and again."""
    order = sorted(sizes, key=lambda x: (x is None, x))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def mixed(rows, seed="mix-1"):
    """Words taken of each entry of the mix, as a list of (doc_id, text, words),
    of rows (doc_id, text, source)."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    by = {}
    for d, t, s in rows:
        by.setdefault(s, []).append((md5("|".join([*([] if d is None else [str(d)]), md5(t or ""), seed]))[:16], len(words(t)), d, t))
    sizes = {s: sum(x[1] for x in v) for s, v in by.items()}
    target, entries = targets(sizes), []
    for rank, s in enumerate(sorted(by, key=lambda x: (x is None, x))):
        end = 0
        for _ in range(3):
            for _, n, d, t in sorted(by[s], key=lambda x: x[:2]):
                end += n
                if n:
                    entries.append((end / target[s], rank, end, n, d, t))
    left, out = sum(sizes.values()), []
    for _, _, _, n, d, t in sorted(entries, key=lambda x: x[:3]):
        if left > 0:
            out.append((d, t, min(n, left)))
            left -= n
    return out
