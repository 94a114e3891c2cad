"""The classifier chain against a plain one: words, folds, models, thresholds and
probabilities, text by text."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tamarix.llm import toxicity

SIZE = 1 << 20


def features(text):
    """Hashed words and their beginnings, of one text."""
    out = set()
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff#*$%&|<>]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())):
        out.add(xxhash.xxh3_64_intdigest(w, 0) % SIZE)
        out |= {xxhash.xxh3_64_intdigest(w[:p], p) % SIZE for p in (4, 5, 6, 7, 8) if len(w) > p}
    return out


def chosen(sets, y, most, least):
    """The words that tell the category best, by a two-sample z of proportions."""
    pos, neg = [s for s, v in zip(sets, y, strict=True) if v], [s for s, v in zip(sets, y, strict=True) if not v]
    z = {}
    for f in set().union(*sets):
        a, b = sum(f in s for s in pos), sum(f in s for s in neg)
        if a + b >= 3:
            p = (a + b + 1) / (len(sets) + 2)
            z[f] = abs((a + 0.5) / (len(pos) + 1) - (b + 0.5) / (len(neg) + 1)) / math.sqrt(p * (1 - p) * (1 / len(pos) + 1 / len(neg)))
    best = sorted(z, key=lambda f: (-z[f], f))[:most]
    return sorted(f for f in best if z[f] > least)


def model(sets, early, y, most, least, ridge):
    """A function from (set, earlier logits) to a probability: the minimum of the
    ridge loss, by many steps of plain descent along scaled slopes."""
    words = chosen(sets, y, most, least)
    x = np.array([[float(w in s) for w in words] + list(e) + [1.0] for s, e in zip(sets, early, strict=True)])
    beta, charge = np.zeros(x.shape[1]), np.array([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = sum((p[i] * (1 - p[i])) * np.outer(x[i], x[i]) for i in range(len(x))) + np.diag(charge)
        beta = beta + np.linalg.lstsq(curve, x.T @ (np.array(y) - p) - charge * beta, rcond=None)[0]
    return lambda s, e: 1 / (1 + math.exp(-max(-30, min(30, float(np.dot(beta, [float(w in s) for w in words] + list(e) + [1.0]))))))


def squashed(p):
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def threshold(p, y):
    best, at = -1.0, None
    for t in sorted(set(p), reverse=True):
        hit = sum(v for q, v in zip(p, y, strict=True) if q >= t)
        f1 = 2 * hit / (sum(q >= t for q in p) + sum(y))
        if f1 > best + 1e-12:
            best, at = f1, t
    return (at + max((q for q in p if q < at), default=0.0)) / 2


@pytest.mark.parametrize("least", [1.0, 2.5])
def test_chain_against_a_plain_one(spark, least):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("idio", "clow", "fine", "sunn") for b in ("tic", "nish", "day", "sch") for c in ("", "s", "ness")]
    rows = []
    for i in range(90):
        words = rng.choices(vocabulary, k=12)
        rude = sum(w.startswith("idio") for w in words) >= 4
        text = " ".join(words) + (" XXX!" if i % 7 == 0 else "")
        rows.append((i, text, int(rude or rng.random() < 0.05), int((rude and i % 3 > 0) or i % 7 == 0)))
    rows += [(100 + i, rows[i][1], *rows[i][2:]) for i in range(8)]  # copies share a fold
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(r[0], *r[2:]) for r in rows], "doc_id long, a int, b int")
    chain = toxicity.fit(docs, labels, ["a", "b"], least_z=least, most_words=25, folds=4)
    sets = [features(r[1]) for r in rows]
    fold = [xxhash.xxh3_64_intdigest(np.array(sorted(s), np.int32).tobytes()) % 4 for s in sets]
    assert all(fold[i] == fold[90 + i] for i in range(8)) and len(set(fold)) == 4
    early, shown = [[] for _ in rows], [[] for _ in rows]
    for k, category in enumerate((2, 3)):
        y = [r[category] for r in rows]
        whole = model(sets, early, y, 25, least, 0.3)
        out = [0.0] * len(rows)
        for f in range(4):
            inside = [i for i in range(len(rows)) if fold[i] != f]
            part = model([sets[i] for i in inside], [early[i] for i in inside], [y[i] for i in inside], 25, least, 0.3)
            for i in range(len(rows)):
                if fold[i] == f:
                    out[i] = part(sets[i], early[i])
        assert chain.thresholds[k] == pytest.approx(threshold(out, y), abs=1e-5)
        final = [whole(s, e) for s, e in zip(sets, shown, strict=True)]
        got = chain.probabilities(pa.array([r[1] for r in rows]))[:, k]
        assert got.tolist() == pytest.approx(final, abs=1e-5)
        early = [[*e, squashed(p)] for e, p in zip(early, out, strict=True)]
        shown = [[*e, squashed(p)] for e, p in zip(shown, final, strict=True)]
