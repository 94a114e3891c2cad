"""Toxicity (8): a chain of linear classifiers.

Categories are predicted one after another; a later model has the earlier
categories' probabilities among its features. It is trained with out-of-fold
ones: each training row's earlier probability comes from a model that has not
seen the row. A model is a ridge logistic regression on the presence of hashed
words and beginnings of words: the `most_words` of them that separate its
category best, by at least `least_z` standard deviations.

The models are fit on at most `most_rows` labelled rows, the first by the hash
of their identifier, and at most `most_features` hashed words of each, the least
ones; only these come to the driver (four bytes each). Rows with the same words
are in the same fold, so no copy of a row tells its probability. All documents
are scored, in whole texts.

Defined results: a null or empty text or one without words has probability 0 in
every category; a text of any length is scored whole; labelled rows without
identifier, text or any label are not learned from; several labels of an
identifier count by the largest, of several texts any one is learned from; of
equally telling words those with the least hash come first, and a probability
equal to the threshold calls the category; a category whose labels are all equal
is predicted at that rate; repeated rows score alike; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words are runs of letters, digits, bytes over 127 and the symbols of junk.
PREFIXES = (4, 5, 6, 7, 8)
_SOLID = np.zeros(256, dtype=bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"#*$%&|<>"]] = True


def present(texts: pa.Array, size: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and in order; which texts have words.
    Features are hashed words and their beginnings of PREFIXES bytes."""
    w = common.Words(texts, lower=True, solid=_SOLID)
    codes, distinct = w.coded()
    # the features of each distinct word, then those of each text's distinct words
    of = [[xxhash.xxh3_64_intdigest(x, 0) % size, *(xxhash.xxh3_64_intdigest(x[:p], p) % size for p in PREFIXES if len(x) > p)] for x in distinct]
    count = np.fromiter(map(len, of), np.int64, len(of))
    flat = np.fromiter((f for x in of for f in x), np.int64, int(count.sum()))
    if wanted is not None:
        on = wanted[flat]
        count = np.diff(np.append(0, np.cumsum(on))[np.append(0, np.cumsum(count))])
        flat = flat[on]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), w.lengths())
    seen = np.unique(doc << 32 | codes)
    doc, codes = seen >> 32, seen & 0xFFFFFFFF
    code = flat[common.ragged((np.cumsum(count) - count)[codes], count[codes])]
    pair = np.unique(np.repeat(doc, count[codes]) * size + code)
    return pair // size, pair % size, w.lengths() > 0


@dataclass
class Linear:
    words: np.ndarray  # hashed words
    weights: np.ndarray  # of the words, then of the chain's features
    intercept: float

    def raw(self, doc: np.ndarray, code: np.ndarray, n: int, chain: np.ndarray, size: int) -> np.ndarray:
        table = np.zeros(size)
        table[self.words] = self.weights[: len(self.words)]
        return self.intercept + np.bincount(doc, weights=table[code], minlength=n) + chain @ self.weights[len(self.words) :]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(doc: np.ndarray, code: np.ndarray, n: int, y: np.ndarray, chain: np.ndarray, size: int, most_words: int, ridge: float, least_z: float) -> Linear:
    pos = y > 0.5
    if not len(y) or pos.all() or not pos.any():
        rate = float(y.mean()) if len(y) else 0.0
        return Linear(np.zeros(0, np.int64), np.zeros(chain.shape[1]), float(logit(np.array([rate]))[0]))
    a, b = np.bincount(code[pos[doc]], minlength=size), np.bincount(code[~pos[doc]], minlength=size)
    pa_, pb = (a + 0.5) / (pos.sum() + 1), (b + 0.5) / ((~pos).sum() + 1)
    p = (a + b + 1) / (n + 2)
    z = np.abs(pa_ - pb) / np.sqrt(p * (1 - p) * (1 / pos.sum() + 1 / (~pos).sum()))
    z[a + b < 3] = 0
    words = np.sort(np.argsort(-z, kind="stable")[:most_words])
    words = words[z[words] > least_z]
    column = np.full(size, -1)
    column[words] = np.arange(len(words))
    x = np.zeros((n, len(words) + chain.shape[1] + 1))
    on = column[code] >= 0
    x[doc[on], column[code[on]]] = 1
    x[:, len(words) : -1] = chain
    x[:, -1] = 1
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(25):  # Newton steps
        q = sigmoid(x @ beta)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(penalty), x.T @ (y - q) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Linear(words, beta[:-1], float(beta[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which on a category is called present: where the
    out-of-fold predictions have the best F1 (0.5 if there is nothing to tell)."""
    if not y.any() or y.all():
        return 0.5
    by = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[by])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + y.sum())
    last = np.append(p[by][1:] < p[by][:-1], True)  # not between equal ones
    i = int(np.argmax(np.where(last, f1, -1)))
    low = p[by][i + 1] if i + 1 < len(p) else 0.0
    return float((p[by][i] + low) / 2)


@dataclass
class Chain:
    categories: list[str]
    size: int
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        wanted = np.zeros(self.size, dtype=bool)
        for m in self.models:
            wanted[m.words] = True
        doc, code, has = present(texts, self.size, wanted)
        out = np.zeros((len(texts), 0))
        for m in self.models:
            p = sigmoid(m.raw(doc, code, len(texts), logit(out), self.size))
            out = np.hstack([out, p[:, None]])
        return np.where(has[:, None], out, 0.0)


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", most_rows: int = 8000, most_features: int = 4000, size: int = 1 << 20, most_words: int = 300, ridge: float = 0.3, least_z: float = 4.0, folds: int = 5) -> Chain:
    common.ship(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(c).cast("double").alias(f"y{i}") for i, c in enumerate(categories)])
    known = known.na.drop().orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id").dropDuplicates(["id"])
    ys = [f"y{i}" for i in range(len(categories))]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, 4_000_000):
            doc, code, _ = present(b.column(0), size)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            blobs = [code[lo : min(hi, lo + most_features)].astype(np.int32).tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *b.columns[1:]], names=["words", "id", *ys])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("text", "id", *ys).mapInArrow(words, f"words binary, id {kind}, " + ", ".join(f"{y} double" for y in ys)).collect()
    got.sort(key=lambda r: r["id"])
    lists = [np.frombuffer(r["words"], np.int32) for r in got]
    n = len(lists)
    doc, code = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64)
    chain, early = Chain(categories, size), np.zeros((n, 0))
    fold = np.array([xxhash.xxh3_64_intdigest(r["words"]) % folds for r in got], np.int64)
    for y_col in ys:
        y = np.array([r[y_col] for r in got], float)
        chain.models.append(fit_linear(doc, code, n, y, logit(early), size, most_words, ridge, least_z))
        out = np.zeros(n)
        for k in range(folds):
            inside, place = fold != k, np.cumsum(fold != k) - 1
            m = fit_linear(place[doc[inside[doc]]], code[inside[doc]], int(inside.sum()), y[inside], logit(early[inside]), size, most_words, ridge, least_z)
            out[~inside] = sigmoid(m.raw(doc, code, n, logit(early), size))[~inside]
        chain.thresholds.append(best_threshold(out, y))
        early = np.hstack([early, out[:, None]])
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 4_000_000) -> DataFrame:
    """id, p_<category> and is_<category> of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # most_words weights a category
    names = [f"p_{c}" for c in chain.categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in common.chunks(batches, chunk_bytes):
            p = own.probabilities(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, i]) for i in range(len(names)))], names=["id", *names])

    limits = [F.lit(t) for t in chain.thresholds]

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(scored, f"id {kind}, " + ", ".join(f"`{x}` double" for x in names))
    return found.select("*", *[(F.col(x) >= t).alias(f"is_{c}") for x, t, c in zip(names, limits, chain.categories, strict=True)])
