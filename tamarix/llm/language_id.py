"""Language ID (2): multilingual mixture inference.

A language is a distribution over character trigrams of letter runs, hashed to
`buckets` and counted over all training rows. A document is a mixture: each
word comes from one language, and expectation-maximisation estimates the
proportions from the words' likelihoods. Of the sets of the 1, 2, 3, .. most
present languages, up to all of them, the one with the best penalised likelihood
is selected; the prediction is its most present language, the score that
language's proportion, and the mixture (`mix_out`) all its languages with theirs.

No set of k languages can have more than L + n log(max g) less k penalties: L is
the likelihood of n words under proportions p of all languages, g a language's
mean share of the words' likelihood under p over its share in p (the logarithm
is concave). Sizes that can't reach the best value so far by this bound aren't
tried, so the selection is that of trying all sizes.

A text's fit is the mean over its words of their log likelihood a trigram, in the
best of the selected languages, above what the languages' own trigrams have, at
the upper end of its uncertainty (`sure` deviations over the root of its words);
so one long code or key among few words is one word; worst_fit() is the limit that
the model and the fits of texts with a known language set.

Chunks of text get smaller with the number of languages, so that a chunk's table
of words by languages stays bounded; one text is never divided, and its table
grows with its different words.

Defined results: `und`, 0 and no mixture for a null text, a text without letters,
and when there are no training rows; texts of any length are read whole; ties go
to the language first by code point; repeated rows are predicted alike; an empty
table gives no rows; other columns pass through unread, and an output column
whose name they have gets underscores.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
BOUNDARY = 10


def trigrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' trigrams, each word's number of them)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = "\n" + "\n".join(w.decode("utf-8", "replace") for w in words).lower() + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    new = np.cumsum(c == BOUNDARY)  # word i + 1 follows its mark
    letter = _LETTER[c]
    c = np.where(letter, c, np.uint64(BOUNDARY))
    h = common.mixed((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:])
    middle = letter[1:-1]
    return (h[middle] % np.uint64(buckets)).astype(np.int64), np.bincount(new[1:-1][middle] - 1, minlength=len(words))


class LanguageModel:
    def __init__(self, languages: list[str], log_p: np.ndarray, penalty: float = 3.0, steps: int = 10, sure: float = 3.0):
        self.languages, self.log_p, self.penalty, self.steps, self.sure = languages, log_p, penalty, steps, sure
        self.usual = np.array([np.exp(x) @ x for x in log_p])
        self.spread = np.sqrt(np.maximum(np.array([np.exp(x) @ (x * x) for x in log_p]) - self.usual**2, 0))

    def _em(self, like: np.ndarray, top: np.ndarray, times: np.ndarray, starts: np.ndarray, sizes: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(proportions, log likelihood, what it is at most for any proportions
        of the allowed languages) by document; like: entries x languages."""
        p = allowed / allowed.sum(1, keepdims=True)
        total = np.maximum(np.add.reduceat(times, starts), 1e-9)
        for _ in range(self.steps):
            each = like * np.repeat(p, sizes, axis=0)
            norm = np.maximum(each.sum(1), 1e-300)
            p = np.add.reduceat(each * (times / norm)[:, None], starts, axis=0) / total[:, None]
        norm = np.maximum((like * np.repeat(p, sizes, axis=0)).sum(1), 1e-300)
        value = np.add.reduceat(times * (np.log(norm) + top), starts)
        slope = np.add.reduceat(like * (times / norm)[:, None], starts, axis=0) / total[:, None]
        return p, value, value + total * np.log(np.maximum(np.where(allowed > 0, slope, 0).max(1), 1.0))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, list[list[dict]]]:
        """(name, score, fit; nan for `und`, mixture) of each text."""
        n_texts, n_lang = len(texts), len(self.languages)
        names, scores, fits, mixtures = ["und"] * n_texts, np.zeros(n_texts), np.full(n_texts, np.nan), [[] for _ in range(n_texts)]
        words = common.Words(texts)
        if not words.n or not n_lang:
            return names, scores, fits, mixtures
        codes, distinct = words.coded()
        grams, count = trigrams(distinct, self.log_p.shape[1])
        of_word = np.zeros((len(distinct), n_lang))
        some = count > 0
        if not some.any():
            return names, scores, fits, mixtures
        begins = (np.cumsum(count) - count)[some]
        of_word[some] = np.stack([np.add.reduceat(row[grams], begins) for row in self.log_p], axis=1)
        # one entry for each distinct word with letters of each text
        doc = np.repeat(np.arange(n_texts), words.lengths())
        pair = (doc * np.int64(len(distinct)) + codes)[some[codes]]
        pair, times = np.unique(pair, return_counts=True)
        doc, code = pair // len(distinct), pair % len(distinct)
        if not len(doc):
            return names, scores, fits, mixtures
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        sizes = np.diff(np.append(starts, len(doc)))
        log_like = of_word[code]
        top = log_like.max(1)
        like, times = np.exp(log_like - top[:, None]), times.astype(float)
        n = np.add.reduceat(times, starts)
        p, _, bound = self._em(like, top, times, starts, sizes, np.ones((len(starts), n_lang)))
        rank = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
        charge = self.penalty * np.log(n + 1)
        best = (rank == 0).astype(float)
        one = np.add.reduceat(log_like * times[:, None], starts, axis=0)
        best_value = np.take_along_axis(one, np.argmin(rank, axis=1)[:, None], axis=1)[:, 0] - charge
        for k in range(2, n_lang + 1):
            going = np.flatnonzero(bound - k * charge > best_value)
            if not len(going):
                break  # nor can any larger set
            at = common.ragged(starts[going], sizes[going])
            q, value, _ = self._em(like[at], top[at], times[at], np.cumsum(sizes[going]) - sizes[going], sizes[going], (rank[going] < k).astype(float))
            value -= k * charge[going]
            better = value > best_value[going]
            best[going[better]], best_value[going[better]] = q[better], value[better]
        of_best = np.where(np.repeat(best > 0, sizes, axis=0), log_like, -np.inf).max(1) / count[code]
        fits[doc[starts]] = np.add.reduceat(times * of_best, starts) / n - best @ self.usual + self.sure * (best @ self.spread) / np.sqrt(n)
        chosen = np.argmax(best, axis=1)
        for d, i, s in zip(doc[starts].tolist(), chosen.tolist(), np.clip(best.max(1), 0, 1).tolist(), strict=True):
            names[d], scores[d] = self.languages[i], s
        shares = best / best.sum(1, keepdims=True)
        for i, lang in zip(*(x.tolist() for x in np.nonzero(best)), strict=True):
            mixtures[doc[starts[i]]].append({"lang": self.languages[lang], "share": float(shares[i, lang])})
        return names, scores, fits, mixtures


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 16, most_languages: int = 400, chunk_bytes: int = 4_000_000) -> LanguageModel:
    """The model of all rows with a language. At most most_languages * buckets
    counts come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in common.chunks(batches, chunk_bytes):
            words = common.Words(b.column(1))
            codes, distinct = words.coded()
            grams, count = trigrams(distinct, buckets)
            langs = b.column(0).dictionary_encode()
            of = np.repeat(langs.indices.to_numpy(zero_copy_only=False), words.lengths())
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                times = np.bincount(codes[of == i], minlength=len(distinct))
                total[lang] = total.get(lang, 0) + np.bincount(grams, weights=np.repeat(times, count), minlength=buckets)
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(t[at].astype(np.int64))], names=["lang", "bucket", "n"])

    common.ship(rows.sparkSession)
    train = rows.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = common.landed(train.mapInArrow(counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "lang-counts")
    languages = [r["lang"] for r in sums.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts, row = np.full((len(languages), buckets), 0.05), {lang: i for i, lang in enumerate(languages)}
    for r in sums.toLocalIterator():
        counts[row[r["lang"]], r["bucket"]] += r["n"]
    common.discard(sums)
    return LanguageModel(languages, np.log(counts / counts.sum(1, keepdims=True)))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", chunk_bytes: int = 4_000_000, fit_out: str | None = None, mix_out: str | None = None) -> DataFrame:
    """docs with the two columns added, and the fit and the mixture (an array of
    lang and share) if they are given names."""
    common.ship(docs.sparkSession)
    lang_out, score_out = common.fresh(docs, lang_out), common.fresh(docs, score_out)
    mixture = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    more = [T.StructField(c, kind) for c, kind in ((fit_out, T.DoubleType()), (mix_out, mixture)) if c]
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), *more])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_languages * buckets numbers
    size = max(50_000, min(chunk_bytes, 16 * chunk_bytes // max(1, len(model.languages))))
    arrow_mix = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in common.chunks(batches, size, text_col):
            names, scores, fits, mixtures = own.predict(b.column(b.schema.get_field_index(text_col)))
            found = [pa.array(names, pa.string()), pa.array(scores)] + [pa.array(fits, from_pandas=True)] * bool(fit_out) + [pa.array(mixtures, arrow_mix)] * bool(mix_out)
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, lang_out, score_out, *[f.name for f in more]])

    return docs.mapInArrow(predicted, schema)


def worst_fit(fits: DataFrame, fit_col: str, model: LanguageModel, reach: int = 8, prior: int = 50) -> float:
    """The fit below which a text is in none of the languages.

    The n fits of `fits` say `reach` times as far below their median as their
    first percentile is (counts by 50ths). The model alone says the least fit that
    any text can have, which drops nothing. The limit is the mean of both,
    (n * said + prior * alone) / (n + prior): it moves from the first fit on, and
    is theirs for many."""
    alone = float(min(model.log_p.min(axis=1) - model.usual)) if model.languages else 0.0
    counts = fits.filter(F.col(fit_col).isNotNull()).groupBy(F.floor(F.col(fit_col) * 50).alias("v")).count().orderBy("v").collect()
    upto = np.cumsum([r["count"] for r in counts])
    if not len(upto):
        return alone
    low, mid = (counts[int(np.searchsorted(upto, q * upto[-1]))]["v"] / 50 for q in (0.01, 0.5))
    n = int(upto[-1])
    return (n * (mid - reach * max(mid - low, 0.02)) + prior * alone) / (n + prior)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
