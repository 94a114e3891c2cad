"""Quality rules (3): adaptive thresholds from mergeable quantile sketches.

Base figures come from whole texts; words, lines and windows are compared by
their bytes. Four rates (word length, symbols, repeated lines, repeated words)
go into sketches for each language and source: counts by value, values kept to
six significant bits, so a quantile is off by a 32nd at most. Sketches merge by
adding counts, first to those of a language, then to that of all rows.

Each group has thresholds of its own at every size: its quantile q over n rows
moves towards the quantile p of the level above as if `prior` more rows had it,
(n q + prior p) div (n + prior), where p has moved towards the level above it
alike. A rate may lie above the upper quartile by `reach` times the larger of
the distances between the quartiles and from the median to the 95th percentile,
plus the sketch's resolution there; word length may lie below the lower quartile
by as much, with the 5th percentile. No cutoff is fixed. The thresholds are
joined to the documents, which are kept or not.

Defined results: a null or empty text has no words and fails the base rules; a
text of any length is measured whole; a null language or source is a group of
its own; repeated rows are judged alike; a rate equal to its threshold is
inside, and of equal values the quantile takes the first that reaches its share;
groups without documents that pass the base rules get no thresholds and need
none; an empty table gives no rows; other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: rate: (expression over the base figures, in integers; low side too)
RATES = {
    "length": ("word_chars * 1000 div greatest(n_words, 1)", True),
    "symbols": ("n_symbols * 1000000 div greatest(word_chars, 1)", False),
    "lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", False),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", False),
}
#: name: (at least this share of the rows is no greater)
QUANTILES = {"q05": (1, 20), "q1": (1, 4), "q50": (1, 2), "q3": (3, 4), "q95": (19, 20)}


def repeated_words(words: common.Words, k: int = 3) -> np.ndarray:
    """Of each text: words in k-word windows found twice or more in it."""
    doc = np.repeat(np.arange(len(words.bounds) - 1), words.lengths())
    window = common.run_ranks(words.coded()[0], k)
    at = np.flatnonzero(doc[: len(window)] == doc[k - 1 :][: len(window)]) if len(window) else np.zeros(0, np.int64)
    key = doc[at] << 32 | window[at]
    by = np.argsort(key)
    again = key[by][1:] == key[by][:-1]
    twice = at[by[np.append(False, again) | np.append(again, False)]] if len(at) else at
    change = np.bincount(twice, minlength=words.n + k + 1).astype(np.int64)
    change[k:] -= np.bincount(twice, minlength=words.n + k + 1)[:-k]
    covered = np.cumsum(change)[: words.n] > 0
    return np.diff(np.append(0, np.cumsum(covered))[words.bounds])


def repeated_lines(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, those equal to an earlier one) of each text."""
    data, at, n = words.data, words.at, len(words.at) - 1
    starts = np.unique(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    edges = np.append(starts, len(data))
    doc = np.searchsorted(at, starts, side="right") - 1
    full = np.append(0, np.cumsum(~common._WS[data]))[edges]
    some = full[1:] > full[:-1]
    inside = data != 10
    offsets = np.append(0, np.cumsum(inside))[edges]
    lines = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    code = lines.filter(pa.array(some)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = doc[some]
    total = np.bincount(doc, minlength=n)
    return total, total - np.bincount(np.unique(doc << 32 | code) >> 32, minlength=n)


def base_figures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, chunk_bytes: int = 4_000_000) -> DataFrame:
    common.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.chunks(batches, chunk_bytes):
            w = common.Words(b.column(3))
            edge = w.offsets[w.bounds]
            chars = np.append(0, np.cumsum((w.packed & 0xC0) != 0x80))
            symbols = np.append(0, np.cumsum(_SYMBOL[w.packed]))
            lines, again = repeated_lines(w)
            cols = [w.lengths(), np.diff(chars[edge]), np.diff(symbols[edge]), lines, again, repeated_words(w)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(x, pa.int64()) for x in cols)], names=["id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    return rows.mapInArrow(figures, f"id {kind}, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def sketches(figures: DataFrame) -> DataFrame:
    """lang, source, rate, value (to six significant bits), n."""
    spare = "greatest(0, length(bin(v)) - 6)"
    rates = F.array(*[F.struct(F.lit(k).alias("rate"), F.expr(e).alias("v")) for k, (e, _) in RATES.items()])
    each = figures.select("lang", "source", F.explode(rates).alias("r")).select("lang", "source", "r.rate", "r.v")
    return each.withColumn("value", F.expr(f"shiftleft(shiftright(v, {spare}), {spare})")).groupBy("lang", "source", "rate", "value").agg(F.count(F.lit(1)).alias("n"))


def thresholds(sketch: DataFrame, prior: int, reach: float) -> DataFrame:
    """lang, source, rate, lo, hi of every group that has a sketch."""

    def quantiles(s: DataFrame, keys: list[str], tag: str) -> DataFrame:
        s = s.groupBy(*keys, "rate", "value").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "rate")
        s = s.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
        reached = lambda part, of: F.min(F.when(F.col("upto") * of >= F.col("all") * part, F.col("value")))
        return s.groupBy(*keys, "rate").agg(F.max("all").alias(f"n_{tag}"), *[reached(*share).alias(f"{q}_{tag}") for q, share in QUANTILES.items()])

    own, lang, every = quantiles(sketch, ["lang", "source"], "own"), quantiles(sketch, ["lang"], "lang"), quantiles(sketch, [], "all")
    lang = lang.withColumnsRenamed({"lang": "lang_of", "rate": "rate_of"})
    t = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_of")) & (F.col("rate") == F.col("rate_of"))).join(every, "rate")
    for q in QUANTILES:
        t = t.withColumn(f"{q}_lang", F.expr(f"(n_lang * {q}_lang + {prior} * {q}_all) div (n_lang + {prior})"))
        t = t.withColumn(q, F.expr(f"(n_own * {q}_own + {prior} * {q}_lang) div (n_own + {prior})"))
    low = F.create_map(*[F.lit(x) for k, (_, both) in RATES.items() for x in (k, both)])[F.col("rate")]
    above = F.greatest(F.expr("q3 - q1"), F.expr("q95 - q50")) * reach + F.expr("q3 div 32")
    below = F.greatest(F.expr("q3 - q1"), F.expr("q50 - q05")) * reach + F.expr("q1 div 32")
    return t.select("lang", "source", "rate", F.when(low, F.col("q1") - below).alias("lo"), (F.col("q3") + above).alias("hi"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = 50, reach: float = 3.0) -> DataFrame:
    """id, lang, source, the base figures, base_failed, kept."""
    figures = base_figures(docs, id_col, text_col, lang_col, source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    figures = common.landed(figures.withColumn("base_failed", failed), "quality-figures")
    limits = thresholds(sketches(figures.filter("not base_failed")), prior, reach)
    wide = limits.groupBy("lang", "source").agg(*[f(F.when(F.col("rate") == k, F.col(c))).alias(f"{c}_{k}") for k in RATES for c, f in (("lo", F.max), ("hi", F.max))])
    wide = wide.withColumnsRenamed({"lang": "lang_of", "source": "source_of"})
    rows = figures.join(wide, figures["lang"].eqNullSafe(wide["lang_of"]) & figures["source"].eqNullSafe(wide["source_of"]), "left")
    inside = F.lit(True)
    for k, (e, _) in RATES.items():
        inside = inside & F.coalesce(F.expr(e) >= F.col(f"lo_{k}"), F.lit(True)) & F.coalesce(F.expr(e) <= F.col(f"hi_{k}"), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).select(*figures.columns, "kept")
