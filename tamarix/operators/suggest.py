"""Autocomplete and query resolution.

A query meets the terms that an index gives for it. Whatever scores by the first
rules has the query at the beginning of one of its words and what follows it, so
such a suffix of the term lies in the range of suffixes that begin with the query.
Suffixes are posted under their first letters, as many as each rung of a short
ladder has, a query looks under the longest rung that it reaches, and the range is
tested there: a few rows for each word of a term, however long it is. A query of
several of a term's words is found by one of its words. Only the rest is compared by similarity, in the Arrow
function, and of it only pairs that can reach the least ratio r: with L letters
in both, at least r L / 2 are in common blocks, which at most L - r L others
divide, so (3 r / 2 - 1) L - 1 pairs of neighbours are in both. Terms are found
by as few of the query's rarest pairs as this leaves, then the pairs are counted.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as V
from ..functions.text import has_phrase, norm, once, tokens
from ..shipping import ship
from ..sources.files import MARKET
from .taxonomy import exact_ids, terms


@F.pandas_udf(T.DoubleType())
def _ratio(query: pd.Series, term: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, q, t).ratio() for q, t in zip(query, term, strict=True)], dtype=float)


def similarity(query: Column, term: Column) -> Column:
    ship()
    return _ratio(query, term)


def structured_score(q: Column, q_tokens: Column, t: Column, t_tokens: Column) -> Column:
    """The score by rules, null if none holds."""
    subset = (F.size(q_tokens) > 0) & (F.size(F.array_except(q_tokens, t_tokens)) == 0)
    return (
        F.when(q == t, 1000.0)
        .when(F.startswith(t, q), 920.0)
        .when(F.exists(F.split(t, " "), lambda w: F.startswith(w, q)), 860.0)
        .when(has_phrase(t, q), 820.0)
        .when(subset, 780.0 + F.least(F.size(q_tokens), F.lit(5)))
    )


#: Numbers of first letters under which the suffixes of terms are posted.
LADDER = (1, 2, 3, 5, 8, 12)


def suffixes(norm_term: Column) -> Column:
    """Each word of the term with all that follows it."""
    words = F.split(norm_term, " ")
    return F.transform(words, lambda w, i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))


def rungs(norm_term: Column) -> Column:
    """The first letters of a term's suffixes, by the rungs that they reach."""
    tails = suffixes(norm_term)
    return F.array_distinct(F.flatten(F.array(*[F.transform(F.filter(tails, _reaches(n)), _first(n)) for n in LADDER])))


def _reaches(n: int):
    return lambda t: F.length(t) >= n


def _first(n: int):
    return lambda t: F.substring(t, 1, n)


def rung(q: Column) -> Column:
    """The first letters of a query under which it is looked up."""
    at = F.when(F.length(q) < LADDER[1], F.substring(q, 1, LADDER[0]))
    for n, more in zip(LADDER[1:], [*LADDER[2:], None], strict=True):
        at = at.when(F.length(q) < more, F.substring(q, 1, n)) if more else at.otherwise(F.substring(q, 1, n))
    return at


def neighbours(value: Column) -> Column:
    """The pairs of neighbouring letters, each with how often it came before."""
    grams = F.when(F.length(value) > 1, F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, 1, i), lambda x: x == g)).cast("string")))


def least_shared(a: Column, b: Column) -> Column:
    """Pairs of neighbours that strings of these lengths share at the least ratio."""
    return F.greatest(F.ceil((1.5 * V.FUZZY_RATIO - 1) * (a + b) - 1 - 1e-9), F.lit(1)).cast("int")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query").distinct().withColumn("q", norm("query")).filter("q <> ''").withColumn("q_tokens", F.array_distinct(tokens(F.col("q"))))


def _similar(q: DataFrame, t: DataFrame) -> DataFrame:
    """Pairs without a score by rules whose ratio is high enough."""
    strings = t.select("norm_term").distinct().withColumn("term_pairs", neighbours(F.col("norm_term")))
    each = strings.select("norm_term", "term_pairs", F.explode("term_pairs").alias("pair"))
    often = each.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    pairs = q.select("q", "q_tokens").distinct().withColumn("q_pairs", neighbours(F.col("q")))
    # a pair that no term has is no key, but takes a place among the rarest
    rare = pairs.select("q", F.explode("q_pairs").alias("pair")).join(often, "pair", "left").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))), lambda x: x["pair"]).alias("rarest"))
    shortest = F.ceil(F.length("q") * V.FUZZY_RATIO / (2 - V.FUZZY_RATIO) - 1e-9)
    keys = F.slice("rarest", 1, F.greatest(F.size("rarest") - least_shared(F.length("q"), shortest) + 1, F.lit(1)))
    asked = pairs.join(rare, "q").withColumn("keys", keys)
    found = asked.select("q", "q_tokens", "q_pairs", "keys", F.explode("keys").alias("pair")).join(each, "pair")
    lengths = 2 * F.least(F.length("q"), F.length("norm_term")) / (F.length("q") + F.length("norm_term"))
    shared = F.size(F.array_intersect("q_pairs", "term_pairs")) >= least_shared(F.length("q"), F.length("norm_term"))
    first = F.get(F.array_intersect("keys", "term_pairs"), F.lit(0)) == F.col("pair")  # where they meet first
    near = found.filter(first & (lengths >= V.FUZZY_RATIO) & shared).select("q", "norm_term").withColumn("ratio", once(similarity(F.col("q"), F.col("norm_term")))).filter(F.col("ratio") >= V.FUZZY_RATIO)
    met = q.join(near, "q").join(t, "norm_term")
    return met.filter(structured_score(F.col("q"), F.col("q_tokens"), F.col("norm_term"), F.col("term_tokens")).isNull()).withColumn("score", 500 + 100 * F.col("ratio")).drop("ratio")


def term_scores(queries: DataFrame, professions: DataFrame, fuzzy: bool = True) -> DataFrame:
    """query and the columns of terms with score, for all pairs that have one."""
    q, t = _asked(queries), terms(professions)
    ruled = structured_score(F.col("q"), F.col("q_tokens"), F.col("norm_term"), F.col("term_tokens"))
    posted = t.withColumn("key", F.explode(rungs(F.col("norm_term"))))
    begun = q.withColumn("key", rung(F.col("q"))).join(posted, "key").drop("key")
    begun = begun.filter(F.exists(suffixes(F.col("norm_term")), lambda s: F.startswith(s, F.col("q")))).withColumn("score", ruled)
    worded = q.withColumn("key", F.array_min("q_tokens")).join(t.withColumn("key", F.explode("term_tokens")), "key").drop("key").withColumn("score", ruled)
    # what the first rules score is among those begun already
    found = begun.filter("score >= 800").unionByName(worded.filter(F.col("score") < 800))
    return found.unionByName(_similar(q, t)) if fuzzy else found


def suggest(queries: DataFrame, professions: DataFrame, limit: int = 10, fuzzy: bool = True) -> DataFrame:
    """query, rank and the suggestion: the rows of the first tier that has any."""
    s = term_scores(queries, professions, fuzzy)
    what = F.struct("label", "sector", "family", "hcp_codes", "source", "term", "score", "ord")
    best = s.groupBy("query", F.col("id").alias("profession_id")).agg(F.max_by(what, F.struct("score", -F.col("term_ord"))).alias("b"), F.max(F.when(F.col("term_ord") == 0, F.col("score"))).alias("label_score"))
    charge = F.when(F.contains(norm("b.label"), F.lit("n c a")), 90.0).otherwise(0.0)
    best = best.select("query", "profession_id", "b.label", "b.sector", "b.family", "b.hcp_codes", "b.source", F.col("b.term").alias("matched_term"), F.round(F.col("b.score") - charge, 2).alias("score"), (F.coalesce("label_score", F.lit(-1.0)) - charge).alias("label_score"), "b.ord")
    official = F.when(F.col("source") == MARKET, 0).otherwise(2)
    tier = F.when(F.col("score") >= V.STRUCTURED_TIER, official).when(F.col("score") >= V.FUZZY_TIER, official + 1)
    tiered = best.withColumn("tier", tier).filter("tier is not null")
    first = tiered.withColumn("first", F.min("tier").over(Window.partitionBy("query"))).filter("tier = first")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.when(F.col("label_score") >= V.STRUCTURED_TIER, 0).otherwise(1), F.desc("label_score"), F.lower("label"), "ord")
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return ranked.select("query", "rank", "profession_id", "label", "sector", "family", "hcp_codes", "source", "matched_term", "score")


def resolve(queries: DataFrame, professions: DataFrame) -> DataFrame:
    """query, profession_id (null: to be chosen among suggestions)."""
    q = queries.select("query").distinct()
    by_id = professions.select(F.col("id").alias("query"), F.col("id").alias("as_id")).distinct()
    exact = exact_ids(professions, q).filter("size(ids) = 1").select("query", F.col("ids")[0].alias("as_term"))
    only = suggest(q, professions, limit=8).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.first("profession_id").alias("id"), F.first("score").alias("score"))
    only = only.filter((F.col("n") == 1) & (F.col("score") >= V.AUTOSELECT_MINIMUM)).select("query", F.col("id").alias("as_only"))
    return q.join(by_id, "query", "left").join(exact, "query", "left").join(only, "query", "left").select("query", F.coalesce("as_id", "as_term", "as_only").alias("profession_id"))
