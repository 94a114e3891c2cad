"""The taxonomy as tables: professions, their terms, and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm, tokens
from ..sources.files import MARKET


def terms(professions: DataFrame) -> DataFrame:
    """A row for each term (the label first, then aliases) with words in it:
    the profession's columns, term_ord, term, norm_term, term_tokens."""
    t = professions.select("*", F.posexplode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term_ord", "term"))
    t = t.withColumn("norm_term", norm("term")).filter("norm_term <> ''")
    return t.withColumn("term_tokens", F.array_distinct(tokens(F.col("norm_term"))))


def by_id(professions: DataFrame) -> DataFrame:
    """One row an id: the last one in file order."""
    return professions.groupBy("id").agg(F.max_by(F.struct("*"), "ord").alias("p")).select("p.*")


def profession(professions: DataFrame, ids: DataFrame) -> DataFrame:
    """The professions of ids (a column `id`)."""
    return by_id(professions).join(ids.select("id").distinct(), "id")


def exact_ids(professions: DataFrame, queries: DataFrame) -> DataFrame:
    """query, ids: professions with a term equal to the query, sorted; those of
    the market only, if there are any."""
    q = queries.select("query").distinct().withColumn("norm_term", norm("query"))
    hit = q.join(terms(professions).select("norm_term", "id", "source"), "norm_term")
    found = hit.groupBy("query").agg(F.array_sort(F.collect_set(F.when(F.col("source") == MARKET, F.col("id")))).alias("m"), F.array_sort(F.collect_set("id")).alias("every"))
    return found.select("query", F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("every")).alias("ids"))


def by_diploma(professions: DataFrame, queries: DataFrame) -> DataFrame:
    """query and the market professions with a diploma equal to it; order by
    sector, label."""
    held = professions.filter(F.col("source") == MARKET).select("*", F.explode("diplomas").alias("diploma")).withColumn("norm_term", norm("diploma"))
    q = queries.select("query").distinct().withColumn("norm_term", norm("query"))
    found = q.join(held.filter("norm_term <> ''"), "norm_term").select("query", "id", "label", "sector", "family", "hcp_codes", "source")
    return found.dropDuplicates(["query", "id"])


def autocomplete_export(professions: DataFrame) -> DataFrame:
    """All options with their aliases, in file order."""
    return professions.select(F.col("id").alias("profession_id"), "label", "sector", "family", "hcp_codes", "aliases", "source", "ord").orderBy("ord").drop("ord")


def export_counts(professions: DataFrame) -> DataFrame:
    return professions.agg(F.lit(2).alias("version"), F.count_if(F.col("source") == MARKET).alias("market_count"), F.count_if(F.col("source") != MARKET).alias("official_count"))
