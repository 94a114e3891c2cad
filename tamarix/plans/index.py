"""Announcements to the search index, and the index's audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import once
from ..operators import policy, quality, search
from ..sources.schemas import as_jobs


def classified(jobs: DataFrame, professions: DataFrame, rules=V.CONTEXT_RULES) -> DataFrame:
    """jobs with search_title, profession_matches and profession_ids; one row a
    uuid is expected."""
    return _titled(policy.classify_jobs(as_jobs(jobs), professions, rules))


def build_index(jobs: DataFrame, professions: DataFrame, rules=V.CONTEXT_RULES) -> DataFrame:
    """classified() with related_profession_matches, from the same pass."""
    return _titled(policy.classify_jobs(as_jobs(jobs), professions, rules, hints=True))


def _titled(found: DataFrame) -> DataFrame:
    return found.withColumn("search_title", once(search.display_title())).withColumn("profession_ids", policy.ids(F.col("profession_matches")))


def index_report(index: DataFrame, professions: DataFrame, minimum: float = 0.0) -> DataFrame:
    """One row: counters, coverage and the gate."""
    row = quality.index_counters(index).drop("jobs", "classified_jobs").crossJoin(quality.coverage(index, minimum))  # one row each
    sizes = professions.agg(F.count_if(F.col("source") == "market").alias("market_professions"), F.count_if(F.col("source") != "market").alias("official_professions"))
    return row.crossJoin(sizes)
