"""Ranked search over the index, and the titles that results show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_since, days_until
from ..functions.text import if_any, once, text

DEFAULT_TITLE = "Offre"


def display_title() -> Column:
    """Over a job's columns: its name, else its first specialties, grade, title."""
    given = F.filter(F.coalesce("specialties", F.array().cast("array<string>")), lambda s: text(s) != "")
    return F.coalesce(if_any(text("job_name"), F.array_join(F.slice(given, 1, 3), " / "), text("grade"), text("listing_title")), F.lit(DEFAULT_TITLE))


def result_titles(match: Column) -> dict[str, Column]:
    """title, source_title, search_title of an index row with its match."""
    source = F.trim(F.coalesce(if_any(text("listing_title"), text("search_title")), F.lit(DEFAULT_TITLE)))
    search = F.trim(F.coalesce(if_any(text("search_title")), source))
    label = F.when(match["evidence"]["field"] == "context_rule", text(match["label"]))
    return {"title": F.coalesce(if_any(F.trim(text("job_name")), label), search), "source_title": source, "search_title": search}


def rank(match: Column, publication: Column | str, deadline: Column | str, now: Column) -> Column:
    """-1 for what must not be shown, else 0 to 100."""
    score = F.coalesce(match["score"], F.lit(0.0))
    hidden = match.isNull() | ~F.coalesce(match["searchable"], F.lit(True)) | F.coalesce(match["confidence"] == "RELATED", F.lit(False)) | (match["confidence"].isNull() & (score < 92))
    fresh = F.greatest(10.0 - F.least(days_since(publication, now), F.lit(15)) * (10.0 / 15.0), F.lit(0.0))
    total = F.least(score * 0.82 + fresh + F.least(days_until(deadline, now), F.lit(10)) * 0.3 + 5.0, F.lit(100.0))
    return F.when(hidden, -1.0).otherwise(F.round(total, 2))


#: What a result shows of an announcement.
SHOWN = ["uuid", "listing_title", "job_name", "search_title", "specialties", "administration", "publication_date", "deadline", "positions", "url"]


def search(index: DataFrame, profession_id: str, now: Column, limit: int = 20) -> DataFrame:
    """The best `limit` announcements of a profession, best first; reads all of
    the index."""
    own = F.try_element_at(F.filter("profession_matches", lambda m: m["profession_id"] == profession_id), F.lit(1))
    hit = index.filter(F.exists("profession_matches", lambda m: m["profession_id"] == profession_id)).withColumn("m", once(own))
    return search_postings(hit, now, limit)


def postings(index: DataFrame) -> DataFrame:
    """profession_id, m (the announcement's first match with it) and what a result
    shows: a row a profession that an announcement has."""
    ids = F.transform("profession_matches", lambda m: m["profession_id"])
    first = F.filter("profession_matches", lambda m, i: F.array_position(ids, m["profession_id"]) == i + 1)
    return index.select(F.explode(first).alias("m"), *SHOWN).select(F.col("m.profession_id").alias("profession_id"), "m", *SHOWN)


def search_postings(hit: DataFrame, now: Column, limit: int = 20) -> DataFrame:
    """The best `limit` of a profession's announcements, each with its match m."""
    hit = hit.withColumn("score", once(rank(F.col("m"), "publication_date", "deadline", now))).filter("score >= 0")
    titles = {f"shown_{k}": v for k, v in result_titles(F.col("m")).items()}
    rows = hit.withColumns(titles).select(
        "score", F.col("m").alias("profession_match"), "uuid", F.col("shown_title").alias("title"), F.col("shown_source_title").alias("source_title"), F.col("shown_search_title").alias("search_title"),
        F.col("m.label").alias("matched_profession_label"), "specialties", "administration", "publication_date", "deadline", "positions", "url",
    )
    return rows.orderBy(F.desc("score"), F.coalesce("publication_date", F.lit("")).desc(), F.coalesce("uuid", F.lit(""))).limit(limit)
