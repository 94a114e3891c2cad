"""Landed pages to verified announcements and the completeness audit."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crawl_audit, extraction
from ..sources import crawl


def verified(listings: DataFrame, states: DataFrame, outcomes: tuple[DataFrame, DataFrame, DataFrame], now: Column, robots_allowed: bool = True) -> dict[str, DataFrame]:
    """jobs, accepted, rejected, failures, retired, scopes, decisions, audit."""
    expected = extraction.first_scope(extraction.numbered(listings))
    jobs, failures, retired = outcomes
    decided = crawl_audit.decisions(jobs, now)
    gate = crawl_audit.detail_gate(expected, jobs, retired, failures)
    return {
        "jobs": extraction.newest_first(jobs), "accepted": extraction.newest_first(decided.filter("decision = 'accepted'").drop("decision")),
        "rejected": decided.filter("decision <> 'accepted'").select("uuid", "url", F.col("decision").alias("reason")), "failures": failures, "retired": retired,
        "scopes": crawl_audit.scope_audit(states), "decisions": crawl_audit.decision_counts(decided), "audit": crawl_audit.audit_row(states, gate, decided, now, robots_allowed),
    }


def audit(raw_listing: DataFrame, raw_detail: DataFrame, now: Column, errors: DataFrame | None = None, robots_allowed: bool = True, base_url: str = extraction.BASE_URL) -> dict[str, DataFrame]:
    """verified() of pages that are landed already."""
    listings = extraction.listing(raw_listing, base_url)
    return verified(listings, crawl_audit.scope_state(listings, errors), extraction.outcomes(extraction.classified_pages(raw_detail, base_url)), now, robots_allowed)


def tasks(listings: DataFrame) -> DataFrame:
    """url, scope, title of the detail pages to read: each url once."""
    return extraction.first_scope(extraction.numbered(listings)).select("url", "scope", "title")


def _land(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_details(wanted: DataFrame, base_url: str, path: str, parallel: int = 8, rest: float = 0.4, rate: float = 0.0, landing: str | None = None, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, failures, retired) of the pages `wanted` (url, scope, title), which
    are landed under `path`. They are read by `parallel` tasks; those that fail
    are read once more, one after another."""
    first = _land(crawl.detail_pages(wanted, slots=parallel, rate=rate, landing=landing, **how), f"{path}/raw_detail")
    jobs, failures, retired = extraction.outcomes(_land(extraction.classified_pages(first, base_url), f"{path}/details"))
    later = crawl.detail_pages(wanted.join(failures.select("url"), "url", "left_semi"), rest, 1, rate, landing and f"{landing}-again", **how)
    again = _land(extraction.classified_pages(_land(later, f"{path}/raw_detail_again"), base_url), f"{path}/details_again")
    more, failures, gone = extraction.outcomes(again)
    return jobs.unionByName(more), failures, retired.unionByName(gone)


def crawl_site(spark: SparkSession, base_url: str, path: str, scopes: tuple[str, ...] | None = None, parallel: int = 8, rest: float = 0.4, rate: float = 0.0, run: str | None = None, **how) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """(listings, states, (jobs, failures, retired)) of the site, whose pages are
    landed under `path`. All tasks together ask `rate` times a second at the most
    (0: each as often as `pause` lets it). Each page lies in a folder of this run
    as soon as it is read: tasks that are run again don't ask for it, nor does a
    crawl with the name of a run that didn't end."""
    spark.dataSource.register(crawl.ListingSource)
    landing = f"{path}/pages-{run or uuid.uuid4().hex}"
    options = {"base_url": base_url, "rate": str(rate), "landing": landing} | {k: str(v) for k, v in how.items()} | ({"scopes": ",".join(scopes)} if scopes else {})
    pages = _land(spark.read.format("listing_pages").options(**options).load(), f"{path}/raw_listing")
    listings, states = crawl_audit.scanned(pages, base_url)
    wanted = _land(tasks(listings), f"{path}/detail_tasks")
    return listings, states, read_details(wanted, base_url, path, parallel, rest, rate, landing, **how)
