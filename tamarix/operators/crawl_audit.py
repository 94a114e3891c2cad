"""Is the crawl complete? Attempts, scopes, and reconciliation of details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import freshness, local_time
from . import extraction


def scope_state(listings: DataFrame, errors: DataFrame | None = None, keys: tuple[str, ...] = ("scope",)) -> DataFrame:
    """One row a scope (or scan, by `keys`) of parsed listings (scope, page,
    snapshot first / body / final, official, urls): counters, distinct urls, and
    whether it is complete: the counter is stable, every url is there, and no
    page failed. errors: a row for each page that failed, with the keys."""
    u = listings.select("*", F.explode_outer("urls").alias("url"))
    s = u.groupBy(*keys).agg(
        F.max(F.when(F.col("snapshot") == "first", F.col("official"))).alias("official_before"), F.max(F.when(F.col("snapshot") == "final", F.col("official"))).alias("official_after"),
        F.count_distinct("url").alias("discovered"), F.count_distinct(F.when(F.col("snapshot") != "final", F.col("page"))).alias("pages_successful"),
    )
    s = s.withColumn("target_pages", F.greatest(F.lit(1), F.ceil(F.col("official_before") / V.PAGE_SIZE) + V.GUARD_PAGES))
    failed = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("errors")) if errors is not None else s.select(*keys, F.lit(0).cast("long").alias("errors"))
    s = s.join(failed, list(keys), "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    s = s.withColumn("pages_requested", F.col("pages_successful") + F.col("errors"))
    s = s.withColumn("stable_counter", F.coalesce(F.col("official_before") == F.col("official_after"), F.lit(False)))
    sane = F.col("official_before").between(0, V.MOST_OFFICIAL)
    return s.withColumn("complete", F.coalesce(F.col("stable_counter") & sane & (F.col("discovered") == F.col("official_after")) & (F.col("errors") == 0), F.lit(False)))


def scanned(pages: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """(parsed listings, states by scope) of landed listing pages with attempts
    and errors: of each scope its best attempt."""
    listings = extraction.listing(pages.filter("error is null"), base_url)
    states = scope_state(listings, pages.filter("error is not null"), ("scope", "attempt")).withColumn("found", F.col("discovered"))
    best = best_attempt(states).drop("found")
    return listings.join(best.select("scope", "attempt"), ["scope", "attempt"], "left_semi"), best


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of a scope's attempts (scope, attempt, complete, official_after,
    discovered, errors, found): the first complete one, else the one that found the most."""
    ratio = F.col("discovered") / F.greatest("official_after", F.lit(1))
    zero = F.lit(0.0)
    key = F.struct(
        "complete", F.when(F.col("complete"), zero).otherwise(ratio).alias("ratio"), F.when(F.col("complete"), zero).otherwise(-F.col("errors")).alias("e"),
        F.when(F.col("complete"), zero).otherwise(F.col("found")).alias("f"), (-F.col("attempt")).alias("first"),
    )
    return attempts.groupBy("scope").agg(F.max_by(F.struct("*"), key).alias("r")).select("r.*")


def scope_audit(states: DataFrame) -> DataFrame:
    off, disc = F.col("official_after"), F.col("discovered")
    return states.withColumns(
        {"missing_count": F.greatest(off - disc, F.lit(0)), "extra_count": F.greatest(disc - off, F.lit(0)), "listing_coverage_pct": F.when(off == 0, 100.0).otherwise(F.bround(disc / off * 100, 2))}
    )


def detail_gate(expected: DataFrame, parsed: DataFrame, retired: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: counts of each kind of url and whether the details are complete.
    All four have a column `url`; it takes one grouping by url."""
    mark = lambda df, c: df.select("url", F.lit(c).alias("kind"))
    every = mark(expected, "expected").unionByName(mark(parsed, "parsed")).unionByName(mark(retired, "retired")).unionByName(mark(failures, "failed"))
    kinds = every.groupBy("url").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("expected", "parsed", "retired", "failed")])
    resolvable = F.col("expected") & ~F.col("retired")
    row = kinds.agg(
        F.count_if("expected").alias("expected_urls"), F.count_if(resolvable).alias("resolvable_urls"), F.count_if("parsed").alias("parsed_urls"), F.count_if(F.col("retired")).alias("retired_urls"),
        F.count_if(F.col("retired") & ~F.col("expected")).alias("invalid_retired_urls"), F.count_if(resolvable & ~F.col("parsed")).alias("missing_urls"),
        F.count_if(F.col("parsed") & ~resolvable).alias("unexpected_urls"), F.count_if("failed").alias("failed_urls"),
    )
    return row.withColumn("detail_gate", F.col("invalid_retired_urls") + F.col("missing_urls") + F.col("unexpected_urls") + F.col("failed_urls") == 0)


def missing_urls(expected: DataFrame, parsed: DataFrame, retired: DataFrame) -> DataFrame:
    return expected.select("url").distinct().join(retired, "url", "left_anti").join(parsed, "url", "left_anti")


def decisions(jobs: DataFrame, now: Column) -> DataFrame:
    """jobs with `decision`: accepted, or why not."""
    return jobs.withColumn("decision", freshness("publication_date", "deadline", now))


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def published_today(jobs: DataFrame, now: Column) -> DataFrame:
    today = F.to_date(local_time("publication_date")) == F.to_date(now)
    return jobs.agg(F.count_if(today).alias("today_jobs"), F.coalesce(F.sum(F.when(today, F.coalesce("positions", F.lit(0)))), F.lit(0)).cast("long").alias("today_positions"))


def audit_row(states: DataFrame, gate: DataFrame, decided: DataFrame, now: Column, robots_allowed: bool = True) -> DataFrame:
    """The audit: one row of one-row aggregates."""
    scopes = states.agg(F.coalesce(F.bool_and("complete"), F.lit(True)).alias("listing_gate"), F.coalesce(F.sum("official_after"), F.lit(0)).alias("official_total"), F.coalesce(F.sum("discovered"), F.lit(0)).alias("discovered_total"))
    kept = decided.agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("decision") == "accepted").alias("accepted"), F.count_if(F.col("decision") != "accepted").alias("rejected"))
    row = scopes.crossJoin(gate).crossJoin(kept).crossJoin(published_today(decided, now))  # one row each
    return row.withColumn("robots_allowed", F.lit(robots_allowed)).withColumn("gate", F.col("robots_allowed") & F.col("listing_gate") & F.col("detail_gate"))
