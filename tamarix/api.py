"""The library's objects for one announcement or one query at a time: the same
plans as for tables, over rows at hand."""

from __future__ import annotations

from datetime import datetime
from typing import Any
from urllib import error
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions import fixed_values as V
from .functions import text as words
from .operators import crawl_audit, extraction, policy, quality, search, suggest
from .operators import taxonomy as tax
from .plans import audit as audit_plan
from .plans import index as index_plan
from .sources import crawl, files
from .sources.schemas import JOB

ZONE = ZoneInfo("Africa/Casablanca")


def local_now(now: datetime | None = None):
    """Local time without zone, as a literal."""
    n = (now or datetime.now(ZONE)).replace(tzinfo=None)
    return F.lit(n.isoformat(sep=" ")).cast("timestamp_ntz")


def rows_of(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def job_frame(spark: SparkSession, jobs: list[dict]) -> DataFrame:
    """Announcements given as dicts; missing keys are null."""
    rows = []
    for i, j in enumerate(jobs):
        row = {f.name: j.get(f.name) for f in JOB.fields}
        row["uuid"] = str(row["uuid"] or i)
        row["specialties"] = [str(x) for x in (row["specialties"] or []) if x]
        rows.append(tuple(row[f.name] for f in JOB.fields))
    return spark.createDataFrame(rows, JOB)


class Taxonomy:
    """A directory with the market's professions, the national nomenclature and,
    optionally, the conjunctive rules (without that file there are none)."""

    def __init__(self, spark: SparkSession, directory: str, rules=None):
        self.spark = spark
        market = files.read_market(spark, f"{directory}/{V.MARKET_FILE}")
        official = files.read_official(spark, f"{directory}/{V.OFFICIAL_FILE}")
        self.professions = market.unionByName(official).cache()
        self.rules = files.read_rules(spark, f"{directory}/{V.RULES_FILE}") if rules is None else rules

    def _asked(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(query,)], "query string")

    def profession(self, profession_id: str) -> dict | None:
        found = rows_of(tax.profession(self.professions, self._asked(profession_id).withColumnRenamed("query", "id")))
        return found[0] if found else None

    def diploma_professions(self, diploma: str) -> list[dict]:
        return rows_of(tax.by_diploma(self.professions, self._asked(diploma)).orderBy("sector", "label").drop("query"))

    def autocomplete(self, query: str, limit: int = 10) -> list[dict]:
        return rows_of(suggest.suggest(self._asked(query), self.professions, limit).orderBy("rank").drop("query", "rank"))

    def exact_profession_ids(self, query: str) -> list[str]:
        found = tax.exact_ids(self.professions, self._asked(query)).collect()
        return list(found[0]["ids"]) if found else []

    def resolve(self, query: str) -> tuple[str | None, list[dict]]:
        found = suggest.resolve(self._asked(query), self.professions).first()["profession_id"]
        return (found, []) if found else (None, self.autocomplete(query, 8))

    def classify_jobs(self, jobs: list[dict], max_matches: int = 8) -> list[list[dict]]:
        found = policy.classify_jobs(job_frame(self.spark, [j | {"uuid": str(i)} for i, j in enumerate(jobs)]), self.professions, self.rules, max_matches)
        by = {int(r["uuid"]): [m.asDict(recursive=True) for m in r["profession_matches"]] for r in found.select("uuid", "profession_matches").collect()}
        return [by[i] for i in range(len(jobs))]

    def classify_job(self, job: dict, max_matches: int = 8) -> list[dict]:
        return self.classify_jobs([job], max_matches)[0]

    def related_job_matches(self, job: dict, exclude_ids=(), max_matches: int = 8) -> list[dict]:
        one = job_frame(self.spark, [job])
        none = F.array().cast(policy.classify_jobs(one, self.professions, self.rules).schema["profession_matches"].dataType)
        found = policy.related_hints(one.withColumn("profession_matches", none), self.professions, 10_000).first()["related_profession_matches"]
        return [m.asDict(recursive=True) for m in found if m["profession_id"] not in set(exclude_ids)][:max_matches]

    def autocomplete_payload(self) -> dict:
        counts = tax.export_counts(self.professions).first().asDict()
        return counts | {"professions": rows_of(tax.autocomplete_export(self.professions))}

    def build_index(self, jobs: DataFrame) -> DataFrame:
        return index_plan.build_index(jobs, self.professions, self.rules)


def normalize(value: str | None) -> str:
    """One string, as norm() has columns of them."""
    return words.norm_text(value)


def tokens(value: str | None) -> list[str]:
    return words.token_list(value)


def parse_french_datetime(spark: SparkSession, value: str, *, end_of_day_if_no_time: bool = False) -> datetime | None:
    """The first date in a text, None without one; a ValueError for a day or a time
    that the calendar doesn't have."""
    at, wrong = spark.createDataFrame([(value,)], "v string").select(dates.french_datetime("v", end_of_day_if_no_time), dates.french_date_is_wrong("v")).first()
    if wrong:
        raise ValueError(f"no such date: {value}")
    return at


def robots_allows(base_url: str, agent: str = "*", **how) -> tuple[bool, str]:
    """Whether the site lets its list and its details be read, and why."""
    try:
        return crawl.robots_allow(crawl.fetch(f"{base_url}/robots.txt", timeout=20, **how).text, base_url, agent)
    except error.HTTPError as e:
        return crawl.robots_allow(None, base_url, status=e.code) if e.code == 404 else (False, f"robots check failed: {e}")
    except OSError as e:
        return False, f"robots check failed: {e}"


def crawl_scope(spark: SparkSession, base_url: str, scope: str, **options) -> dict[str, Any]:
    """A scope's better scan: its state, with discovered_urls in order, titles and
    errors (what failed, by page)."""
    spark.dataSource.register(crawl.ListingSource)
    options = {"base_url": base_url, "scopes": scope} | {k: str(v) for k, v in options.items()}
    path = files.work_path(spark, "listing")
    spark.read.format("listing_pages").options(**options).load().write.parquet(path)
    pages = spark.read.parquet(path)
    listings, states = crawl_audit.scanned(pages, base_url)
    found = rows_of(extraction.numbered(listings).orderBy("position"))
    state = states.first().asDict()
    failed = pages.filter((F.col("attempt") == state["attempt"]) & F.col("error").isNotNull()).orderBy("page")
    return state | {
        "discovered_urls": [r["url"] for r in found], "titles": {r["url"]: r["title"] for r in found}, "listing_complete": state["complete"], "errors": [f"page={r['page']}: {r['error']}" for r in failed.collect()],
    }


def crawl_details(spark: SparkSession, scope_results: list[dict], base_url: str, parallel: int = 8, rest: float = 0.4, **how) -> dict[str, Any]:
    """The details of scopes' urls, each read once, for the first scope that has
    it: jobs, newest first, failures by url and retired_redirects by url. What
    fails is read once more."""
    tasks, seen = [], set()
    for r in scope_results:
        for url in r["discovered_urls"]:
            if url not in seen:
                seen.add(url)
                tasks.append((url, r["scope"], r["titles"].get(url, "")))
    path = files.work_path(spark, "details")
    wanted = spark.createDataFrame(tasks, "url string, scope string, title string")
    jobs, failures, retired = audit_plan.read_details(wanted, base_url, path, parallel, rest, **how)
    return {"jobs": rows_of(extraction.newest_first(jobs)), "failures": {r["url"]: r["message"] for r in failures.collect()}, "retired_redirects": {r["url"]: r["target"] for r in retired.collect()}}


def search_by_profession(index: DataFrame, profession_id: str, limit: int = 20, now: datetime | None = None) -> list[dict]:
    return rows_of(search.search(index, profession_id, local_now(now), limit))


def rank_job(index: DataFrame, profession_id: str, now: datetime | None = None) -> DataFrame:
    """index with the score of its first match with the profession, -1 if none."""
    m = F.get(F.filter("profession_matches", lambda x: x["profession_id"] == profession_id), 0)
    return index.withColumn("score", search.rank(m, "publication_date", "deadline", local_now(now)))


def _one_page(spark: SparkSession, html: str) -> DataFrame:
    return extraction.listing(spark.createDataFrame([("", 1, "body", html)], crawl.RAW_LISTING))


def parse_official_count(spark: SparkSession, html: str) -> int:
    n = _one_page(spark, html).first()["official"]
    if n is None:
        raise ValueError("the page has no counter of results")
    return n


def extract_listing_links(spark: SparkSession, html: str) -> list[str]:
    return list(_one_page(spark, html).first()["urls"])


def extract_listing_titles(spark: SparkSession, html: str) -> dict[str, str]:
    return dict(_one_page(spark, html).first()["titles"])


def parse_detail(spark: SparkSession, html: str, url: str, scope: str, title: str = "") -> dict:
    raw = spark.createDataFrame([(url, scope, title, html)], "url string, scope string, title string, html string")
    job = extraction.details(raw).first().asDict(recursive=True)
    if job["error"]:
        raise ValueError(job["error"])
    return {k: v for k, v in job.items() if k != "error"}


def is_fresh_and_open(spark: SparkSession, job: dict, now: datetime | None = None) -> tuple[bool, str]:
    reason = crawl_audit.decisions(job_frame(spark, [job]), local_now(now)).first()["decision"]
    return reason == "accepted", reason


def structural_ambiguity_reasons(spark: SparkSession, job: dict) -> list[str]:
    return list(job_frame(spark, [job]).select(quality.ambiguity_reasons().alias("r")).first()["r"])


def evaluate_classifiable_coverage(index: DataFrame, minimum_coverage_pct: float) -> dict:
    row = quality.coverage(index, minimum_coverage_pct).first().asDict()
    names = ("structurally_ambiguous_rows", "unexplained_unclassified_rows", "ambiguous_classified_rows")
    return row | {n: rows_of(d) for n, d in zip(names, quality.coverage_rows(index), strict=True)}


def run_golden_audit(taxonomy: Taxonomy, cases=V.GOLDEN_CASES) -> dict:
    """cases: name, job, must_include, must_exclude and, optionally, allowed_ids."""
    found = taxonomy.classify_jobs([c["job"] for c in cases])
    rows = [(c["name"], [m["profession_id"] for m in ms], c["must_include"], c["must_exclude"], c.get("allowed_ids") or [], [m["confidence"] for m in ms]) for c, ms in zip(cases, found, strict=True)]
    kinds = "name string, actual array<string>, must_include array<string>, must_exclude array<string>, allowed_ids array<string>, confidences array<string>"
    done = rows_of(quality.golden_audit(taxonomy.spark.createDataFrame(rows, kinds)))
    passed = sum(r["pass"] for r in done)
    return {"cases": done, "passed": passed, "failed": len(done) - passed, "precision_pct": round(passed / len(done) * 100, 2) if done else 100.0}


def run_suggestion_audit(taxonomy: Taxonomy, cases=V.SUGGESTION_CASES, required=V.SUGGESTION_REQUIRED, order=V.SUGGESTION_ORDER, limit: int = 50) -> dict:
    """What suggestions must begin with, must not have, must have, and which of
    them must come before another."""
    spark = taxonomy.spark
    kinds = "query string, top string, forbidden array<string>, label_prefix string, label_part string, required array<string>, first array<string>, then string"
    rows = [(c["query"], c.get("top"), c.get("forbidden"), c.get("top_label_prefix"), c.get("top_label_contains"), None, None, None) for c in cases]
    rows += [(q, None, None, None, None, list(ids), None, None) for q, ids in required] + [(q, None, None, None, None, None, list(ids), then) for q, ids, then in order]
    expected = spark.createDataFrame(rows, kinds)
    found = suggest.suggest(expected.select("query"), taxonomy.professions, limit)
    done = rows_of(quality.suggestion_audit(found, expected).select("query", "first_id", "first_label", "got", "pass"))
    return {"cases": done, "failures": sum(not r["pass"] for r in done)}


def audit_index(index: DataFrame) -> dict:
    count, first = quality.index_safety(index)
    return {"unsafe_matches": count.first()["unsafe_matches"], "rows": rows_of(first)}


