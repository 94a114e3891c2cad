"""Pages to records: listing links and counters, detail fields, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.dates import with_french_datetimes
from ..functions.text import once, text
from ..sources import html as H

BASE_URL = "https://jobs.example"


def official_count(visible: Column) -> Column:
    """The last counter of results in the visible text; null if there is none."""
    hit = F.try_element_at(F.regexp_extract_all(visible, F.lit(f"(?iU){V.RESULTS}"), 1), F.lit(-1))
    return F.regexp_replace(hit, r"\D", "").try_cast("int")


def detail_links(links: Column, base_url: str = BASE_URL) -> Column:
    """struct(url, title) of each link to a detail page, in order."""
    absolute = r"^[A-Za-z][A-Za-z0-9+.-]*:"
    inside = lambda h: F.when(h.rlike(absolute), F.regexp_replace(F.regexp_replace(h, rf"{absolute}(//[^/?#]*)?", ""), r"[?#;].*$", "")).otherwise(F.regexp_replace(h, r"(?s)\?.*$", ""))
    found = F.transform(links, lambda x: F.struct(inside(x["href"]).alias("path"), x["text"].alias("title")))
    kept = F.filter(found, lambda x: x["path"].rlike(V.DETAIL_PATH))
    return F.transform(kept, lambda x: F.struct(F.concat(F.lit(base_url), x["path"]).alias("url"), x["title"].alias("title")))


def listing(raw: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """raw_listing with official, urls (distinct, first seen first) and titles
    (the last one given to a url)."""
    p = raw.withColumn("p", H.page(H.before("html", H.LAST_CHANCE)))
    p = p.withColumn("found", detail_links(F.col("p.links"), base_url)).withColumn("official", official_count(F.col("p.text")))
    urls = F.array_distinct(F.transform("found", lambda x: x["url"]))
    last = F.transform("urls", lambda u: F.struct(u.alias("url"), F.try_element_at(F.filter("found", lambda x: x["url"] == u), F.lit(-1))["title"].alias("title")))
    return p.withColumn("urls", urls).withColumn("titles", F.map_from_entries(last)).drop("p", "found")


def details(raw: DataFrame, *keep: str) -> DataFrame:
    """raw_detail (url, scope, title, html) as announcements, with `error`: the
    first rule that a page breaks, null for a valid one; and the columns `keep`."""
    d = raw.withColumn("p", H.detail(H.before("html", H.SIMILAR)))
    d = d.withColumns({c: F.col(f"p.{c}") for c in ("administration", "published", "until", "held")})
    d = with_french_datetimes(d, {"publication_at": ("published", False), "deadline_at": ("until", True), "contest_at": ("held", False)})
    path = F.try_parse_url("url", F.lit("PATH"))
    d = d.withColumns({"uuid": F.lower(F.regexp_extract(path, V.DETAIL_PATH, 1)), "positions": F.regexp_extract("p.positions", r"\d+", 0).try_cast("int")})
    d = d.withColumns({c: F.col(f"p.{c}") for c in ("specialties", "application_site", "job_name", "grade", "recruitment_type", "application_type", "contest_code")})
    error = (
        F.when(F.coalesce(F.col("uuid"), F.lit("")) == "", "not_a_detail_url")
        .when(F.col("publication_at_wrong") | F.col("deadline_at_wrong") | F.col("contest_at_wrong"), "invalid_calendar_date")
        .when(F.col("administration") == "", "missing_administration")
        .when(F.col("publication_at").isNull(), "missing_publication_date")
        .when(F.col("deadline_at").isNull(), "missing_deadline")
        .when(F.coalesce(F.col("positions"), F.lit(0)) == 0, "missing_positions")
        .when((F.size("specialties") == 0) & (F.col("job_name") == "") & (F.col("grade") == ""), "missing_classification_fields")
    )
    iso = lambda c: F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss")
    return d.select(
        "uuid", "url", "scope", text("title").alias("listing_title"), "administration", iso("publication_at").alias("publication_date"), iso("deadline_at").alias("deadline"),
        iso("contest_at").alias("contest_date"), "job_name", "grade", "specialties", "positions", "recruitment_type", "application_type", "application_site", "contest_code", once(error).alias("error"), *keep,
    )


def retired_target(url: Column, hops: Column, final_url: Column, base_url: str = BASE_URL) -> Column:
    """Where a detail page was retired to: the final url of a redirect on the
    same site from a detail page to the list; else null."""
    part = lambda u, what: F.try_parse_url(u, F.lit(what))
    site = F.regexp_extract(F.lit(base_url), "^[^:]+://([^/]*)", 1)
    first = F.try_element_at(hops, F.lit(1))
    ok = (
        (F.size(hops) > 0) & (part(url, "AUTHORITY") == site) & (part(final_url, "AUTHORITY") == site) & F.startswith(part(url, "PATH"), F.lit("/fr/concours/details/"))
        & (F.regexp_replace(part(final_url, "PATH"), "/+$", "") == V.LIST_PATH) & first["status"].isin(301, 302, 303, 307, 308)
        & (part(first["url"], "AUTHORITY") == part(url, "AUTHORITY")) & (part(first["url"], "PATH") == part(url, "PATH"))
    )
    return F.when(ok, final_url)


def first_scope(found: DataFrame, scopes: tuple[str, ...] = V.SCOPES) -> DataFrame:
    """Rows (scope, position, url, ..): each url once, in the first scope that
    has it, at its first position there."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, scopes)), F.col("scope")), F.lit(0))
    rank = F.when(rank == 0, len(scopes) + 1).otherwise(rank)
    row = F.struct("*")
    return found.groupBy("url").agg(F.min_by(row, F.struct(rank, "position")).alias("r")).select("r.*")


def classified_pages(raw: DataFrame, base_url: str = BASE_URL) -> DataFrame:
    """Landed detail pages, each parsed once: the columns of announcements with
    `outcome` (job, failed, retired) and `detail` (why it failed, where it was
    retired to; empty for a job). Pages that couldn't be read (with an `error`)
    have failed; what was retired isn't parsed."""
    r = raw if "error" in raw.columns else raw.withColumn("error", F.lit(None).cast("string"))
    r = r.withColumnRenamed("error", "unread").withColumn("target", once(retired_target(F.col("url"), F.col("hops"), F.col("final_url"), base_url)))
    r = r.withColumn("html", F.when(F.col("unread").isNull() & F.col("target").isNull(), F.col("html")))
    d = details(r, "unread", "target")
    outcome = F.when(F.col("unread").isNotNull(), "failed").when(F.col("target").isNotNull(), "retired").when(F.col("error").isNotNull(), "failed").otherwise("job")
    return d.withColumn("outcome", outcome).withColumn("detail", F.coalesce("unread", "target", "error", F.lit(""))).drop("unread", "target", "error")


def outcomes(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, failures, retired) of classified_pages(); land these before, else
    each of the three parses the pages."""
    of = lambda outcome, *cols: pages.filter(F.col("outcome") == outcome).select(*cols)
    jobs = pages.filter("outcome = 'job'").drop("outcome", "detail")
    return jobs, of("failed", "url", F.col("detail").alias("message")), of("retired", "url", F.col("detail").alias("target"))


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.coalesce("publication_date", F.lit("")).desc(), F.col("uuid").desc())


def numbered(found: DataFrame) -> DataFrame:
    """Links of listing pages in first-seen order: (scope, position, url, title).
    Links that only the final reading has come first, the last of them foremost;
    a url's title is the last one given."""
    rows = found.select("scope", "page", (F.col("snapshot") == "final").alias("late"), F.posexplode("urls").alias("at", "url"), "titles").withColumn("title", F.col("titles")[F.col("url")])
    place = F.struct("page", "at")
    urls = rows.groupBy("scope", "url").agg(
        F.min(F.when(~F.col("late"), place)).alias("seen"), F.min(F.when(F.col("late"), F.col("at"))).alias("late_at"), F.max_by("title", F.struct("late", "page", "at")).alias("title")
    )
    order = [F.col("seen").isNotNull(), F.when(F.col("seen").isNull(), -F.col("late_at")), F.col("seen.page"), F.col("seen.at")]
    return urls.withColumn("position", F.row_number().over(Window.partitionBy("scope").orderBy(*order))).select("scope", "position", "url", "title")
