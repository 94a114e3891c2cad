"""The registered queries over the reference operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import demo as D
from .functions import dates, text
from .functions import fixed_values as V
from .operators import crawl_audit, extraction, matching, policy, quality, search, suggest
from .operators import taxonomy as tax
from .plans import index as index_plan
from .sources import files, index_store
from .sources import html as H
from .sources.files import MARKET

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- text ---------------------------------------------------------------------


@query(f"SELECT doc_id, {D.norm_sql('text')} AS normalised FROM documents")
def text_normalize(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", text.norm("text").alias("normalised"))


@query(rf"SELECT doc_id, trim(regexp_replace(replace({D.fold_sql('text')}, '’', ''''), '\s+', ' ', 'g')) AS normalised FROM documents")
def classif_normalize(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", text.classifiability_norm("text").alias("normalised"))


@query(rf"SELECT doc_id, trim(regexp_replace({D.fold_sql('text')}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS normalised FROM documents")
def audit_normalize(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", text.audit_norm("text").alias("normalised"))


@query(f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, array_to_string(t[1:5], ' ') AS first_tokens
FROM (SELECT doc_id, {D.tokens_sql(D.norm_sql('text'))} AS t FROM documents)""")
def token_stats(spark, sf):
    t = D.table(spark, sf, "documents").withColumn("t", text.tokens(text.norm("text")))
    return t.select("doc_id", long(F.size("t")).alias("n_tokens"), long(F.size(F.array_distinct("t"))).alias("n_distinct"), F.array_join(F.slice("t", 1, 5), " ").alias("first_tokens"))


PHRASES = ("the and", "de la", "über", "Être ", "on the", "c++", "")


@query(f"""SELECT doc_id, p AS phrase FROM (SELECT doc_id, {D.norm_sql('text')} AS n FROM documents), (VALUES {', '.join(f"({D._q(p)}, {D._q(text.norm_text(p))})" for p in PHRASES)}) AS q(p, np)
WHERE {D.phrase_sql('n', 'np')}""")
def phrase_contains(spark, sf):
    d = D.table(spark, sf, "documents").withColumn("n", text.norm("text"))
    hits = F.array_compact(F.array(*[F.when(text.has_phrase(F.col("n"), text.norm_text(p)), F.lit(p)) for p in PHRASES]))
    return d.select("doc_id", F.explode(hits).alias("phrase"))


@query(f"WITH {D.JOBS_SQL} SELECT uuid, {D.role_sql('listing_title')} AS role FROM jobs")
def listing_role(spark, sf):
    return text.with_listing_role(D.jobs(spark, sf), "listing_title", "role").select("uuid", "role")


@query(f"WITH {D.JOBS_SQL}, {D.EVIDENCE_SQL} SELECT uuid, field_ord, field, value, weight, norm_value FROM evidence")
def evidence_explode(spark, sf):
    return matching.evidence(D.jobs(spark, sf)).select("uuid", "field_ord", "field", "value", "weight", "norm_value")


TITLE_SQL = "coalesce(nullif(job_name, ''), nullif(array_to_string(list_filter(specialties, lambda x: x <> '')[1:3], ' / '), ''), nullif(grade, ''), nullif(listing_title, ''), 'Offre')"


@query(f"WITH {D.JOBS_SQL} SELECT uuid, {TITLE_SQL} AS title FROM jobs")
def display_title(spark, sf):
    return D.jobs(spark, sf).select("uuid", search.display_title().alias("title"))


# --- dates --------------------------------------------------------------------

_FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "décembre"]
_FR_SQL = f"o_orderkey AS k, '  Le ' || day(o_orderdate) || '  ' || ({D._list(_FRENCH)})[month(o_orderdate)] || ' ' || year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN ' - ' || (o_orderkey % 24) || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') WHEN o_orderkey % 3 = 1 THEN ' (fin)' ELSE '' END AS t"


def french_texts(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    month = F.element_at(F.array(*map(F.lit, _FRENCH)), F.month(d))
    tail = F.when(k % 3 == 0, F.concat(F.lit(" - "), (k % 24).cast("string"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 3 == 1, " (fin)").otherwise("")
    return D.table(spark, sf, "orders").select(k.alias("k"), d.alias("d"), F.concat(F.lit("  Le "), F.day(d).cast("string"), F.lit("  "), month, F.lit(" "), F.year(d).cast("string"), tail).alias("t"))


@query(rf"""WITH o AS (SELECT {_FR_SQL} FROM orders), m AS (SELECT k, regexp_extract(t, '(\d{{1,2}})\s+([A-Za-zÀ-ÿ]+)\s+(\d{{4}})(?:\s*-\s*(\d{{1,2}}):(\d{{2}}))?', ['d', 'm', 'y', 'h', 'i']) AS g FROM o)
SELECT k, make_timestamp(g.y::BIGINT, list_position({D._list(_FRENCH)}, g.m)::BIGINT, g.d::BIGINT, CASE WHEN g.h = '' THEN 0 ELSE try_cast(g.h AS BIGINT) END, CASE WHEN g.h = '' THEN 0 ELSE try_cast(g.i AS BIGINT) END, 0.0)::VARCHAR AS start_of_day,
       make_timestamp(g.y::BIGINT, list_position({D._list(_FRENCH)}, g.m)::BIGINT, g.d::BIGINT, CASE WHEN g.h = '' THEN 23 ELSE try_cast(g.h AS BIGINT) END, CASE WHEN g.h = '' THEN 59 ELSE try_cast(g.i AS BIGINT) END, 0.0)::VARCHAR AS end_of_day FROM m""")
def french_datetime(spark, sf):
    t = french_texts(spark, sf)
    return t.select("k", F.date_format(dates.french_datetime("t"), "yyyy-MM-dd HH:mm:ss").alias("start_of_day"), F.date_format(dates.french_datetime("t", True), "yyyy-MM-dd HH:mm:ss").alias("end_of_day"))


DATED_SQL = f"dated AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS publication_date, strftime(o_orderdate + (o_orderkey % 40) * INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%S') AS deadline, (o_orderkey % 7)::INT AS positions, TIMESTAMP '{D.NOW}' AS now FROM orders)"


def dated(spark, sf):
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    o, k = D.table(spark, sf, "orders"), F.col("o_orderkey")
    return o.select(k.alias("k"), F.date_format("o_orderdate", iso).alias("publication_date"), F.date_format(F.expr("o_orderdate + make_dt_interval(cast(o_orderkey % 40 as int))"), iso).alias("deadline"), (k % 7).cast("int").alias("positions"))


@query(f"WITH {DATED_SQL} SELECT k, greatest(date_diff('day', publication_date::TIMESTAMP, now), 0)::BIGINT AS age, greatest(date_diff('day', now, deadline::TIMESTAMP), 0)::BIGINT AS days_left FROM dated")
def day_diffs(spark, sf):
    return dated(spark, sf).select("k", long(dates.days_since("publication_date", D.now())).alias("age"), long(dates.days_until("deadline", D.now())).alias("days_left"))


FRESH_SQL = "CASE WHEN date_diff('day', publication_date::TIMESTAMP, now) < 0 THEN 'publication_in_future' WHEN date_diff('day', publication_date::TIMESTAMP, now) > 15 THEN 'older_than_15_days' WHEN deadline::TIMESTAMP < now THEN 'deadline_expired' ELSE 'accepted' END"


@query(f"WITH {DATED_SQL} SELECT k, {FRESH_SQL} AS decision FROM dated")
def fresh_open(spark, sf):
    return crawl_audit.decisions(dated(spark, sf), D.now()).select("k", "decision")


@query(f"WITH {DATED_SQL} SELECT {FRESH_SQL} AS decision, count(*) AS n FROM dated GROUP BY 1")
def decision_counts(spark, sf):
    return crawl_audit.decision_counts(crawl_audit.decisions(dated(spark, sf), D.now()))


@query(f"WITH {DATED_SQL} SELECT count(*) FILTER (publication_date::DATE = now::DATE) AS today_jobs, coalesce(sum(positions) FILTER (publication_date::DATE = now::DATE), 0)::BIGINT AS today_positions FROM dated")
def published_today(spark, sf):
    return crawl_audit.published_today(dated(spark, sf), D.now())


# --- pages --------------------------------------------------------------------

_HREF = r"""regexp_replace(regexp_extract(a, 'href="([^"]*)"', 1), '&amp;', '&', 'g')"""


@query(f"SELECT page_id, (i - 1)::BIGINT AS pos, {_HREF} AS href FROM (SELECT page_id, as_[i] AS a, i FROM (SELECT page_id, as_, unnest(range(1, len(as_) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*>') AS as_ FROM pages)))")
def page_links(spark, sf):
    return H.links(D.table(spark, sf, "pages"), "page_id").select("page_id", long("pos").alias("pos"), "href")


@query("SELECT page_id, (length(html) - length(replace(html, '<li', '')))::BIGINT // 3 AS n_items, (length(html) - length(replace(html, '<p>', '')))::BIGINT // 3 AS n_paragraphs FROM pages")
def page_blocks(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", H.page("html").alias("p"))
    return p.select("page_id", long(F.size("p.items")).alias("n_items"), long(F.size(F.filter("p.blocks", lambda b: b["tag"] == "p"))).alias("n_paragraphs"))


def _uuid_sql(k: str) -> str:
    h = f"md5({k}::VARCHAR)"
    return f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"


def _uuid(k: Column) -> Column:
    h = F.md5(k.cast("string"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def listing_pages(spark, sf):
    """Synthetic listing pages: a nation is a page of its region's listing."""
    k = F.col("n_nationkey")
    link = lambda key, title, tail="": F.concat(F.lit('<a class="card" href="/fr/concours/details/'), _uuid(key), F.lit(tail + '"><b>'), title, F.lit("</b>\n offre</a>"))
    html = F.concat(
        F.lit("<html><body><div>1 "), (k % 4).cast("string"), F.lit(" 0.2 Résultats</div>"), link(k, F.col("n_name")), link(k % 5, F.lit("ancien")), link(k, F.concat(F.lit("à "), "n_name"), "?x=1&amp;y=2"),
        F.lit('<a href="/fr/autre">non</a><h2>Dernière   CHANCE pour postuler</h2>'), link(k + 1000, F.lit("hors")), F.lit("</body></html>"),
    )
    return D.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("scope"), k.cast("int").alias("page"), F.lit("body").alias("snapshot"), html.alias("html"))


@query("SELECT n_nationkey::BIGINT AS page, ('1' || (n_nationkey % 4) || '02')::BIGINT AS official FROM nation")
def official_counter(spark, sf):
    found = extraction.listing(listing_pages(spark, sf))
    return found.select(long("page").alias("page"), long("official").alias("official"))


@query(f"""SELECT n_nationkey::BIGINT AS page, 'https://jobs.example/fr/concours/details/' || u AS url, CASE WHEN u = {_uuid_sql('n_nationkey')} THEN 'à ' || n_name ELSE 'ancien' END || ' offre' AS title
FROM (SELECT DISTINCT n_nationkey, n_name, unnest([{_uuid_sql('n_nationkey')}, {_uuid_sql('(n_nationkey % 5)')}]) AS u FROM nation)""")
def page_link_titles(spark, sf):
    found = extraction.listing(listing_pages(spark, sf)).select("page", F.explode("titles").alias("url", "title"))
    return found.select(long("page").alias("page"), "url", "title")


@query(f"""WITH l AS (SELECT n_regionkey::VARCHAR AS scope, n_nationkey AS page, pos, CASE pos WHEN 0 THEN {_uuid_sql('n_nationkey')} ELSE {_uuid_sql('(n_nationkey % 5)')} END AS u FROM nation, (VALUES (0), (1)) AS v(pos)),
n AS (SELECT scope, 'https://jobs.example/fr/concours/details/' || u AS url, row_number() OVER (PARTITION BY scope ORDER BY page, pos) AS position FROM (SELECT *, row_number() OVER (PARTITION BY scope, u ORDER BY page, pos) AS rn FROM l) WHERE rn = 1)
SELECT scope, position::BIGINT AS position, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY scope, position) AS rn FROM n) WHERE rn = 1""")
def link_dedup_scope(spark, sf):
    found = extraction.numbered(extraction.listing(listing_pages(spark, sf)))
    return extraction.first_scope(found, ("0", "1", "2", "3", "4")).select("scope", long("position").alias("position"), "url")


@query("SELECT page_id, string_split_regex(html, '(?i)</NAV>')[1] AS head FROM pages")
def boundary_truncate(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", H.before("html", "</NAV>").alias("head"))


def detail_pages(spark, sf):
    """A detail page for each order, some broken; dealt out while rows are narrow,
    as landed pages would be."""
    k, t = F.col("k"), french_texts(spark, sf).repartition(spark.sparkContext.defaultParallelism)
    until = F.when(k % 11 == 0, "31 février 2001").otherwise(F.col("t"))
    head = lambda label, value: F.concat(F.lit(f"<h3>{label} "), value, F.lit("</h3>"))
    html = F.concat(
        F.lit("<html><body><section>"), F.when(k % 7 == 0, "").otherwise(head("Administration qui recrute", F.concat(F.lit("Office  "), (k % 9).cast("string")))), head("Date de publication", F.col("t")),
        head("Délai de dépôt des candidatures", until), F.lit("<ul><li>Spécialité :<br>- Génie civil - Informatique<br/>Génie civil</li><li>Grade : Technicien "), (k % 4).cast("string"), F.lit("</li><li>Nombre de postes : "),
        F.when(k % 13 == 0, "aucun").otherwise((k % 8).cast("string")), F.lit(" postes</li><li>Note sans valeur</li><li>Nom du poste : Agent</li><li>Nom du poste : <b>Chef "), (k % 3).cast("string"),
        F.lit("</b></li></ul><p>Site de dépôt : <a href='https://depot.example/x'>ici</a></p></section><h2>Concours  similaires</h2><h3>Date du concours 3 mars 2002</h3></body></html>"),
    )
    return t.select(F.concat(F.lit("https://jobs.example/fr/concours/details/"), _uuid(k)).alias("url"), F.lit("collec").alias("scope"), F.lit("titre").alias("title"), html.alias("html"), "k", "d")


DETAIL_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate AS d FROM orders), e AS (SELECT k, 'https://jobs.example/fr/concours/details/' || {_uuid_sql('k')} AS url, d + CASE WHEN k % 3 = 0 THEN (k % 24) * INTERVAL 1 HOUR + (k % 60) * INTERVAL 1 MINUTE ELSE INTERVAL 0 HOUR END AS pub,
    d + CASE WHEN k % 3 = 0 THEN (k % 24) * INTERVAL 1 HOUR + (k % 60) * INTERVAL 1 MINUTE ELSE INTERVAL 23 HOUR + INTERVAL 59 MINUTE END AS dead,
    CASE WHEN k % 11 = 0 THEN 'invalid_calendar_date' WHEN k % 7 = 0 THEN 'missing_administration' WHEN k % 13 = 0 OR k % 8 = 0 THEN 'missing_positions' END AS error FROM o)"""


@query(f"{DETAIL_SQL} SELECT url, strftime(pub, '%Y-%m-%dT%H:%M:%S') AS publication_date, strftime(dead, '%Y-%m-%dT%H:%M:%S') AS deadline, 'Office ' || (k % 9) AS administration, 'Génie civil|Informatique' AS specialties, 'Technicien ' || (k % 4) AS grade, 'Chef ' || (k % 3) AS job_name, (k % 8)::BIGINT AS positions, 'https://depot.example/x' AS application_site FROM e WHERE error IS NULL")
def detail_fields(spark, sf):
    d = extraction.details(detail_pages(spark, sf)).filter("error is null")
    return d.select("url", "publication_date", "deadline", "administration", F.array_join("specialties", "|").alias("specialties"), "grade", "job_name", long("positions").alias("positions"), "application_site")


@query(f"{DETAIL_SQL} SELECT url, error FROM e WHERE error IS NOT NULL")
def detail_validate(spark, sf):
    return extraction.details(detail_pages(spark, sf)).filter("error is not null").select("url", "error")


_SITE = "https://jobs.example"


def fetched(spark, sf):
    k = F.col("o_orderkey")
    url = F.concat(F.lit(_SITE + "/fr/concours/details/"), _uuid(k))
    final = F.when(k % 3 == 0, f"{_SITE}/fr/concours-liste/").when(k % 3 == 1, f"{_SITE}/fr/concours-liste?x=1").otherwise("https://other.example/fr/concours-liste")
    hop = F.struct(F.when(k % 5 == 0, 200).otherwise(302).alias("status"), F.when(k % 7 == 0, F.lit(_SITE)).otherwise(url).alias("url"))
    hops = F.when(k % 4 == 0, F.array().cast("array<struct<status:int,url:string>>")).otherwise(F.array(hop))
    return D.table(spark, sf, "orders").select(k.alias("k"), url.alias("url"), final.alias("final_url"), hops.alias("hops"))


@query(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN '{_SITE}/fr/concours-liste/' ELSE '{_SITE}/fr/concours-liste?x=1' END END AS target FROM orders")
def redirect_class(spark, sf):
    return fetched(spark, sf).select("k", extraction.retired_target(F.col("url"), F.col("hops"), F.col("final_url"), _SITE).alias("target"))


def outcome_pages(spark, sf):
    """detail_pages as they are landed: some weren't read, some were retired."""
    k, none = F.col("k"), F.array().cast("array<struct<status:int,url:string>>")
    gone, away = k % 17 == 3, k % 19 == 5
    hop = F.array(F.struct(F.lit(302).alias("status"), F.col("url").alias("url")))
    return detail_pages(spark, sf).select(
        "url", "scope", "title", F.when(~gone, 200).alias("status"), F.when(away, hop).otherwise(none).alias("hops"), F.when(away, f"{_SITE}/fr/concours-liste").otherwise(F.col("url")).alias("final_url"),
        F.when(~gone, F.col("html")).alias("html"), F.when(gone, "TimeoutError: timed out").alias("error"),
    )


@query(f"""{DETAIL_SQL} SELECT url, CASE WHEN k % 17 = 3 THEN 'failed' WHEN k % 19 = 5 THEN 'retired' WHEN error IS NULL THEN 'job' ELSE 'failed' END AS outcome,
    CASE WHEN k % 17 = 3 THEN 'TimeoutError: timed out' WHEN k % 19 = 5 THEN '{_SITE}/fr/concours-liste' ELSE coalesce(error, '') END AS detail FROM e""")
def detail_outcomes(spark, sf):
    return extraction.classified_pages(outcome_pages(spark, sf), _SITE).select("url", "outcome", "detail")


# --- crawl reconciliation -----------------------------------------------------


def attempts(spark, sf):
    c = D.table(spark, sf, "customer")
    a = c.groupBy(F.col("c_nationkey").cast("string").alias("scope"), F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("c_acctbal") < 0).alias("errors"), F.min("c_custkey").alias("attempt"))
    return a.withColumn("official_after", F.col("discovered") + F.col("attempt") % 3).withColumn("found", F.col("discovered") + F.col("errors")).withColumn("complete", (F.col("attempt") % 3 == 0) & (F.col("errors") == 0))


@query("""WITH a AS (SELECT c_nationkey::VARCHAR AS scope, c_mktsegment, count(*) AS discovered, count(*) FILTER (c_acctbal < 0) AS errors, min(c_custkey) AS attempt FROM customer GROUP BY ALL),
b AS (SELECT *, discovered + attempt % 3 AS official, attempt % 3 = 0 AND errors = 0 AS complete FROM a)
SELECT scope, attempt, discovered, errors FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY complete DESC, CASE WHEN complete THEN 0 ELSE discovered / greatest(official, 1) END DESC, CASE WHEN complete THEN 0 ELSE errors END, CASE WHEN complete THEN 0 ELSE discovered + errors END DESC, attempt) AS rn FROM b) WHERE rn = 1""")
def best_attempt(spark, sf):
    return crawl_audit.best_attempt(attempts(spark, sf)).select("scope", "attempt", "discovered", "errors")


def crawled(spark, sf):
    """Listings: a nation is a scope, each 40 customers a page of urls."""
    c = D.table(spark, sf, "customer").withColumn("page", (F.col("c_custkey") / 40).cast("int"))
    scope = F.col("c_nationkey").cast("string").alias("scope")
    body = c.groupBy(scope, "page").agg(F.collect_list(F.concat(F.lit("u"), (F.col("c_custkey") - F.col("c_custkey") % 2 * F.when(F.col("c_nationkey") < 5, 1).otherwise(0)).cast("string"))).alias("urls"))
    n = c.groupBy(scope).agg(F.count(F.lit(1)).cast("int").alias("official"))
    body = body.join(n, "scope").select("scope", "page", F.lit("body").alias("snapshot"), "official", "urls")
    edge = lambda s, plus: n.select("scope", F.lit(1).alias("page"), F.lit(s).alias("snapshot"), (F.col("official") + plus).alias("official"), F.array().cast("array<string>").alias("urls"))
    return body.unionByName(edge("first", F.lit(0))).unionByName(edge("final", F.when(F.col("scope").cast("int") % 6 == 5, 1).otherwise(0)))


SCOPE_SQL = """WITH c AS (SELECT c_nationkey AS s, c_custkey - CASE WHEN c_nationkey < 5 THEN c_custkey % 2 ELSE 0 END AS u FROM customer),
g AS (SELECT s, count(*) AS before, count(*) + CASE WHEN s % 6 = 5 THEN 1 ELSE 0 END AS after, count(DISTINCT u) AS discovered FROM c GROUP BY s)"""


@query(f"{SCOPE_SQL} SELECT s::VARCHAR AS scope, before AS official_before, after AS official_after, discovered, greatest(1, ceil(before / 9)::BIGINT + 12) AS target_pages, greatest(after - discovered, 0) AS missing_count, greatest(discovered - after, 0) AS extra_count, round_even(discovered / after * 100, 2) AS listing_coverage_pct, before = after AND discovered = after AS complete FROM g")
def scope_audit(spark, sf):
    a = crawl_audit.scope_audit(crawl_audit.scope_state(crawled(spark, sf)))
    return a.select("scope", *[long(c).alias(c) for c in ("official_before", "official_after", "discovered", "target_pages", "missing_count", "extra_count")], "listing_coverage_pct", "complete")


def scanned_pages(spark, sf):
    """Landed scans: a nation is a scope, a customer an announcement, its number
    tells the page. Some scopes fail at page 7 or have a moving counter, and are
    scanned again."""
    c = D.table(spark, sf, "customer").select(F.col("c_nationkey").alias("s"), (F.col("c_custkey") % 30 + 1).cast("int").alias("page"), F.col("c_custkey").alias("k"))
    n = c.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    link = F.concat(F.lit('<a href="/fr/concours/details/'), _uuid(F.col("k")), F.lit('">t</a>'))
    first = n.select("s", F.lit(1).alias("page"), F.lit("").alias("link"))
    pages = c.select("s", "page", link.alias("link")).unionByName(first).groupBy("s", "page").agg(F.array_join(F.array_sort(F.collect_list("link")), "").alias("links")).join(n, "s")
    s, late, again = F.col("s"), F.col("snapshot") == "final", F.col("attempt") == 2
    fails = s % 3 == 0
    pages = pages.withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).filter(~again | fails | (s % 5 == 1) | (s % 7 == 2))
    pages = pages.withColumn("snapshot", F.explode(F.when(F.col("page") == 1, F.array(F.lit("first"), F.lit("final"))).otherwise(F.array(F.lit("body")))))
    official = F.col("n") + F.when(late & ~again & (s % 5 == 1), 1).otherwise(0) + F.when(late & (s % 7 == 2), 2).otherwise(0)
    broken = fails & ~again & (F.col("page") == 7)
    html = F.concat(F.lit("<div>"), official.cast("string"), F.lit(" Résultats</div>"), "links")
    return pages.select(s.cast("string").alias("scope"), "page", "snapshot", F.when(~broken, html).alias("html"), "attempt", F.when(broken, "HTTPError: 500").alias("error"))


@query("""WITH c AS (SELECT c_nationkey AS s, c_custkey % 30 + 1 AS page FROM customer), n AS (SELECT s, count(*) AS n, count(*) FILTER (page = 7) AS n7, count(DISTINCT page) FILTER (page > 1) AS p FROM c GROUP BY s),
a AS (SELECT s, attempt, n AS official_before, n + CASE WHEN attempt = 1 AND s % 5 = 1 THEN 1 ELSE 0 END + CASE WHEN s % 7 = 2 THEN 2 ELSE 0 END AS official_after, n - CASE WHEN attempt = 1 AND s % 3 = 0 THEN n7 ELSE 0 END AS discovered,
    CASE WHEN attempt = 1 AND s % 3 = 0 AND n7 > 0 THEN 1 ELSE 0 END AS errors, p + 1 AS pages_requested FROM n, (VALUES (1), (2)) AS v(attempt) WHERE attempt = 1 OR s % 3 = 0 OR s % 5 = 1 OR s % 7 = 2),
b AS (SELECT *, official_before = official_after AND discovered = official_after AND errors = 0 AS complete FROM a)
SELECT s::VARCHAR AS scope, attempt::BIGINT AS attempt, official_before::BIGINT AS official_before, official_after::BIGINT AS official_after, discovered, errors::BIGINT AS errors, pages_requested, complete
FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY complete DESC, CASE WHEN complete THEN 0 ELSE discovered / greatest(official_after, 1) END DESC, CASE WHEN complete THEN 0 ELSE errors END, CASE WHEN complete THEN 0 ELSE discovered END DESC, attempt) AS rn FROM b) WHERE rn = 1""")
def listing_scan(spark, sf):
    _, best = crawl_audit.scanned(scanned_pages(spark, sf), _SITE)
    return best.select("scope", *[long(c).alias(c) for c in ("attempt", "official_before", "official_after", "discovered", "errors", "pages_requested")], "complete")


def url_sets(spark, sf):
    o, k = D.table(spark, sf, "orders"), F.col("o_orderkey")
    of = lambda on: o.filter(on).select(F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return of(k % 3 != 0), of((k % 3 != 0) & (k % 50 != 1) & (k % 100 != 7)), of(k % 100 == 7), of(k % 200 == 1)


GATE_SQL = """k AS (SELECT o_orderkey % 3 <> 0 AS e, o_orderkey % 3 <> 0 AND o_orderkey % 50 <> 1 AND o_orderkey % 100 <> 7 AS p, o_orderkey % 100 = 7 AS r, o_orderkey % 200 = 1 AS f FROM orders),
gate AS (SELECT count(*) FILTER (e) AS expected_urls, count(*) FILTER (e AND NOT r) AS resolvable_urls, count(*) FILTER (p) AS parsed_urls, count(*) FILTER (r) AS retired_urls, count(*) FILTER (r AND NOT e) AS invalid_retired_urls,
    count(*) FILTER (e AND NOT r AND NOT p) AS missing_urls, count(*) FILTER (p AND (r OR NOT e)) AS unexpected_urls, count(*) FILTER (f) AS failed_urls FROM k)"""


@query(f"WITH {GATE_SQL} SELECT *, invalid_retired_urls + missing_urls + unexpected_urls + failed_urls = 0 AS detail_gate FROM gate")
def reconcile_gate(spark, sf):
    return crawl_audit.detail_gate(*url_sets(spark, sf))


@query(f"""{SCOPE_SQL}, {GATE_SQL}, {DATED_SQL}, x AS (SELECT *, {FRESH_SQL} AS decision FROM dated)
SELECT (SELECT bool_and(before = after AND discovered = after) FROM g) AS listing_gate, (SELECT sum(after) FROM g)::BIGINT AS official_total, (SELECT sum(discovered) FROM g)::BIGINT AS discovered_total, missing_urls, (SELECT count(*) FROM x) AS jobs,
    (SELECT count(*) FROM x WHERE decision = 'accepted') AS accepted, (SELECT count(*) FROM x WHERE decision <> 'accepted') AS rejected, (SELECT count(*) FROM x WHERE publication_date::DATE = now::DATE) AS today_jobs, false AS gate FROM gate""")
def audit_row(spark, sf):
    states, gate = crawl_audit.scope_state(crawled(spark, sf)), crawl_audit.detail_gate(*url_sets(spark, sf))
    row = crawl_audit.audit_row(states, gate, crawl_audit.decisions(dated(spark, sf), D.now()), D.now())
    return row.select("listing_gate", long("official_total").alias("official_total"), long("discovered_total").alias("discovered_total"), "missing_urls", "jobs", "accepted", "rejected", "today_jobs", "gate")


# --- matching -----------------------------------------------------------------


def flat(matches: DataFrame) -> DataFrame:
    return matches.select("uuid", F.col("match.profession_id").alias("profession_id"), F.col("match.score").alias("score"), F.col("match.confidence").alias("confidence"), F.col("match.evidence.field").alias("field"), F.col("match.evidence.value").alias("value"), F.col("match.evidence.matched_term").alias("matched_term"), F.col("match.evidence.raw_score").alias("raw_score"))


_FLAT_SQL = f"uuid, pid AS profession_id, round(least(weighted, 100), 2) AS score, {D.confidence_sql('weighted')} AS confidence, field, value, term AS matched_term, round(raw, 2) AS raw_score"


@query(f"WITH {D.CANDIDATES_SQL} SELECT {_FLAT_SQL} FROM market")
def strict_match(spark, sf):
    return flat(matching.classify(matching.evidence(D.jobs(spark, sf)), matching.market_terms(D.taxonomy(spark)), matching.strict_score(), V.STRICT_MINIMUM))


@query(f"WITH {D.CANDIDATES_SQL} SELECT {_FLAT_SQL} FROM official")
def official_match(spark, sf):
    return flat(matching.classify(matching.evidence(D.jobs(spark, sf)), matching.official_terms(D.taxonomy(spark)), matching.strict_score(), V.OFFICIAL_MINIMUM))


@query(f"WITH {D.CANDIDATES_SQL} SELECT {_FLAT_SQL} FROM relevant")
def related_match(spark, sf):
    return flat(matching.classify(matching.evidence(D.jobs(spark, sf)), matching.market_terms(D.taxonomy(spark)), matching.related_score(), V.RELATED_MINIMUM, V.RELATED_MAXIMUM, False))


@query(f"WITH {D.CANDIDATES_SQL} SELECT {_FLAT_SQL} FROM context")
def context_rules(spark, sf):
    return flat(matching.context_matches(D.jobs(spark, sf), D.taxonomy(spark), D.RULES))


def candidates(spark, sf):
    j, t = D.jobs(spark, sf), D.taxonomy(spark)
    return j, matching.merged(matching.context_matches(j, t, D.RULES), matching.classify(matching.evidence(j), matching.market_terms(t), matching.strict_score(), V.STRICT_MINIMUM))


@query(f"WITH {D.CANDIDATES_SQL} SELECT {_FLAT_SQL} FROM merged")
def merge_max(spark, sf):
    return flat(candidates(spark, sf)[1])


def after(spark, sf, change: Callable[[Column], Column]) -> DataFrame:
    """uuid, profession_id of the candidates that a policy leaves."""
    j, found = candidates(spark, sf)
    rows = policy.with_role(j).join(matching.sorted_matches(found), "uuid")
    return rows.select("uuid", F.explode(change(F.col("matches"))).alias("m")).select("uuid", "m.profession_id")


def _left(condition: str) -> str:
    return f"WITH {D.INDEX_SQL} SELECT uuid, pid AS profession_id FROM flag WHERE {condition}"


def _overridden(markers, pid):
    def change(m):
        return F.coalesce(policy.override(m, F.col("po_whole"), markers, pid), m)

    return change


@query(_left(f"NOT academic OR pid = '{V.ACADEMIC_ID}'"))
def role_override(spark, sf):
    return after(spark, sf, _overridden(V.ACADEMIC_MARKERS, V.ACADEMIC_ID))


@query(_left(f"NOT trainer OR pid = '{V.TRAINER_ID}'"))
def trainer_override(spark, sf):
    return after(spark, sf, _overridden(V.TRAINER_MARKERS, V.TRAINER_ID))


@query(_left("NOT titled OR field IN ('job_name', 'context_rule')"))
def title_authority(spark, sf):
    return after(spark, sf, lambda m: policy.title_authority(m, text.text("job_name")))


_POLICY_FROM_FLAG = D.INDEX_SQL.replace("FROM flag WHERE NOT academic AND NOT trainer AND (NOT titled OR field IN ('job_name', 'context_rule'))", "FROM flag")


@query(f"WITH {_POLICY_FROM_FLAG} SELECT uuid, pid AS profession_id FROM tech")
def technician_policy(spark, sf):
    return after(spark, sf, lambda m: policy.technician_semantics(m, policy.ids(m), F.col("po_role"), F.col("po_tracks")))


@query(f"WITH {D.CANDIDATES_SQL} SELECT uuid, pid AS profession_id FROM merged l WHERE NOT EXISTS (SELECT 1 FROM merged o JOIN (VALUES {D._pairs(V.DOMINANCE)}) AS d(a, b) ON d.a = o.pid WHERE o.uuid = l.uuid AND d.b = l.pid)")
def dominance_prune(spark, sf):
    return after(spark, sf, lambda m: policy.without(m, policy.dominated(policy.ids(m))))


@query(f"""WITH {D.CANDIDATES_SQL}, worded AS (SELECT *, {D.norm_sql('value')} AS title, list_distinct({D.tokens_sql(D.norm_sql('term'))}) AS words FROM merged)
SELECT uuid, pid AS profession_id FROM worded l WHERE NOT (l.field = 'job_name' AND len(l.words) > 0 AND EXISTS (SELECT 1 FROM worded o WHERE o.uuid = l.uuid AND o.field = 'job_name' AND o.title = l.title AND len(o.words) > len(l.words) AND list_has_all(o.words, l.words) AND o.score >= l.score))""")
def subset_prune(spark, sf):
    return after(spark, sf, lambda m: policy.without(m, policy.narrower_titles(m)))


def built(spark, sf):
    return index_plan.build_index(D.jobs(spark, sf), D.taxonomy(spark), D.RULES)


def classified(spark, sf):
    return index_plan.classified(D.jobs(spark, sf), D.taxonomy(spark), D.RULES)


@query(f"WITH {D.INDEX_SQL} SELECT uuid, pid AS profession_id, rank::BIGINT AS rank, score, {D.confidence_sql('weighted')} AS confidence, field, term AS matched_term, source FROM final")
def classify_topk(spark, sf):
    c = policy.classify_jobs(D.jobs(spark, sf), D.taxonomy(spark), D.RULES).select("uuid", F.posexplode("profession_matches").alias("rank", "m"))
    return c.select("uuid", "m.profession_id", long(F.col("rank") + 1).alias("rank"), "m.score", "m.confidence", F.col("m.evidence.field").alias("field"), F.col("m.evidence.matched_term").alias("matched_term"), "m.source")


@query(f"WITH {D.INDEX_SQL} SELECT uuid, pid AS profession_id, rank::BIGINT AS rank, score FROM hints")
def related_hints(spark, sf):
    h = built(spark, sf).select("uuid", F.posexplode("related_profession_matches").alias("rank", "m"))
    return h.select("uuid", "m.profession_id", long(F.col("rank") + 1).alias("rank"), "m.score")


@query(f"WITH {D.INDEX_SQL} SELECT j.uuid, {TITLE_SQL} AS search_title, coalesce((SELECT string_agg(pid, ',' ORDER BY rank) FROM final f WHERE f.uuid = j.uuid), '') AS profession_ids FROM jobs j")
def search_index(spark, sf):
    return classified(spark, sf).select("uuid", "search_title", F.array_join("profession_ids", ",").alias("profession_ids"))


# --- lookups and suggestions --------------------------------------------------

_ASKED_SQL = f"asked AS (SELECT *, {D.norm_sql('query')} AS q FROM ({D.ASKED_QUERY_SQL}))"
_TYPED_SQL = f"asked AS (SELECT *, {D.norm_sql('query')} AS q FROM ({D.TYPED_QUERY_SQL}))"
_DIPLOMAS_SQL = "(SELECT DISTINCT unnest(['licence', 'DIPLOME ' || p_name, p_type]) AS query FROM part)"
_IDS_SQL = "(SELECT DISTINCT unnest(['hcp.2', 'part.' || replace(p_name, ' ', '_') || '_' || lower(p_type), p_name]) AS id FROM part)"


def taxonomy(spark, sf):
    return D.catalogue_taxonomy(spark, sf)


@query(f"""WITH {D.CATALOGUE_TAXONOMY_SQL}, {D.TERMS_SQL}, {_ASKED_SQL}, h AS (SELECT DISTINCT query, id, source FROM asked JOIN terms ON q = norm_term AND q <> '')
SELECT query, array_to_string(list_sort(list(id)), ',') AS ids FROM h WHERE source = '{MARKET}' OR query NOT IN (SELECT query FROM h WHERE source = '{MARKET}') GROUP BY query""")
def exact_lookup(spark, sf):
    return tax.exact_ids(taxonomy(spark, sf), D.asked(spark, sf)).select("query", F.array_join("ids", ",").alias("ids"))


@query(f"WITH {D.CATALOGUE_TAXONOMY_SQL} SELECT q.query, id, label FROM (SELECT *, unnest(diplomas) AS d FROM tax WHERE source = '{MARKET}') t JOIN {_DIPLOMAS_SQL} AS q ON {D.norm_sql('d')} = {D.norm_sql('q.query')}")
def diploma_lookup(spark, sf):
    asked = D.table(spark, sf, "part").select(F.explode(F.array(F.lit("licence"), F.concat(F.lit("DIPLOME "), "p_name"), "p_type")).alias("query")).distinct()
    return tax.by_diploma(taxonomy(spark, sf), asked).select("query", "id", "label")


@query(f"WITH {D.CATALOGUE_TAXONOMY_SQL} SELECT id, label FROM tax JOIN {_IDS_SQL} AS q USING (id)")
def point_lookup(spark, sf):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    ids = D.table(spark, sf, "part").select(F.explode(F.array(F.lit("hcp.2"), F.concat(F.lit("part."), name, F.lit("_"), F.lower("p_type")), "p_name")).alias("id")).distinct()
    return tax.profession(taxonomy(spark, sf), ids).select("id", "label")


@query(f"WITH {D.CATALOGUE_TAXONOMY_SQL} SELECT id AS profession_id, label, array_to_string(aliases, '|') AS aliases, source FROM tax")
def autocomplete_payload(spark, sf):
    return tax.autocomplete_export(taxonomy(spark, sf)).select("profession_id", "label", F.array_join("aliases", "|").alias("aliases"), "source")


_WORD_STARTS = "len(list_filter(string_split(norm_term, ' '), lambda w: starts_with(w, q))) > 0"
SCORE_SQL = f"""CASE WHEN q = norm_term THEN 1000.0 WHEN starts_with(norm_term, q) THEN 920.0 WHEN {_WORD_STARTS} THEN 860.0 WHEN {D.phrase_sql('norm_term', 'q')} THEN 820.0
    WHEN len(qt) > 0 AND list_has_all(term_tokens, qt) THEN 780.0 + least(len(qt), 5) ELSE -1.0 END::DOUBLE"""
#: The longest common block of a range of two strings, as [letters, -from, -from]: the first of equal ones.
_BLOCK_SQL = "list_sort(flatten(list_transform(range(g.alo, g.ahi), lambda i: list_transform(range(g.blo, g.bhi), lambda j: [len(list_filter(range(1, least(g.ahi - i, g.bhi - j) + 1), lambda k: q[i:i + k - 1] = t[j:j + k - 1])), -i, -j]))), 'DESC')[1]"
#: Twice the letters that both have, in any order: no pair's blocks have more.
_LETTERS_SQL = "2 * list_sum(list_transform(list_distinct(string_split(q, '')), lambda c: least(length(q) - length(replace(q, c, '')), length(norm_term) - length(replace(norm_term, c, '')))))"
#: ratio: q, t and twice the letters in common blocks (the longest, then those before and after it) by all letters.
RATIO_SQL = f"""blocks AS (
    SELECT DISTINCT q, norm_term AS t, {{'alo': 1::BIGINT, 'ahi': length(q) + 1, 'blo': 1::BIGINT, 'bhi': length(norm_term) + 1}} AS g FROM met WHERE s < 0 AND 2 * least(length(q), length(norm_term)) / (length(q) + length(norm_term)) >= {V.FUZZY_RATIO} AND {_LETTERS_SQL} / (length(q) + length(norm_term)) >= {V.FUZZY_RATIO}
    UNION ALL SELECT q, t, unnest([{{'alo': g.alo, 'ahi': -m[2], 'blo': g.blo, 'bhi': -m[3]}}, {{'alo': m[1] - m[2], 'ahi': g.ahi, 'blo': m[1] - m[3], 'bhi': g.bhi}}]) AS g FROM (SELECT *, {_BLOCK_SQL} AS m FROM blocks) WHERE m[1] > 0),
ratio AS (SELECT q, t AS norm_term, 2.0::DOUBLE * sum(coalesce(({_BLOCK_SQL})[1], 0)) / (length(q) + length(t)) AS r FROM blocks GROUP BY q, t)"""


def _suggest_sql(asked: str, fuzzy: bool) -> str:
    ruled = f"SELECT *, {SCORE_SQL} AS s FROM (SELECT *, list_distinct({D.tokens_sql('q')}) AS qt FROM asked WHERE q <> ''), terms"
    scored = f"met AS ({ruled}), {RATIO_SQL}, every AS (SELECT met.* REPLACE (CASE WHEN s < 0 AND r >= {V.FUZZY_RATIO} THEN 500 + 100 * r ELSE s END AS s) FROM met LEFT JOIN ratio USING (q, norm_term))" if fuzzy else f"every AS ({ruled})"
    charged = f"CASE WHEN contains({D.norm_sql('label')}, 'n c a') THEN 90 ELSE 0 END"
    return f"""{D.CATALOGUE_TAXONOMY_SQL}, {D.TERMS_SQL}, {asked}, {scored},
best AS (SELECT query, id, label, source, term, s, max(CASE WHEN term_ord = 0 THEN s END) OVER (PARTITION BY query, id) AS ls, row_number() OVER (PARTITION BY query, id ORDER BY s DESC, term_ord) AS rn FROM every),
cut AS (SELECT *, round(s - {charged}, 2) AS score, ls - {charged} AS label_score FROM best WHERE rn = 1 AND s >= 0),
tiered AS (SELECT *, CASE WHEN source = '{MARKET}' THEN 0 ELSE 2 END + CASE WHEN score >= 800 THEN 0 ELSE 1 END AS tier FROM cut WHERE score >= 585),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, CASE WHEN label_score >= 800 THEN 0 ELSE 1 END, label_score DESC, lower(label), starts_with(id, 'part.')) AS rank FROM (SELECT *, min(tier) OVER (PARTITION BY query) AS first FROM tiered) WHERE tier = first)"""


SUGGEST_SQL, FUZZY_SQL = _suggest_sql(_ASKED_SQL, False), _suggest_sql(_TYPED_SQL, True)


@query(f"WITH {SUGGEST_SQL} SELECT query, id AS profession_id, term, s AS score FROM every WHERE s >= 0")
def suggest_structured(spark, sf):
    return suggest.term_scores(D.asked(spark, sf), taxonomy(spark, sf), fuzzy=False).select("query", F.col("id").alias("profession_id"), "term", "score")


@query(f"WITH {SUGGEST_SQL} SELECT query, rank::BIGINT AS rank, id AS profession_id, term AS matched_term, score FROM ranked WHERE rank <= 10")
def suggest_tiered(spark, sf):
    return suggest.suggest(D.asked(spark, sf), taxonomy(spark, sf), fuzzy=False).select("query", long("rank").alias("rank"), "profession_id", "matched_term", "score")


@query(f"WITH RECURSIVE {FUZZY_SQL} SELECT query, rank::BIGINT AS rank, id AS profession_id, term AS matched_term, score FROM ranked WHERE rank <= 10")
def suggest_fuzzy(spark, sf):
    return suggest.suggest(D.typed(spark, sf), taxonomy(spark, sf)).select("query", long("rank").alias("rank"), "profession_id", "matched_term", "score")


@query(f"""WITH RECURSIVE {FUZZY_SQL}, h AS (SELECT DISTINCT query, id, source FROM asked JOIN terms ON q = norm_term AND q <> ''),
m AS (SELECT query, min(id) AS id FROM h WHERE source = '{MARKET}' OR query NOT IN (SELECT query FROM h WHERE source = '{MARKET}') GROUP BY query HAVING count(*) = 1),
o AS (SELECT query, min(id) AS id FROM ranked WHERE rank <= 8 GROUP BY query HAVING count(*) = 1 AND min(score) >= {V.AUTOSELECT_MINIMUM})
SELECT query, coalesce(tax.id, m.id, o.id) AS profession_id FROM asked LEFT JOIN tax ON tax.id = query LEFT JOIN m USING (query) LEFT JOIN o USING (query)""")
def resolve_query(spark, sf):
    return suggest.resolve(D.typed(spark, sf), taxonomy(spark, sf))


# --- search -------------------------------------------------------------------

RANK_SQL = f"round(least(score * 0.82 + greatest(10.0::DOUBLE - least(greatest(date_diff('day', publication_date::TIMESTAMP, TIMESTAMP '{D.NOW}'), 0), 15) * (10.0::DOUBLE / 15.0::DOUBLE), 0.0::DOUBLE) + least(greatest(date_diff('day', TIMESTAMP '{D.NOW}', deadline::TIMESTAMP), 0), 10) * 0.3::DOUBLE + 5.0::DOUBLE, 100.0::DOUBLE), 2)"


@query(f"WITH {D.INDEX_SQL} SELECT j.uuid, f.pid AS profession_id, {RANK_SQL} AS score FROM final f JOIN jobs j USING (uuid)")
def rank_score(spark, sf):
    i = classified(spark, sf).select("uuid", "publication_date", "deadline", F.explode("profession_matches").alias("m"))
    return i.select("uuid", "m.profession_id", search.rank(F.col("m"), "publication_date", "deadline", D.now()).alias("score"))


_SHOWN_SQL = f"coalesce(nullif(trim(job_name), ''), CASE WHEN f.field = 'context_rule' THEN f.label END, {TITLE_SQL})"


@query(f"WITH {D.INDEX_SQL} SELECT j.uuid, f.pid AS profession_id, {_SHOWN_SQL} AS title, trim(listing_title) AS source_title, trim({TITLE_SQL}) AS search_title FROM final f JOIN jobs j USING (uuid)")
def result_titles(spark, sf):
    i = classified(spark, sf).select("*", F.explode("profession_matches").alias("m"))
    return i.select("uuid", F.col("m.profession_id").alias("profession_id"), *[c.alias(k) for k, c in search.result_titles(F.col("m")).items()])


TOPK_SQL = f"WITH {D.INDEX_SQL} SELECT score, uuid, title, matched_profession_label, positions::BIGINT AS positions FROM (SELECT j.uuid, {RANK_SQL} AS score, {_SHOWN_SQL} AS title, f.label AS matched_profession_label, publication_date, positions FROM final f JOIN jobs j USING (uuid) WHERE f.pid = 'edu.prof_universitaire') ORDER BY score DESC, publication_date DESC, uuid LIMIT 20"


@query(TOPK_SQL)
def search_topk(spark, sf):
    return search.search(classified(spark, sf), "edu.prof_universitaire", D.now()).select("score", "uuid", "title", "matched_profession_label", long("positions").alias("positions"))


@query(TOPK_SQL)
def search_written(spark, sf):
    """The same search over an index that was published as files: it reads the
    bucket of its profession."""
    path = files.work_path(spark, "index")
    index_store.publish(classified(spark, sf), path, source="tables", generated_at=D.NOW)
    return index_store.SearchIndex(spark, path).search("edu.prof_universitaire", D.now()).select("score", "uuid", "title", "matched_profession_label", long("positions").alias("positions"))


# --- quality ------------------------------------------------------------------

_TEXT_SQL = lambda c: rf"trim(regexp_replace(replace({D.fold_sql(c)}, '’', ''''), '\s+', ' ', 'g'))"
_GENERIC_SQL = "(" + " OR ".join(f"regexp_full_match({_TEXT_SQL('grade')}, {D._q(p)})" for p in V.GENERIC_GRADES) + ")"
_BARE_SQL = "len(list_filter(specialties, lambda x: trim(x) <> '')) = 0"
REASON_SQL = f"CASE WHEN {_BARE_SQL} AND {_TEXT_SQL('job_name')} = '' AND {_GENERIC_SQL} THEN 'generic_public_grade_without_specialty' WHEN {_BARE_SQL} AND {_TEXT_SQL('job_name')} IN ({', '.join(map(D._q, V.GENERIC_JOB_NAMES))}) THEN 'generic_aggregate_job_name' ELSE '' END"


@query(f"WITH {D.JOBS_SQL} SELECT uuid, {REASON_SQL} AS reasons FROM jobs")
def ambiguity(spark, sf):
    return D.jobs(spark, sf).select("uuid", F.array_join(quality.ambiguity_reasons(), ",").alias("reasons"))


@query(f"""WITH {D.INDEX_SQL}, s AS (SELECT uuid, {REASON_SQL} <> '' AS a, uuid IN (SELECT uuid FROM final) AS m FROM jobs)
SELECT count(*) AS jobs, count(*) FILTER (m) AS classified_jobs, count(*) FILTER (a) AS structurally_ambiguous_jobs, count(*) FILTER (NOT a AND m) AS classified_classifiable_jobs, count(*) FILTER (NOT a AND NOT m) AS unexplained_unclassified_jobs, count(*) FILTER (a AND m) AS ambiguous_classified_jobs,
    round_even(count(*) FILTER (m) / count(*) * 100, 2) AS raw_classification_coverage_pct, round_even(count(*) FILTER (NOT a AND m) / count(*) FILTER (NOT a) * 100, 2) AS classifiable_coverage_pct,
    round_even(count(*) FILTER (NOT a AND m) / count(*) FILTER (NOT a) * 100, 2) >= 90 AND count(*) FILTER (a AND m) = 0 AS gate FROM s""")
def coverage(spark, sf):
    return quality.coverage(classified(spark, sf)).select("jobs", "classified_jobs", "structurally_ambiguous_jobs", "classified_classifiable_jobs", "unexplained_unclassified_jobs", "ambiguous_classified_jobs", "raw_classification_coverage_pct", "classifiable_coverage_pct", "gate")


@query(f"""WITH {D.INDEX_SQL}, s AS (SELECT j.uuid, positions, count(f.pid) AS n, bool_or(f.weighted >= 98) AS ex, bool_or(f.source = '{MARKET}') AS mk, (SELECT count(*) FROM hints h WHERE h.uuid = j.uuid) AS nh FROM jobs j LEFT JOIN final f USING (uuid) GROUP BY ALL)
SELECT count(*) AS jobs, count(*) FILTER (n > 0) AS classified_jobs, count(*) FILTER (n > 0 AND ex) AS exact_jobs, count(*) FILTER (n > 0 AND NOT ex) AS strong_jobs, count(*) FILTER (n > 0 AND mk) AS market_classified_jobs, count(*) FILTER (n > 0 AND NOT mk) AS official_fallback_jobs,
    count(*) FILTER (n = 0 AND nh > 0) AS related_only_jobs, sum(positions)::BIGINT AS positions, coalesce(sum(positions) FILTER (n > 0), 0)::BIGINT AS classified_positions, round_even(coalesce(sum(positions) FILTER (n > 0), 0)::BIGINT / sum(positions)::BIGINT * 100, 2) AS position_coverage_pct FROM s""")
def index_counters(spark, sf):
    return quality.index_counters(built(spark, sf))


EXPECTED_SQL = f"""e AS (SELECT p_partkey::VARCHAR AS uuid, CASE WHEN p_partkey % 21 = 0 THEN ['{V.ACADEMIC_ID}'] ELSE ['it.cybersecurite'] END AS required, ['it.responsable_si', 'sales.marketing'] AS forbidden FROM part WHERE p_partkey % 21 = 0 OR p_name = 'red widget')"""


def expected(spark, sf):
    k = F.col("p_partkey")
    p = D.table(spark, sf, "part").filter((k % 21 == 0) | (F.col("p_name") == "red widget"))
    return p.select(k.cast("string").alias("uuid"), F.when(k % 21 == 0, F.array(F.lit(V.ACADEMIC_ID))).otherwise(F.array(F.lit("it.cybersecurite"))).alias("required"), F.array(F.lit("it.responsable_si"), F.lit("sales.marketing")).alias("forbidden"))


@query(f"""WITH {D.INDEX_SQL}, {EXPECTED_SQL}, h AS (SELECT e.uuid, required, forbidden, list_filter(list(f.pid), lambda x: x IS NOT NULL) AS got FROM e LEFT JOIN final f USING (uuid) GROUP BY ALL)
SELECT uuid, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(got, x))), ',') AS missing, array_to_string(list_sort(list_filter(forbidden, lambda x: list_contains(got, x))), ',') AS leaked,
    len(list_filter(required, lambda x: NOT list_contains(got, x))) + len(list_filter(forbidden, lambda x: list_contains(got, x))) = 0 AS pass FROM h""")
def expectation_audit(spark, sf):
    return quality.expectation_audit(classified(spark, sf), expected(spark, sf)).select("uuid", F.array_join("missing", ",").alias("missing"), F.array_join("leaked", ",").alias("leaked"), "pass")


@query(f"""WITH {D.INDEX_SQL}, {EXPECTED_SQL}, h AS (SELECT e.uuid, required, forbidden, list_filter(list(f.pid), lambda x: x IS NOT NULL) AS got FROM e LEFT JOIN final f USING (uuid) GROUP BY ALL)
SELECT uuid, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(got, x))), ',') AS missing, array_to_string(list_sort(list_filter(got, lambda x: NOT list_contains(required, x))), ',') AS unexpected,
    len(list_filter(required, lambda x: NOT list_contains(got, x))) + len(list_filter(got, lambda x: NOT list_contains(required, x))) + len(list_filter(got, lambda x: list_contains(forbidden, x))) = 0 AS pass FROM h""")
def golden_diff(spark, sf):
    i = classified(spark, sf).select("uuid", policy.ids(F.col("profession_matches")).alias("actual"), F.transform("profession_matches", lambda m: m["confidence"]).alias("confidences"))
    cases = expected(spark, sf).join(i, "uuid").withColumnsRenamed({"required": "must_include", "forbidden": "must_exclude"}).withColumn("allowed_ids", F.array().cast("array<string>"))
    return quality.golden_audit(cases).select("uuid", F.array_join("missing", ",").alias("missing"), F.array_join("unexpected", ",").alias("unexpected"), "pass")


@query(f"WITH {D.INDEX_SQL} SELECT uuid, pid AS profession_id, score FROM hints UNION ALL SELECT uuid, pid, score FROM final WHERE score < 92")
def index_safety(spark, sf):
    i = built(spark, sf)
    both = i.withColumn("profession_matches", F.concat("profession_matches", "related_profession_matches"))
    return quality.unsafe_matches(both).select("uuid", "profession_id", "score")


_AUDIT_SQL = lambda c: rf"trim(regexp_replace({D.fold_sql(c)}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query(f"""WITH {D.INDEX_SQL}, raw AS (SELECT uuid, list_sort(list_distinct(list(pid))) AS ids, list(field) AS fields FROM merged GROUP BY uuid),
j AS (SELECT r.*, job_name, {_AUDIT_SQL("job_name || ' ' || grade || ' ' || listing_title")} AS role, {_AUDIT_SQL('job_name')} AS name FROM raw r JOIN jobs USING (uuid))
SELECT uuid, 'academic_role_leak' AS type FROM j WHERE ({' OR '.join(f"contains(role, {D._q(text.norm_text(m))})" for m in V.ACADEMIC_MARKERS)}) AND ids <> ['{V.ACADEMIC_ID}']
UNION ALL SELECT uuid, 'trainer_role_leak' FROM j WHERE {D.any_phrase_sql('name', V.TRAINER_MARKERS)} AND ids <> ['{V.TRAINER_ID}']
UNION ALL SELECT uuid, 'generic_specific_duplicate' FROM j, (VALUES {D._pairs(V.DOMINANCE)}) AS d(a, b) WHERE list_contains(ids, a) AND list_contains(ids, b)
UNION ALL SELECT uuid, 'explicit_title_specialty_competition' FROM j WHERE job_name <> '' AND list_contains(fields, 'job_name') AND list_contains(fields, 'specialty')
UNION ALL SELECT m.uuid, 'listing_role_entity_contamination' FROM merged m WHERE field = 'listing_role' AND ({' OR '.join(D.phrase_sql(_AUDIT_SQL('value'), D._q(t)) for t in V.EMPLOYER_TRACES)})""")
def semantic_failures(spark, sf):
    j, found = candidates(spark, sf)  # before the policies, so that there is something to find
    i = j.join(matching.sorted_matches(found).withColumnRenamed("matches", "profession_matches"), "uuid")
    return quality.semantic_failures(i).select("uuid", "type")


_TECH_SQL = f"WITH {D.INDEX_SQL}, t AS (SELECT j.uuid, grade, list_transform(specialties, lambda x: {_AUDIT_SQL('x')}) AS tracks, coalesce((SELECT list(pid) FROM merged m WHERE m.uuid = j.uuid), []) AS ids FROM jobs j WHERE contains({_AUDIT_SQL('grade')}, 'technicien') AND uuid IN (SELECT uuid FROM merged))"


@query(f"""{_TECH_SQL} SELECT uuid, 'TECHNICIEN_BECAME_DEVELOPER' AS type FROM t WHERE contains(array_to_string(tracks, ' | '), 'developpement informatique') AND list_contains(ids, 'it.developpeur_logiciel')
UNION ALL SELECT uuid, 'MISSING_TECHNICIEN_DEVELOPPEMENT' FROM t WHERE contains(array_to_string(tracks, ' | '), 'developpement informatique') AND NOT list_contains(ids, '{V.DEVELOPER_TECHNICIAN}')""")
def public_grade_failures(spark, sf):
    j, found = candidates(spark, sf)
    return quality.public_grade_failures(j.join(matching.sorted_matches(found).withColumnRenamed("matches", "profession_matches"), "uuid"))


@query(f"""{_TECH_SQL}, u AS (SELECT *, len(list_filter(tracks, lambda x: contains(x, 'informatique') AND NOT contains(x, 'developpement informatique') AND NOT contains(x, 'developpement numerique'))) > 0 AS independent FROM t WHERE len(list_filter(tracks, lambda x: contains(x, 'developpement informatique') OR contains(x, 'developpement numerique'))) > 0)
SELECT uuid, CASE WHEN independent THEN 'MISSING_INDEPENDENT_GENERIC_IT_TRACK' ELSE 'REDUNDANT_GENERIC_IT_PARENT' END AS type FROM u WHERE independent <> list_contains(ids, '{V.IT_TECHNICIAN}')""")
def specificity_failures(spark, sf):
    j, found = candidates(spark, sf)
    return quality.specificity_failures(j.join(matching.sorted_matches(found).withColumnRenamed("matches", "profession_matches"), "uuid"))


_EXPECTED_SQL = "x AS (SELECT DISTINCT p_name AS query, 'part.' || replace(p_name, ' ', '_') || '_' || lower(p_type) AS top, 'it.cybersecurite' AS forbidden FROM part)"


@query(f"""WITH {SUGGEST_SQL}, {_EXPECTED_SQL}
SELECT x.query, top, forbidden, coalesce((SELECT id FROM ranked r WHERE r.query = x.query AND rank = 1) = top, false) AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.query = x.query AND rank <= 50 AND id = forbidden) AS pass FROM x""")
def suggest_audit(spark, sf):
    top = F.concat(F.lit("part."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.lower("p_type"))
    e = D.table(spark, sf, "part").select(F.col("p_name").alias("query"), top.alias("top")).distinct()
    none = F.lit(None).cast("string")
    e = e.withColumns({"forbidden": F.array(F.lit("it.cybersecurite")), "label_prefix": none, "label_part": none})
    got = suggest.suggest(D.asked(spark, sf), taxonomy(spark, sf), limit=50, fuzzy=False)
    return quality.suggestion_audit(got, e).select("query", "top", F.col("forbidden")[0].alias("forbidden"), "pass")
