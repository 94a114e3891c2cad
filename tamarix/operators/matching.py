"""Linking announcements to professions.

A job's evidence is a few short strings. A term of the taxonomy is found by keys:
the whole normalised string, for equal ones, and its tokens but for the most
frequent one, since every other score needs two shared tokens and so one of
these. Both strings of a pair that meets are compared where it meets, at the
first key that they share, so nothing is counted by a shuffle. Strings repeat from
job to job, so different ones are compared, once each, and what was found is joined
with the jobs by string. The taxonomy side is small; the session's
broadcast threshold decides whether it is sent to all tasks or joined by shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import has_any_phrase, has_phrase, norm, text, tokens, with_listing_role
from ..sources.files import MARKET, OFFICIAL
from .taxonomy import by_id, terms


def evidence(jobs: DataFrame) -> DataFrame:
    """uuid, field_ord, field, value, weight, norm_value of each non-empty field."""
    one = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"), F.lit(V.FIELD_WEIGHTS[name]).alias("weight"))
    specialties = F.transform(F.coalesce("specialties", F.array().cast("array<string>")), lambda s: one("specialty", text(s)))
    jobs = with_listing_role(jobs, "listing_title", "role_found")
    parts = F.concat(
        F.array(one("job_name", text("job_name"))), specialties,
        F.array(one("listing_role", F.col("role_found")), one("listing_title", text("listing_title")), one("grade", text("grade"))),
    )
    rows = jobs.select("uuid", F.posexplode(F.filter(parts, lambda f: f["value"] != "")).alias("field_ord", "f")).select("uuid", "field_ord", "f.*")
    return rows.withColumn("norm_value", norm("value"))


def keyed(term_rows: DataFrame) -> DataFrame:
    """key, norm_term, term_tokens (the rarest first) of each different term."""
    t = term_rows.select("norm_term", "term_tokens").distinct()
    each = t.select("norm_term", F.explode("term_tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = each.join(often, "token").groupBy("norm_term").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("rarest"))
    t = t.join(ordered, "norm_term", "left").select("norm_term", F.coalesce("rarest", "term_tokens").alias("term_tokens"))
    rare = F.slice("term_tokens", 1, F.greatest(F.size("term_tokens") - 1, F.lit(0)))
    return t.select("norm_term", "term_tokens", F.explode(F.concat(F.array(whole("norm_term")), rare)).alias("key"))


def whole(c: str) -> Column:
    """The key of a whole string; no token begins like this."""
    return F.concat(F.lit("="), F.col(c))


def met(field_rows: DataFrame, term_rows: DataFrame) -> DataFrame:
    """field_rows with norm_term, equal, shared (tokens), n_value, n_term for all
    terms that are equal or share two tokens."""
    f = field_rows.withColumn("value_tokens", F.array_distinct(tokens(F.col("norm_value"))))
    f = f.withColumn("key", F.explode(F.concat(F.array(whole("norm_value")), "value_tokens")))
    m = f.join(keyed(term_rows), "key").withColumn("common", F.array_intersect("term_tokens", "value_tokens"))
    m = m.withColumn("equal", F.startswith("key", F.lit("=")))
    m = m.filter(F.col("equal") | ((F.size("common") >= 2) & (F.get("common", F.lit(0)) == F.col("key")) & (F.col("norm_value") != F.col("norm_term"))))
    return m.select(*field_rows.columns, "norm_term", "equal", F.size("common").alias("shared"), F.size("value_tokens").alias("n_value"), F.size("term_tokens").alias("n_term"))


def strict_score() -> Column:
    whole = has_phrase(F.col("norm_value"), F.col("norm_term"))
    return F.when(F.col("equal"), 100.0).when((F.col("n_term") >= 2) & whole, 98.0).when((F.col("n_term") >= 2) & (F.col("shared") == F.col("n_term")), 94.0).otherwise(0.0)


def related_score() -> Column:
    coverage = F.col("shared") / F.least("n_value", "n_term")
    jaccard = F.col("shared") / (F.col("n_value") + F.col("n_term") - F.col("shared"))
    return (
        F.when(F.col("equal"), 100.0)
        .when((F.col("n_term") >= 2) & (F.col("shared") == F.col("n_term")), 91.0)
        .when((F.col("n_value") >= 2) & (F.col("shared") == F.col("n_value")), 88.0)
        .when((coverage >= 0.80) & (jaccard >= 0.45), 84.0)
        .when((coverage >= 0.67) & (jaccard >= 0.35), 78.0)
        .otherwise(0.0)
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 98, "EXACT").when(score >= V.STRICT_MINIMUM, "STRONG").when(score >= V.RELATED_MINIMUM, "RELATED").otherwise("NONE")


_WHAT = ("label", "sector", "family", "hcp_codes", "source", "field", "value", "term")


#: Rows of a value that one part of the join takes.
OFTEN = 100_000


def dictionary(values: DataFrame, term_rows: DataFrame, **scores: Column) -> DataFrame:
    """values (value, ..) that have a term, with `found`: an array of norm_term and
    the scores. Each value is normalised and compared once."""
    hit = met(values.withColumn("norm_value", norm("value")), term_rows).withColumns(scores)
    hit = hit.filter(F.greatest(*map(F.col, scores), F.lit(0.0)) > 0)
    return hit.groupBy(*values.columns).agg(F.collect_list(F.struct("norm_term", *scores)).alias("found"))


def scored(field_rows: DataFrame, term_rows: DataFrame, **scores: Column) -> DataFrame:
    """uuid, field_ord, field, value, weight, norm_term and the scores of all pairs
    that have one. Values repeat from announcement to announcement: they are
    counted, each task sending one once, and only different ones are normalised
    and compared. What is found goes back to the rows by value; a value of many
    rows is dealt over parts, each with a copy of what was found."""
    rows = field_rows.select("uuid", "field_ord", "field", "value", "weight")
    values = rows.groupBy("value").agg(F.ceil(F.count(F.lit(1)) / OFTEN).cast("int").alias("parts"))
    found = dictionary(values, term_rows, **scores).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    often = values.filter("parts > 1")  # at most a row for each OFTEN rows
    dealt = rows.join(often, "value", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("uuid"), F.col("parts")).cast("int"), F.lit(0)))
    hit = dealt.drop("parts").join(found.drop("parts"), ["value", "part"]).drop("part")
    return hit.withColumn("f", F.explode("found")).select(*rows.columns, "f.*")


def best(field_rows: DataFrame, term_rows: DataFrame, **scores: Column) -> DataFrame:
    """uuid, profession_id and, for each score, a struct of the best match by it
    (null if there is none). Of equal best scores the first term's first field
    counts."""
    hit = scored(field_rows, term_rows, **scores).join(term_rows, "norm_term")
    found = []
    for name in scores:
        weighted = F.col(name) * F.col("weight")
        order = F.when(F.col(name) > 0, F.struct(weighted, -F.col("term_ord"), -F.col("field_ord")))
        found.append(F.max_by(F.struct(*_WHAT, weighted.alias("weighted"), F.col(name).alias("raw")), order).alias(name))
    return hit.groupBy("uuid", F.col("id").alias("profession_id")).agg(*found)


def as_match(b: Column, searchable: bool = True) -> Column:
    return match(b, b["weighted"], b["raw"], F.lit(searchable), b["field"], b["value"], b["term"])


def classify(field_rows: DataFrame, term_rows: DataFrame, score: Column, least: float, most: float | None = None, searchable: bool = True) -> DataFrame:
    """uuid and a match for each profession whose best score is in the band."""
    found = best(field_rows, term_rows, b=score)
    band = F.col("b.weighted") >= least
    if most is not None:
        band = band & (F.col("b.weighted") <= most)
    return found.filter(band).select("uuid", as_match(F.col("b"), searchable).alias("match"))


def match(row: Column, score: Column, raw: Column, searchable: Column, field: Column, value: Column, term: Column) -> Column:
    shown = F.round(F.least(score, F.lit(100.0)), 2)
    found = F.struct(field.alias("field"), value.alias("value"), term.alias("matched_term"), F.round(raw, 2).alias("raw_score"))
    return F.struct(
        F.col("profession_id"), row["label"].alias("label"), row["sector"].alias("sector"), row["family"].alias("family"), row["hcp_codes"].alias("hcp_codes"), row["source"].alias("source"),
        shown.alias("score"), confidence(score).alias("confidence"), searchable.alias("searchable"), found.alias("evidence"),
    )


def _phrases(given):
    return lambda s: has_any_phrase(s, given)


def context_matches(jobs: DataFrame, professions: DataFrame, rules=V.CONTEXT_RULES) -> DataFrame:
    """uuid and a match for each profession with a rule that holds: its highest,
    of equal ones the first. Rules are a few literals, so this is a projection and
    a join with the professions."""
    given = F.transform(F.coalesce("specialties", F.array().cast("array<string>")), norm)
    jobs = jobs.select("uuid", norm("job_name").alias("name"), norm("grade").alias("grade"), given.alias("specialties"))
    name, grade, specialties = F.col("name"), F.col("grade"), F.col("specialties")
    held = []
    for at, r in enumerate(rules):
        on = F.lit(True)
        if r.get("job_name_any"):
            on = on & has_any_phrase(name, r["job_name_any"])
        if r.get("grade_any"):
            on = on & has_any_phrase(grade, r["grade_any"])
        if r.get("specialty_any"):
            on = on & F.exists(specialties, _phrases(r["specialty_any"]))
        held.append(F.when(on, F.struct(F.lit(r["profession_id"]).alias("profession_id"), F.lit(r["id"]).alias("rule"), F.lit(float(r.get("score") or 99.0)).alias("raw"), F.lit(-at).alias("place"))))
    if not held:
        held = [F.lit(None).cast("struct<profession_id:string,rule:string,raw:double,place:int>")]
    hit = jobs.select("uuid", F.explode(F.array_compact(F.array(*held))).alias("h")).select("uuid", "h.*")
    market = by_id(professions).filter(F.col("source") == MARKET).select(F.col("id").alias("profession_id"), F.struct("label", "sector", "family", "hcp_codes", "source").alias("p"))
    hit = hit.join(market, "profession_id")
    best = hit.groupBy("uuid", "profession_id").agg(F.max_by(F.struct("p", "rule", "raw"), F.struct("raw", "place")).alias("b"))
    return best.select("uuid", match(F.col("b.p"), F.col("b.raw"), F.col("b.raw"), F.lit(True), F.lit("context_rule"), F.col("b.rule"), F.col("b.rule")).alias("match"))


def merged(context: DataFrame, market: DataFrame) -> DataFrame:
    """uuid, match: of each profession the higher score, the rule's on a tie."""
    both = context.withColumn("first", F.lit(1)).unionByName(market.withColumn("first", F.lit(0)))
    return both.groupBy("uuid", "match.profession_id").agg(F.max_by("match", F.struct("match.score", "first")).alias("match")).select("uuid", "match")


def in_order(matches: Column) -> Column:
    """By falling score, market first, then label."""
    key = lambda m: F.struct((-m["score"]).alias("s"), (m["source"] != MARKET).alias("o"), F.lower(m["label"]).alias("l"), m.alias("match"))
    return F.transform(F.array_sort(F.transform(matches, key)), lambda x: x["match"])


def sorted_matches(rows: DataFrame) -> DataFrame:
    """uuid, matches, in order."""
    return rows.groupBy("uuid").agg(in_order(F.collect_list("match")).alias("matches"))


def market_terms(professions: DataFrame) -> DataFrame:
    return terms(professions.filter(F.col("source") == MARKET))


def official_terms(professions: DataFrame) -> DataFrame:
    return terms(professions.filter(F.col("source") == OFFICIAL))


