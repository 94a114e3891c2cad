"""Which of a job's matches stand: overrides, replacements, pruning.

A job's matches are one short array, so each policy is an expression over it and
no join; the policy tables are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import development_track, has_any_phrase, norm, once, text, tokens, with_listing_role
from ..sources.files import MARKET
from . import matching
from .taxonomy import terms

MOST_MATCHES = 8


def ids(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["profession_id"])


def without(matches: Column, dropped: Column) -> Column:
    return F.filter(matches, lambda m: ~F.array_contains(dropped, m["profession_id"]))


def override(matches: Column, role: Column, markers: tuple[str, ...], profession_id: str) -> Column:
    """Only this profession's match, if the role has a marker and it is there;
    else null."""
    own = F.filter(matches, lambda m: m["profession_id"] == profession_id)
    return F.when(has_any_phrase(role, markers) & (F.size(own) > 0), own)


def title_authority(matches: Column, job_name: Column) -> Column:
    """Matches by title (and by rules) only, if the title has one."""
    by = lambda m, f: m["evidence"]["field"] == f
    decided = (F.trim(job_name) != "") & F.exists(matches, lambda m: by(m, "job_name"))
    return F.when(decided, F.filter(matches, lambda m: by(m, "job_name") | by(m, "context_rule"))).otherwise(matches)


def technician_semantics(matches: Column, present: Column, role: Column, tracks: Column) -> Column:
    """present: the ids of matches; role, tracks: normalised name and grade, and
    specialties."""
    has = lambda i: F.array_contains(present, i)
    independent = F.exists(tracks, lambda s: F.contains(s, F.lit("informatique")) & ~development_track(s))
    pairs = [F.when(has(a), F.lit(b)) for a, b in V.TECHNICIAN_REPLACES] + [F.when(has(V.DEVELOPER_TECHNICIAN) & ~independent, F.lit(V.IT_TECHNICIAN))]
    dropped = F.when(F.contains(role, F.lit("technicien")), F.array_compact(F.array(*pairs))).otherwise(F.array(*map(F.lit, V.TECHNICIAN_ONLY)))
    return without(matches, dropped)


def dominated(present: Column) -> Column:
    """Of these ids the ones that a more specific profession replaces."""
    return F.array_compact(F.array(*[F.when(F.array_contains(present, s), F.lit(g)) for s, g in V.DOMINANCE]))


def narrower_titles(matches: Column) -> Column:
    """ids matched by a term whose words are a part of another's, for the same
    title and with no higher score."""
    return _narrower(title_rows(matches))


def title_rows(matches: Column) -> Column:
    """id, title, words and score of the matches by title."""
    own = lambda m: F.array_distinct(tokens(norm(m["evidence"]["matched_term"])))
    titled = F.filter(matches, lambda m: m["evidence"]["field"] == "job_name")
    return F.transform(titled, lambda m: F.struct(m["profession_id"].alias("id"), norm(m["evidence"]["value"]).alias("title"), own(m).alias("words"), m["score"].alias("score")))


def _narrower(rows: Column) -> Column:
    wider = lambda a, b: (a["title"] == b["title"]) & (F.size(a["words"]) > 0) & (F.size(a["words"]) < F.size(b["words"])) & (F.size(F.array_except(a["words"], b["words"])) == 0) & (b["score"] >= a["score"])
    return F.transform(F.filter(rows, lambda a: F.exists(rows, lambda b: wider(a, b))), lambda a: a["id"])


def with_role(jobs: DataFrame) -> DataFrame:
    """jobs with what the policies look at: po_whole (name, grade and listing
    role), po_role (name and grade), po_tracks (specialties), all normalised."""
    j = with_listing_role(jobs, "listing_title", "po_listing")
    tracks = F.transform(F.coalesce("specialties", F.array().cast("array<string>")), norm)
    return j.withColumns({"po_whole": norm(F.concat_ws(" ", text("job_name"), text("grade"), "po_listing")), "po_role": norm(F.concat_ws(" ", text("job_name"), text("grade"))), "po_tracks": tracks}).drop("po_listing")


def decided(jobs: DataFrame) -> DataFrame:
    """jobs whose `matches` are what all policies leave. Each policy is a column
    of its own, so that it is worked out once."""
    m, whole = F.col("matches"), F.col("po_whole")
    j = with_role(jobs).withColumn("po_first", F.coalesce(override(m, whole, V.ACADEMIC_MARKERS, V.ACADEMIC_ID), override(m, whole, V.TRAINER_MARKERS, V.TRAINER_ID)))
    j = j.withColumn("po_left", title_authority(m, text("job_name")))
    j = j.withColumn("po_ids", ids(F.col("po_left")))
    j = j.withColumn("po_left", technician_semantics(F.col("po_left"), F.col("po_ids"), F.col("po_role"), F.col("po_tracks")))
    j = j.withColumn("po_ids", ids(F.col("po_left"))).withColumn("po_titles", title_rows(F.col("po_left")))
    j = j.withColumn("po_gone", F.array_union(dominated(F.col("po_ids")), _narrower(F.col("po_titles"))))
    out = F.coalesce("po_first", without(F.col("po_left"), F.col("po_gone")))
    return j.withColumn("matches", out).drop(*[f"po_{x}" for x in ("whole", "role", "tracks", "first", "left", "ids", "titles", "gone")])


def found_matches(jobs: DataFrame, professions: DataFrame, rules=V.CONTEXT_RULES, hints: bool = False) -> DataFrame:
    """jobs with `matches` of the rules and the market, else null, then
    `official_matches`, if there are no such, and with hints `related`. All are
    found in one pass over the evidence and come together by one shuffle."""
    scores = {"strict": matching.strict_score()} | ({"related": matching.related_score()} if hints else {})
    best = matching.best(matching.evidence(jobs), terms(professions), **scores)
    s, market = F.col("strict"), F.lit(MARKET)
    kinds = {
        "market": (s["source"] == market) & (s["weighted"] >= V.STRICT_MINIMUM), "official": (s["source"] != market) & (s["weighted"] >= V.OFFICIAL_MINIMUM),
    }
    of = [F.when(on, F.struct(F.lit(k).alias("kind"), matching.as_match(s).alias("match"))) for k, on in kinds.items()]
    if hints:
        r = F.col("related")
        near = (r["source"] == market) & r["weighted"].between(V.RELATED_MINIMUM, V.RELATED_MAXIMUM)
        of.append(F.when(near, F.struct(F.lit("related").alias("kind"), matching.as_match(r, False).alias("match"))))
    rows = best.select("uuid", F.explode(F.array_compact(F.array(*of))).alias("of"))
    ruled = matching.context_matches(jobs, professions, rules).select("uuid", F.struct(F.lit("rule").alias("kind"), "match").alias("of"))
    every = rows.unionByName(ruled).groupBy("uuid").agg(F.collect_list("of").alias("of"))
    j = jobs.join(every, "uuid", "left").withColumn("of", F.coalesce("of", F.array().cast(every.schema["of"].dataType)))
    kind = lambda k: F.transform(F.filter("of", lambda x: x["kind"] == k), lambda x: x["match"])
    j = j.withColumns({f"of_{k}": kind(k) for k in ("rule", "market", "official", *["related"] * hints)})
    same = lambda a, b: a["profession_id"] == b["profession_id"]
    # of each profession the higher score, the rule's on a tie
    by_rule = F.filter("of_rule", lambda a: ~F.exists("of_market", lambda b: same(a, b) & (b["score"] > a["score"])))
    by_term = F.filter("of_market", lambda a: ~F.exists("of_rule", lambda b: same(a, b) & (b["score"] >= a["score"])))
    j = j.withColumn("matches", matching.in_order(F.concat(by_rule, by_term)))
    j = j.withColumn("official_matches", F.when(F.size("matches") == 0, matching.in_order(F.col("of_official")))).withColumn("matches", F.when(F.size("matches") > 0, F.col("matches")))
    if hints:
        j = j.withColumn("related", matching.in_order(F.col("of_related")))
    return j.drop("of", "of_rule", "of_market", "of_official", "of_related")


def classify_jobs(jobs: DataFrame, professions: DataFrame, rules=V.CONTEXT_RULES, most: int = MOST_MATCHES, hints: bool = False) -> DataFrame:
    """jobs with profession_matches and, with hints, related_profession_matches.
    The official nomenclature counts for jobs without any market candidate,
    whatever the policies leave."""
    j = found_matches(jobs, professions, rules, hints)
    none = F.array().cast(j.schema["matches"].dataType)
    kept = F.coalesce("matches", "official_matches", none)  # policies leave null null
    j = decided(j).withColumn("profession_matches", once(F.slice(kept, 1, most)))
    if hints:
        left = without(F.col("related"), ids(F.col("profession_matches")))
        j = j.withColumn("related_profession_matches", once(F.slice(left, 1, most)))
    return j.drop("matches", "official_matches", "related")


def related_hints(jobs: DataFrame, professions: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """jobs (with profession_matches) with related_profession_matches."""
    found = matching.classify(matching.evidence(jobs), matching.market_terms(professions), matching.related_score(), V.RELATED_MINIMUM, V.RELATED_MAXIMUM, searchable=False)
    hints = matching.sorted_matches(found)
    none = F.array().cast(hints.schema["matches"].dataType)
    j = jobs.join(hints, "uuid", "left")
    left = without(F.coalesce("matches", none), ids(F.col("profession_matches")))
    return j.withColumn("related_profession_matches", once(F.slice(left, 1, most))).drop("matches")


