"""Gates over the index: coverage, ambiguity, safety, semantics, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import audit_norm, classifiability_norm, development_track, has_phrase, norm_text, text
from ..sources.files import MARKET
from .policy import ids


def given(specialties: Column | str = "specialties") -> Column:
    return F.coalesce(specialties, F.array().cast("array<string>"))


def ambiguity_reasons() -> Column:
    """Over a job's columns: why nothing in it can name a profession."""
    name, grade = classifiability_norm("job_name"), classifiability_norm("grade")
    bare = F.size(F.filter(F.transform(given(), classifiability_norm), lambda s: s != "")) == 0
    generic = F.lit(False)
    for pattern in V.GENERIC_GRADES:
        generic = generic | grade.rlike(f"^(?:{pattern})$")
    return F.array_compact(
        F.array(F.when(bare & (name == "") & generic, F.lit("generic_public_grade_without_specialty")), F.when(bare & name.isin(*V.GENERIC_JOB_NAMES), F.lit("generic_aggregate_job_name")))
    )


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 100.0).otherwise(F.bround(part / whole * 100, 2))


def with_states(index: DataFrame) -> DataFrame:
    """index rows with reasons, matched, ambiguous."""
    return index.withColumn("reasons", ambiguity_reasons()).withColumn("matched", F.size(F.coalesce("profession_matches", F.array().cast(index.schema["profession_matches"].dataType))) > 0).withColumn("ambiguous", F.size("reasons") > 0)


def coverage(index: DataFrame, minimum: float = 90.0) -> DataFrame:
    """One row of counts, percentages and the gate."""
    m, a = F.col("matched"), F.col("ambiguous")
    row = with_states(index).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(m).alias("classified_jobs"), F.count_if(~m).alias("unclassified_jobs"), F.count_if(a).alias("structurally_ambiguous_jobs"),
        F.count_if(~a).alias("classifiable_jobs"), F.count_if(~a & m).alias("classified_classifiable_jobs"), F.count_if(~a & ~m).alias("unexplained_unclassified_jobs"), F.count_if(a & m).alias("ambiguous_classified_jobs"),
    )
    row = row.withColumn("raw_classification_coverage_pct", percent(F.col("classified_jobs"), F.col("jobs"))).withColumn("classifiable_coverage_pct", percent(F.col("classified_classifiable_jobs"), F.col("classifiable_jobs")))
    return row.withColumn("minimum_required_pct", F.lit(minimum)).withColumn("gate", (F.col("classifiable_coverage_pct") >= minimum) & (F.col("ambiguous_classified_jobs") == 0))


def coverage_rows(index: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(structurally ambiguous, unexplained unclassified, ambiguous classified)."""
    s = with_states(index)
    rows = lambda on: s.filter(on).select("uuid", "url", "listing_title", "job_name", "grade", given().alias("specialties"), F.coalesce("positions", F.lit(0)).alias("positions"), "reasons", ids(F.col("profession_matches")).alias("profession_ids"))
    return rows("ambiguous"), rows("not ambiguous and not matched"), rows("ambiguous and matched")


def index_counters(index: DataFrame) -> DataFrame:
    """One row: how jobs and positions were classified."""
    m = F.col("profession_matches")
    some, exact, own = F.size(m) > 0, F.exists(m, lambda x: x["confidence"] == "EXACT"), F.exists(m, lambda x: x["source"] == MARKET)
    places = F.coalesce("positions", F.lit(0))
    row = index.agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(some).alias("classified_jobs"), F.count_if(some & exact).alias("exact_jobs"), F.count_if(some & ~exact).alias("strong_jobs"), F.count_if(some & own).alias("market_classified_jobs"),
        F.count_if(some & ~own).alias("official_fallback_jobs"), F.count_if(~some & (F.size("related_profession_matches") > 0)).alias("related_only_jobs"), F.coalesce(F.sum(places), F.lit(0)).cast("long").alias("positions"),
        F.coalesce(F.sum(F.when(some, places)), F.lit(0)).cast("long").alias("classified_positions"),
    )
    return row.withColumn("position_coverage_pct", percent(F.col("classified_positions"), F.col("positions")))


def golden_audit(cases: DataFrame) -> DataFrame:
    """cases (name, actual, must_include, must_exclude, allowed_ids and
    confidences) with what is wrong and `pass`."""
    allowed = F.when(F.size(F.coalesce("allowed_ids", F.array().cast("array<string>"))) > 0, F.col("allowed_ids")).otherwise(F.col("must_include"))
    c = cases.withColumns(
        {
            "missing": F.array_sort(F.array_except("must_include", "actual")), "forbidden": F.array_sort(F.array_intersect("actual", "must_exclude")), "unexpected": F.array_sort(F.array_except("actual", allowed)),
            "low_confidence": F.filter("confidences", lambda x: ~x.isin("EXACT", "STRONG")),
        }
    )
    return c.withColumn("pass", (F.size("missing") + F.size("forbidden") + F.size("unexpected") + F.size("low_confidence")) == 0)


def unsafe_matches(index: DataFrame) -> DataFrame:
    """Matches that search must not show."""
    each = index.select("uuid", F.explode("profession_matches").alias("m"))
    bad = ~F.coalesce(F.col("m.searchable"), F.lit(False)) | F.coalesce(F.col("m.confidence") == "RELATED", F.lit(False)) | (F.coalesce(F.col("m.score"), F.lit(0.0)) < V.STRICT_MINIMUM)
    return each.filter(bad).select("uuid", "m.profession_id", "m.score", "m.confidence", "m.searchable")


def index_safety(index: DataFrame, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """(number of unsafe matches, the first of them)."""
    bad = unsafe_matches(index)
    return bad.agg(F.count(F.lit(1)).alias("unsafe_matches")), bad.orderBy("uuid", "profession_id").limit(shown)


def _failure(on: Column, kind: str, detail: Column | None = None) -> Column:
    return F.when(on, F.struct(F.lit(kind).alias("type"), (detail if detail is not None else F.lit("")).alias("detail")))


def semantic_failures(index: DataFrame) -> DataFrame:
    """uuid, type, detail: what classified jobs break."""
    m = index.filter(F.size("profession_matches") > 0)
    have = F.array_sort(F.array_distinct(ids(F.col("profession_matches"))))
    m = m.withColumn("ids", have).withColumn("role", audit_norm(F.concat_ws(" ", text("job_name"), text("grade"), text("listing_title")))).withColumn("name", audit_norm("job_name"))
    exactly = lambda i: (F.size("ids") == 1) & F.array_contains("ids", i)
    academic, trainer = F.lit(False), F.lit(False)
    for x in V.ACADEMIC_MARKERS:
        academic = academic | F.contains("role", F.lit(norm_text(x)))
    for x in V.TRAINER_MARKERS:
        trainer = trainer | has_phrase(F.col("name"), norm_text(x))
    field = F.transform("profession_matches", lambda x: x["evidence"]["field"])
    traces = lambda v: F.exists(F.array(*map(F.lit, V.EMPLOYER_TRACES)), lambda t: has_phrase(audit_norm(v), t))
    tainted = F.filter("profession_matches", lambda x: (x["evidence"]["field"] == "listing_role") & traces(x["evidence"]["value"]))
    single = F.array(
        _failure(academic & ~exactly(V.ACADEMIC_ID), "academic_role_leak"), _failure(trainer & ~exactly(V.TRAINER_ID), "trainer_role_leak"),
        *[_failure(F.contains("name", F.lit(p)) & ~exactly(i), "explicit_role_mismatch", F.lit(i)) for p, i in V.ROLE_EXPECTATIONS],
        *[_failure(F.array_contains("ids", s) & F.array_contains("ids", g), "generic_specific_duplicate", F.lit(f"{s} {g}")) for s, g in V.DOMINANCE],
        _failure((text("job_name") != "") & F.array_contains(field, "job_name") & F.array_contains(field, "specialty"), "explicit_title_specialty_competition"),
    )
    multi = F.transform(tainted, lambda x: F.struct(F.lit("listing_role_entity_contamination").alias("type"), x["profession_id"].alias("detail")))
    return m.select("uuid", F.explode(F.concat(F.array_compact(single), multi)).alias("f")).select("uuid", "f.type", "f.detail")


def _technician_jobs(index: DataFrame) -> DataFrame:
    t = index.withColumn("tracks", F.transform(given(), audit_norm)).withColumn("ids", ids(F.coalesce("profession_matches", F.array().cast(index.schema["profession_matches"].dataType))))
    return t.filter(F.contains(audit_norm("grade"), F.lit("technicien")))


def public_grade_failures(index: DataFrame) -> DataFrame:
    t = _technician_jobs(index)
    track = lambda p: F.contains(F.array_join("tracks", " | "), F.lit(p))
    has = lambda i: F.array_contains("ids", i)
    dev, farm = track("developpement informatique"), track(V.HORTICULTURE_TRACK)
    wrong = (F.size(F.array_except(F.array(*map(F.lit, V.TECHNICIAN_ONLY)), "ids")) > 0) | (F.size(F.array_intersect("ids", F.array(*map(F.lit, V.HORTICULTURE_FORBIDDEN)))) > 0)
    found = F.array(
        _failure(dev & has("it.developpeur_logiciel"), "TECHNICIEN_BECAME_DEVELOPER"), _failure(dev & ~has(V.DEVELOPER_TECHNICIAN), "MISSING_TECHNICIEN_DEVELOPPEMENT"),
        _failure(farm & wrong, "AGRICULTURE_MULTI_SPECIALTY_SEMANTICS"),
    )
    return t.select("uuid", F.explode(F.array_compact(found)).alias("f")).select("uuid", "f.type")


def specificity_failures(index: DataFrame) -> DataFrame:
    t = _technician_jobs(index).filter(F.exists("tracks", development_track))
    alone = ~F.exists("tracks", lambda s: F.contains(s, F.lit("informatique")) & ~development_track(s))
    parent = F.array_contains("ids", V.IT_TECHNICIAN)
    kind = F.when(alone & parent, "REDUNDANT_GENERIC_IT_PARENT").when(~alone & ~parent, "MISSING_INDEPENDENT_GENERIC_IT_TRACK")
    return t.select("uuid", kind.alias("type")).filter("type is not null")


def expectation_audit(index: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (uuid, required, forbidden) with what is missing and present;
    a uuid that the index doesn't have is no failure."""
    have = index.select("uuid", ids(F.col("profession_matches")).alias("actual"), F.lit(True).alias("present"))
    e = expected.join(have, "uuid", "left").withColumn("present", F.coalesce("present", F.lit(False)))
    e = e.withColumn("missing", F.when(F.col("present"), F.array_sort(F.array_except("required", "actual")))).withColumn("leaked", F.when(F.col("present"), F.array_sort(F.array_intersect("forbidden", "actual"))))
    return e.withColumn("pass", ~F.col("present") | ((F.size("missing") == 0) & (F.size("leaked") == 0)))


def suggestion_audit(suggestions: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (query, top, forbidden, label_prefix, label_part and, optionally,
    required, and first, which must come before `then` if that is there) with
    `pass`."""
    none = F.array().cast("array<string>")
    row = F.struct("rank", "profession_id")
    got = suggestions.groupBy("query").agg(F.min_by("profession_id", "rank").alias("first_id"), F.min_by("label", "rank").alias("first_label"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["profession_id"]).alias("got"))
    kinds = {"required": "array<string>", "first": "array<string>", "then": "string"}
    e = expected.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in expected.columns})
    e = e.join(got, "query", "left").withColumn("got", F.coalesce("got", none))
    label = audit_norm("first_label")
    ok = (F.col("top").isNull() | F.coalesce(F.col("first_id") == F.col("top"), F.lit(False))) & (F.size(F.array_intersect("got", F.coalesce("forbidden", none))) == 0)
    ok = ok & (F.col("label_prefix").isNull() | F.startswith(label, F.col("label_prefix"))) & (F.col("label_part").isNull() | F.contains(label, F.col("label_part")))
    ok = ok & (F.size(F.array_except(F.coalesce("required", none), "got")) == 0)
    late = F.array_position("got", F.col("then"))
    early = F.forall(F.coalesce("first", none), lambda x: (F.array_position("got", x) > 0) & (F.array_position("got", x) < late))
    return e.withColumn("pass", F.coalesce(ok & (F.coalesce(late == 0, F.lit(True)) | early), F.lit(False)))


def expectation_report(audited: DataFrame) -> DataFrame:
    """One row: how many expectations there are, were met, and the gate."""
    row = audited.agg(F.count(F.lit(1)).alias("cases"), F.count_if("present").alias("present"), F.count_if(~F.col("pass")).alias("failures"))
    return row.withColumn("gate", F.col("failures") == 0)
