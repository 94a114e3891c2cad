"""Ranking, titles, coverage and gates."""

import re
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tamarix import api
from tamarix.operators import quality
from tamarix.sources.index_store import SearchIndex, expire, publish
from tamarix.sources.schemas import MATCH

KIND = f"uuid string, url string, listing_title string, search_title string, administration string, job_name string, grade string, specialties array<string>, positions int, publication_date string, deadline string, profession_matches array<{MATCH}>, related_profession_matches array<{MATCH}>"
NOW = datetime(2026, 8, 20, 12)


def match(pid="a.b", score=100.0, confidence="EXACT", searchable=True, field="job_name", value="v", label="Label"):
    return (pid, label, "s", "f", [], "market", score, confidence, searchable, (field, value, "t", score))


def row(uuid, matches=(), name="", grade="", specialties=(), title="L", published="2026-08-20T00:00:00", deadline="2026-09-20T00:00:00", positions=1):
    return (uuid, "u", title, "S", "adm", name, grade, list(specialties), positions, published, deadline, list(matches), [])


def index(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_ranking(spark):
    i = index(
        spark,
        [
            row("1", [match()]), row("2", [match(score=94.0, confidence="STRONG")], published="2026-08-05T00:00:00", deadline="2026-08-01T00:00:00"), row("3", [match(searchable=False)]), row("4", [match(score=80.0, confidence=None)]),
            row("5", [match(score=92.0, confidence=None, searchable=None)]), row("6", [match(confidence="RELATED")]), row("7", [match("x.y")]), row("8", [match()], published="", deadline="never"), row("0", [match()]),
        ],
    )
    got = api.search_by_profession(i, "a.b", now=NOW)
    assert [(r["uuid"], r["score"]) for r in got] == [("0", 100.0), ("1", 100.0), ("5", 93.44), ("8", 87.0), ("2", 82.08)]
    assert len(api.search_by_profession(i, "a.b", limit=2, now=NOW)) == 2
    assert api.search_by_profession(i, "none", now=NOW) == []


def test_titles(spark):
    i = index(spark, [row("1", [match(field="context_rule")]), row("2", [match(field="context_rule")], name=" Nom "), row("3", [match(field="specialty")], title="")])
    got = {r["uuid"]: (r["title"], r["source_title"]) for r in api.search_by_profession(i, "a.b", now=NOW)}
    assert got == {"1": ("Label", "L"), "2": ("Nom", "L"), "3": ("S", "S")}


def test_coverage(spark):
    grade = "Technicien de 3ème grade - échelle 9"
    c = api.evaluate_classifiable_coverage(index(spark, [row("1", [match()], "Comptable"), row("2", grade=grade), row("3", name="Agents d’exécution")]), 90)
    assert (c["raw_classification_coverage_pct"], c["classifiable_coverage_pct"], c["gate"], c["structurally_ambiguous_jobs"]) == (33.33, 100.0, True, 2)
    c = api.evaluate_classifiable_coverage(index(spark, [row("1", [match()], "Comptable"), row("2", name="Inconnu")]), 90)
    assert (c["classifiable_coverage_pct"], c["gate"], len(c["unexplained_unclassified_rows"])) == (50.0, False, 1)
    c = api.evaluate_classifiable_coverage(index(spark, [row("1", [match()], grade=grade)]), 0)
    assert not c["gate"] and c["ambiguous_classified_jobs"] == 1
    assert api.evaluate_classifiable_coverage(index(spark, []), 90)["gate"]


def test_ambiguity(spark):
    why = lambda **k: api.structural_ambiguity_reasons(spark, k)
    assert why(grade="Administrateur 2ème grade") == ["generic_public_grade_without_specialty"]
    assert why(grade="Administrateur 2ème grade", specialties=["x"]) == [] and why(grade="Administrateur 2ème grade", job_name="y") == []
    assert why(job_name="ِAgents de maîtrise") == ["generic_aggregate_job_name"]
    assert why() == []


def test_safety_and_expectations(spark):
    i = index(spark, [row("1", [match(), match("c.d", 80.0, "RELATED", False)]), row("2", [match("e.f", 93.0, "STRONG")])])
    bad = api.audit_index(i)
    assert bad["unsafe_matches"] == 1 and bad["rows"][0]["profession_id"] == "c.d"
    e = spark.createDataFrame([Row(uuid="1", required=["a.b", "z"], forbidden=["c.d"]), Row(uuid="2", required=["e.f"], forbidden=["q"]), Row(uuid="9", required=["x"], forbidden=["q"])])
    got = {r["uuid"]: (r["pass"], r["present"], r["missing"], r["leaked"]) for r in quality.expectation_audit(i, e).collect()}
    assert got == {"1": (False, True, ["z"], ["c.d"]), "2": (True, True, [], []), "9": (True, False, None, None)}


def test_semantic_failures(spark):
    rows = [
        row("1", [match("edu.prof_universitaire"), match("x.y")], grade="Maître de conférences"), row("2", [match("x.y")], name="Formateur en génie"), row("3", [match("industry.responsable_hse"), match("industry.qualite")], name="Responsable HSE"),
        row("4", [match("a.b"), match("c.d", field="specialty")], name="Nom"), row("5", [match("a.b", field="listing_role", value="Chef Agence X")]), row("6", [match("a.b")], name="Nom"), row("7", []),
    ]
    got = {}
    for r in quality.semantic_failures(index(spark, rows)).collect():
        got.setdefault(r["uuid"], set()).add(r["type"])
    assert got == {
        "1": {"academic_role_leak"}, "2": {"trainer_role_leak"}, "3": {"explicit_role_mismatch", "generic_specific_duplicate"}, "4": {"explicit_title_specialty_competition"}, "5": {"listing_role_entity_contamination"},
    }


def test_index_files(spark, tmp_path):
    i = index(spark, [row("1", [match()])])
    envelope = publish(i, str(tmp_path / "i"), source="here", generated_at="2026-08-20T12:00:00")
    got = SearchIndex(spark, str(tmp_path / "i"))
    assert got.jobs().select(i.columns).collect() == i.collect()
    assert got.envelope == {k: v for k, v in envelope.items() if k != "parts"} == {"version": 2, "generated_at": "2026-08-20T12:00:00", "source": "here", "classification_policy": "exact_and_strong_only", "number": 0}


def test_a_search_reads_its_bucket(spark, tmp_path):
    rows = [row(str(n), [match(f"p.{n % 40}"), match("hot", score=95.0), match(f"p.{n % 40}", score=1.0)], published=f"2026-08-{1 + n % 20:02}T00:00:00") for n in range(300)]
    i, path = index(spark, rows), str(tmp_path / "i")
    publish(i, path)
    stored = SearchIndex(spark, path)
    for profession in ("p.0", "p.39", "hot", "none"):
        want = api.search_by_profession(i, profession, 7, NOW)
        found = stored.search(profession, api.local_now(NOW), 7)
        assert api.rows_of(found) == want and (want or profession == "none")
    plan = stored.postings("p.3")._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)
    assert "bucket" in filters[1] and "EqualTo(profession_id,p.3)" in filters[2]
    assert stored.postings("p.3").select(F.input_file_name()).distinct().count() == 1


def test_a_build_that_fails_leaves_the_index(spark, tmp_path):
    path = str(tmp_path / "i")
    publish(index(spark, [row("1", [match()])]), path, 0)
    publish(index(spark, [row("2", [match()])]), path, 1, buckets=8)
    before = SearchIndex(spark, path)
    broken = index(spark, [row("3", [match()]), row("4")]).withColumn("uuid", F.when(F.col("uuid") == "4", F.raise_error(F.lit("broken"))).otherwise(F.col("uuid")))
    with pytest.raises(Exception, match="broken"):
        publish(broken, path, 1)
    now = SearchIndex(spark, path)
    uuids = lambda x: sorted(r["uuid"] for r in x.jobs().collect())
    assert now.manifest == before.manifest and uuids(now) == ["1", "2"]
    publish(index(spark, [row("5", [match()])]), path, 1)  # the batch again
    after = SearchIndex(spark, path)
    assert uuids(after) == ["1", "5"] and uuids(before) == ["1", "2"]
    assert sorted(r["uuid"] for r in after.search("a.b", api.local_now(NOW)).collect()) == ["1", "5"]
    assert expire(spark, path) == 2 and uuids(SearchIndex(spark, path)) == ["1", "5"] and expire(spark, path) == 0


def test_two_builds_at_once(spark, tmp_path, monkeypatch):
    """A build that finds its number taken is added to the other one."""
    from tamarix.sources import index_store

    path, calls = str(tmp_path / "i"), []
    publish(index(spark, [row("1")]), path, 0)
    write = index_store._Files.write_new

    def late(self, name, text):
        if not calls:
            calls.append(name)
            publish(index(spark, [row("2")]), path, 1)
        return write(self, name, text)

    monkeypatch.setattr(index_store._Files, "write_new", late)
    assert publish(index(spark, [row("3")]), path, 2)["number"] == 2
    assert sorted(r["uuid"] for r in SearchIndex(spark, path).jobs().collect()) == ["1", "2", "3"]
