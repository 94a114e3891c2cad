"""The entry module with and without the corpus operators; command line; stream."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

from professions import market_json, official_json

from tamarix import catalogue, cli
from tamarix.functions import fixed_values as V
from tamarix.sources.files import read_jobs
from tamarix.sources.index_store import SearchIndex, publish
from tamarix.sources.schemas import JOB
from tamarix.streaming.announcements import index_stream

ROOT = Path(__file__).resolve().parents[1]


def test_without_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the two parts are gone."""
    shutil.copytree(ROOT / "tamarix", tmp_path / "tamarix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=100, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False"], out.stderr[-500:]


def test_nothing_else_imports_them():
    for f in (ROOT / "tamarix").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(encoding="utf-8"), f


def taxonomy_dir(d):
    (d / "market_professions.json").write_text(json.dumps(market_json(), ensure_ascii=False), encoding="utf-8")
    (d / "nap2014_professions.json").write_text(json.dumps(official_json(), ensure_ascii=False), encoding="utf-8")
    (d / "context_rules.json").write_text(json.dumps({"rules": list(V.CONTEXT_RULES)}, ensure_ascii=False), encoding="utf-8")
    return str(d)


JOBS = [{"uuid": str(i), "url": "u", "job_name": n, "publication_date": "2026-08-04T00:00:00", "deadline": "2026-09-04T00:00:00", "positions": 2, "specialties": []} for i, n in enumerate(("Comptable", "Infirmier", "Inconnu"))]


def test_command_line(spark, tmp_path, capsys):
    tax = taxonomy_dir(tmp_path)
    (tmp_path / "jobs.json").write_text(json.dumps(JOBS), encoding="utf-8")
    run = lambda *a: cli.run(spark, cli.parser().parse_args(a))
    index = str(tmp_path / "index")
    assert run("build-index", "--input", str(tmp_path / "jobs.json"), "--taxonomy", tax, "--output", index, "--min-coverage", "60") == 0
    assert run("audit-index", "--index", index, "--min-coverage", "90") == 1
    capsys.readouterr()
    assert run("search", "Infirmier", "--taxonomy", tax, "--index", index) == 0
    assert [r["uuid"] for r in json.loads(capsys.readouterr().out)["results"]] == ["1"]
    assert run("search", "technicien", "--taxonomy", tax, "--index", index) == 3
    assert run("suggest", "compta", "--taxonomy", tax) == 0 and run("diploma", "licence en comptabilité", "--taxonomy", tax) == 0
    assert run("audit-index", "--index", str(tmp_path / "none")) == 2
    reports = tmp_path / "index-reports"
    assert json.loads((reports / "taxonomy_audit.json").read_text(encoding="utf-8"))["jobs"] == 3
    assert read_jobs(spark, str(reports / "unclassified_jobs")).count() == read_jobs(spark, str(reports / "unexplained_unclassified_jobs")).count() == 1
    assert run("autocomplete", "--taxonomy", tax, "--output", str(tmp_path / "auto.json")) == 0
    assert json.loads((tmp_path / "auto.json").read_text(encoding="utf-8"))["market_count"] > 50
    assert run("classifiability", "--index", index, "--min-coverage", "60") == 0 and run("classifiability", "--index", index) == 1
    (tmp_path / "expected.json").write_text(json.dumps([{"uuid": "0", "required": ["finance.comptable"], "forbidden": []}, {"uuid": "gone", "required": ["x"], "forbidden": []}]), encoding="utf-8")
    assert run("expectations", "--index", index, "--expected", str(tmp_path / "expected.json")) == 0
    (tmp_path / "expected.json").write_text(json.dumps([{"uuid": "0", "required": [], "forbidden": ["finance.comptable"]}]), encoding="utf-8")
    assert run("expectations", "--index", index, "--expected", str(tmp_path / "expected.json")) == 1
    capsys.readouterr()
    code = run("precision", "--taxonomy", tax, "--index", index, "--output", str(tmp_path / "precision.json"))
    report = json.loads(capsys.readouterr().out)
    assert report == json.loads((tmp_path / "precision.json").read_text(encoding="utf-8"))
    assert len(report["golden"]["cases"]) == 13 and code == int(report["golden"]["failed"] > 0) and report["golden"]["passed"] >= 12, report
    code = run("suggestions", "--taxonomy", tax)
    report = json.loads(capsys.readouterr().out)
    assert len(report["cases"]) == 11 and code == int(report["failures"] > 0) and report["failures"] <= 3, [c for c in report["cases"] if not c["pass"]]


def test_rules_come_from_the_directory(spark, tmp_path):
    from tamarix.api import Taxonomy

    directory = taxonomy_dir(tmp_path)
    assert Taxonomy(spark, directory).rules == tuple(V.CONTEXT_RULES)
    job = {"grade": "Technicien", "specialties": ["Génie civil"]}
    assert [m["evidence"]["field"] for m in Taxonomy(spark, directory).classify_job(job)] == ["context_rule"]
    (tmp_path / "context_rules.json").unlink()
    bare = Taxonomy(spark, directory)
    assert bare.rules == () and "context_rule" not in [m["evidence"]["field"] for m in bare.classify_job(job)]


def test_the_first_of_equal_rules_counts(spark):
    from tamarix import demo
    from tamarix.operators import matching
    from tamarix.sources.schemas import as_jobs

    rules = [{"id": i, "profession_id": "finance.comptable", "grade_any": ["chef"]} for i in ("b", "a", "c")] + [{"id": "d", "profession_id": "finance.comptable", "grade_any": ["chef"], "score": 98.0}]
    jobs = as_jobs(spark.createDataFrame([("1", "Chef")], "uuid string, grade string"))
    assert [r["match"]["evidence"]["value"] for r in matching.context_matches(jobs, demo.taxonomy(spark), rules).collect()] == ["b"]


def test_days_prune(spark, tmp_path):
    rows = [("1", "2026-08-01T00:00:00"), ("2", "2026-08-05T00:00:00"), ("3", None)]
    publish(spark.createDataFrame(rows, "uuid string, publication_date string"), str(tmp_path / "i"))
    recent = SearchIndex(spark, str(tmp_path / "i")).jobs(since="2026-08-03")
    assert [r["uuid"] for r in recent.collect()] == ["2"] and "PartitionFilters: [isnotnull(publication_day" in recent._jdf.queryExecution().executedPlan().toString()


def test_stream(spark, tmp_path):
    from tamarix.api import Taxonomy

    tax = Taxonomy(spark, taxonomy_dir(tmp_path))
    landed = tmp_path / "landed"
    landed.mkdir()
    (landed / "1.json").write_text("\n".join(json.dumps(j) for j in [*JOBS, JOBS[0]]), encoding="utf-8")
    go = lambda: index_stream(spark.readStream.schema(JOB).json(str(landed)), tax.professions, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    (landed / "2.json").write_text("\n".join(json.dumps(j) for j in [JOBS[1], JOBS[0] | {"uuid": "new"}]), encoding="utf-8")
    go()
    (tmp_path / "cp" / "commits" / "1").unlink()  # as if the last batch had failed at its end: it is run again
    (tmp_path / "cp" / "commits" / ".1.crc").unlink(missing_ok=True)
    go()
    got = sorted((r["uuid"], tuple(r["profession_ids"])) for r in SearchIndex(spark, str(tmp_path / "out")).jobs().collect())
    assert got == [("0", ("finance.comptable",)), ("1", ("health.infirmier",)), ("2", ()), ("new", ("finance.comptable",))]
