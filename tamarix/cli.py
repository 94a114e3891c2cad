"""Command line. Exit codes: 0 passed, 1 a gate failed, 2 an input is missing or
the site's policy forbids reading it, 3 the query is ambiguous.

audit           read the site, write its announcements and the completeness audit
build-index     classify announcements, write the index and its reports
search, suggest, diploma, autocomplete
audit-index     coverage, safety and semantics of an index
classifiability coverage of what can be classified, with the rows that aren't
precision       the golden cases and the index's safety
suggestions     the suggestion cases
expectations    expected professions by uuid (a JSON array) against an index
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import fixed_values as V
from .operators import quality
from .plans import audit as audit_plan
from .plans import index as index_plan
from .sources import files, index_store


def show(x) -> None:
    print(json.dumps(x, ensure_ascii=False, indent=2, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tamarix", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for n in needed:
            c.add_argument(f"--{n}", required=True)
        return c

    a = command("audit", "base-url", "output")
    a.add_argument("--scopes", default=",".join(V.SCOPES))
    a.add_argument("--pause", type=float, default=0.05)
    a.add_argument("--rate", type=float, default=0.0, help="requests a second of all tasks together")
    a.add_argument("--run", help="name of the run, to go on with it after a failure")
    a.add_argument("--no-gate", action="store_true")
    b = command("build-index", "input", "taxonomy", "output")
    b.add_argument("--min-coverage", type=float, default=0.0)
    b.add_argument("--source")
    for name in ("search", "suggest", "diploma"):
        s = command(name, "taxonomy", *["index"] * (name == "search"))
        s.add_argument("query")
        s.add_argument("--limit", type=int, default=20 if name == "search" else 10)
    command("autocomplete", "taxonomy", "output")
    for name in ("audit-index", "classifiability"):
        command(name, "index").add_argument("--min-coverage", type=float, default=90.0)
    c = command("precision", "taxonomy")
    c.add_argument("--index")
    c.add_argument("--output")
    command("suggestions", "taxonomy")
    command("expectations", "index", "expected")
    return p


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    out = args.output
    allowed, note = api.robots_allows(args.base_url, pause=args.pause)
    if not allowed:
        report = {"robots_allowed": False, "robots_note": note, "gate": False, "reason": "robots_disallow_or_unavailable"}
        files.write_report(spark, report, f"{out}/audit.json")
        show(report)
        return 2
    now = api.local_now()
    site = audit_plan.crawl_site(spark, args.base_url, f"{out}/landed", tuple(args.scopes.split(",")), rate=args.rate, run=args.run, pause=args.pause)
    found = audit_plan.verified(*site, now)
    for name, table in (("jobs", "accepted"), ("all_announcements", "jobs"), ("rejected", "rejected"), ("detail_failures", "failures"), ("retired_detail_redirects", "retired")):
        files.write_json(found[table], f"{out}/{name}")
    report = found["audit"].first().asDict() | {"robots_note": note, "scopes": api.rows_of(found["scopes"]), "decision_counts": {r["decision"]: r["n"] for r in found["decisions"].collect()}}
    files.write_report(spark, report, f"{out}/audit.json")
    show(report)
    return int(not (report["gate"] or args.no_gate))


def build_index(spark: SparkSession, args: argparse.Namespace, taxonomy: api.Taxonomy) -> int:
    out = args.output
    envelope = index_store.publish(taxonomy.build_index(files.read_jobs(spark, args.input)), out, source=args.source or args.input, generated_at=datetime.now(api.ZONE).isoformat())
    index = index_store.SearchIndex(spark, out).jobs()
    report = {k: envelope[k] for k in ("source", "generated_at", "classification_policy")} | index_plan.index_report(index, taxonomy.professions, args.min_coverage).first().asDict()
    reports = f"{out.rstrip('/')}-reports"
    files.write_report(spark, report, f"{reports}/taxonomy_audit.json")
    files.write_report(spark, taxonomy.autocomplete_payload(), f"{reports}/autocomplete.json")
    files.write_json(index.filter(F.size("profession_matches") == 0).select("uuid", "url", "listing_title", "job_name", "grade", "specialties", "positions"), f"{reports}/unclassified_jobs")
    for name, rows in zip(("structurally_ambiguous_jobs", "unexplained_unclassified_jobs", "ambiguous_classified_jobs"), quality.coverage_rows(index), strict=True):
        files.write_json(rows, f"{reports}/{name}")
    show(report)
    return int(not report["gate"])


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    try:
        return _run(spark, args)
    except AnalysisException as e:
        print(f"missing input: {e.getCondition()}", file=sys.stderr)
        return 2


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    command = args.command
    if command == "audit":
        return audit(spark, args)
    stored = index_store.SearchIndex(spark, args.index) if getattr(args, "index", None) else None
    index = stored.jobs() if stored is not None else None
    taxonomy = api.Taxonomy(spark, args.taxonomy) if hasattr(args, "taxonomy") else None
    if command == "audit-index":
        found = {"coverage": quality.coverage(index, args.min_coverage).first().asDict(), "safety": api.audit_index(index)}
        kinds = {"semantic": quality.semantic_failures, "public_grade": quality.public_grade_failures, "specificity": quality.specificity_failures}
        found |= {k: api.rows_of(f(index).groupBy("type").count()) for k, f in kinds.items()}
        show(found)
        return int(not found["coverage"]["gate"] or bool(found["safety"]["unsafe_matches"]) or any(found[k] for k in kinds))
    if command == "classifiability":
        report = api.evaluate_classifiable_coverage(index, args.min_coverage)
        show(report)
        return int(not report["gate"])
    if command == "expectations":
        expected = spark.read.schema("uuid string, required array<string>, forbidden array<string>").json(args.expected, multiLine=True)
        audited = quality.expectation_audit(index, expected)
        report = quality.expectation_report(audited).first().asDict() | {"failed": api.rows_of(audited.filter(~F.col("pass")).orderBy("uuid").limit(100))}
        show(report)
        return int(not report["gate"])
    if command == "build-index":
        return build_index(spark, args, taxonomy)
    if command == "precision":
        report = {"golden": api.run_golden_audit(taxonomy)} | ({"index": api.audit_index(index)} if index is not None else {})
        report["gate"] = not report["golden"]["failed"] and not (index is not None and report["index"]["unsafe_matches"])
        if args.output:
            files.write_report(spark, report, args.output)
        show(report)
        return int(not report["gate"])
    if command == "suggestions":
        report = api.run_suggestion_audit(taxonomy)
        show(report)
        return int(report["failures"] > 0)
    if command == "autocomplete":
        files.write_report(spark, taxonomy.autocomplete_payload(), args.output)
    elif command == "suggest":
        show(taxonomy.autocomplete(args.query, args.limit))
    elif command == "diploma":
        show(taxonomy.diploma_professions(args.query))
    else:
        profession, some = taxonomy.resolve(args.query)
        if profession is None:
            show({"status": "selection_required", "suggestions": some})
            return 3
        found = api.rows_of(stored.search(profession, api.local_now(), args.limit))
        named = taxonomy.profession(profession) or {}
        show({"profession_id": profession, "profession": {"profession_id": profession} | {k: named.get(k) or ("" if k != "label" else profession) for k in ("label", "sector", "family")}, "count": len(found), "results": found})
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tamarix").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
