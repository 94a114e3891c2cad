"""HTML to records, dates, redirects and the crawl's completeness."""

import unicodedata
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tamarix import api, catalogue
from tamarix.functions import dates, text
from tamarix.operators import crawl_audit, extraction
from tamarix.plans.audit import audit
from tamarix.sources import crawl
from tamarix.sources import html as H

U1, U2, U3 = ("/fr/concours/details/" + c * 8 + "-1111-2222-3333-" + c * 12 for c in "abc")
LISTING = f"""<div>42 Résultats</div><a href="{U1}"><b>Un</b> titre</a><a href="{U2}/?x=1">Deux</a><a href="https://x.example{U1}">Dernier</a><a href="/fr/autre">x</a>
<h2>Dernière  chance pour POSTULER</h2><a href="{U3}">hors</a>"""
DETAIL = """<section><h2>Administration qui recrute</h2><h3>Administration qui recrute Ministère de  l'Eau</h3><p>Délai de dépôt des candidatures 19 août 2026 - 16:30</p><p>Date de publication 4 Août 2026</p>
<h4>Date du concours 4 octobre 2026</h4><ul><li>Spécialité :<br>- Génie civil - Informatique<br>- Génie civil</li><li>Nombre de postes : 70</li><li>Grade : Technicien</li></ul>
<p>Site de dépôt : <a href="https://depot.example">ici</a></p></section>"""


def test_listing(spark):
    assert api.parse_official_count(spark, LISTING) == 42
    base = extraction.BASE_URL
    assert api.extract_listing_links(spark, LISTING) == [base + U1, base + U2 + "/"]
    assert api.extract_listing_titles(spark, LISTING)[base + U1] == "Dernier"
    with pytest.raises(ValueError):
        api.parse_official_count(spark, "<p>rien</p>")


def test_detail(spark):
    got = api.parse_detail(spark, DETAIL.replace("<h2>Administration qui recrute</h2>", ""), extraction.BASE_URL + U1.upper().replace("/FR/CONCOURS/DETAILS", "/fr/concours/details"), "collec", "T")
    assert got["administration"] == "Ministère de l'Eau" and got["positions"] == 70
    assert (got["publication_date"], got["deadline"], got["contest_date"]) == ("2026-08-04T00:00:00", "2026-08-19T16:30:00", "2026-10-04T00:00:00")
    assert got["specialties"] == ["Génie civil", "Informatique"] and got["application_site"] == "https://depot.example"
    assert got["uuid"] == U1.rsplit("/", 1)[1]


def test_a_page_is_parsed_once_for_its_links(spark, tmp_path):
    """The rows flow through one Python step, which no filter repeats."""
    odd = ["", None, "<p>no link</p>", "<a>x</a><a href>y</a><a href=''>z</a>", "<A HREF=a?x=1&amp;y=2 href=b />", "<script>'<a href=no>'</script><!-- <a href=no> --><a href='&eacute;'", "<a href=1><a href=2><a href=3>" * 3000, "<a href=é>\x00</a><p><a\nhref = 'q\nr'>"]
    spark.createDataFrame(list(enumerate(odd)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = catalogue.QUERIES["page_links"](spark, str(tmp_path))
    steps = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Arrow" in x]
    assert len(steps) == 1, steps
    parsed = spark.read.parquet(str(tmp_path / "pages.parquet")).select("page_id", F.posexplode(H.page("html")["links"]).alias("pos", "link")).select("page_id", "pos", "link.href")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, parsed.collect())) and found.count() > 9000


def test_a_task_holds_few_links_of_its_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["<a href=x>" * 1000] * 99 + [None])], names=["page_id", "html"])
    sizes = [b.num_rows for b in H._linked(iter([batch]))]
    assert sum(sizes) == 99_000 and max(sizes) < H.LINKS + 1000


def test_similar_announcements_do_not_leak(spark):
    page = DETAIL.replace("<h2>Administration qui recrute</h2>", "").replace("<h4>Date du concours 4 octobre 2026</h4>", "") + "<h2>Concours similaires</h2><h4>Date du concours 1 mai 2027</h4>"
    assert api.parse_detail(spark, page, extraction.BASE_URL + U1, "collec")["contest_date"] is None


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (("<h3>Administration qui recrute Ministère de  l'Eau</h3>", ""), "missing_administration"), (("4 Août 2026", "4 brumaire 2026"), "missing_publication_date"), (("19 août 2026 - 16:30", "bientôt"), "missing_deadline"),
        (("70", "0"), "missing_positions"), (("4 Août 2026", "31 février 2026"), "invalid_calendar_date"),
    ],
)
def test_broken_details(spark, change, error):
    page = DETAIL.replace("<h2>Administration qui recrute</h2>", "").replace(*change)
    with pytest.raises(ValueError, match=error):
        api.parse_detail(spark, page, extraction.BASE_URL + U1, "collec")


def test_dates(spark):
    rows = [("le 3 FÉVRIER 2026 - 9:05",), ("3 fevrier 2026",), ("1 xyz 2026",), ("",), (None,), ("31 avril 2026",)]
    got = spark.createDataFrame(rows, "v string").select(dates.french_datetime("v", True).cast("string").alias("d"), dates.french_date_is_wrong("v").alias("w")).collect()
    assert [r["d"] for r in got] == ["2026-02-03 09:05:00", "2026-02-03 23:59:00", None, None, None, None]
    assert [bool(r["w"]) for r in got] == [False, False, False, False, False, True]


def test_fresh_and_open(spark):
    now = datetime(2026, 8, 20, 12)
    ok = lambda p, d: api.is_fresh_and_open(spark, {"publication_date": p, "deadline": d}, now)[1]
    assert ok("2026-08-05T00:00:00", "2026-08-20T12:00:00") == "accepted"
    assert ok("2026-08-04T23:00:00", "2026-09-20T12:00:00") == "older_than_15_days"
    assert ok("2026-08-21T00:00:00", "2026-08-01T12:00:00") == "publication_in_future"
    assert ok("2026-08-19T00:00:00+00:00", "2026-08-20T11:59:59") == "deadline_expired"
    for wrong in (None, "", "bientôt", "2026-13-01T00:00:00"):
        assert ok(wrong, "2026-08-21T00:00:00") == "unreadable_publication_date"
        assert ok("2026-08-19T00:00:00", wrong) == "unreadable_deadline"


def test_one_value_at_a_time(spark):
    assert api.normalize("L’Ingénieur  C++ (d'État)_x") == "l ingenieur c++ d etat x" and api.tokens("Le niveau d'un C# ingénieur") == ["c#", "ingenieur"]
    at = lambda v, **k: api.parse_french_datetime(spark, v, **k)
    assert at("le 3 août 2026 - 9:05") == datetime(2026, 8, 3, 9, 5) and at("3 AOÛT 2026", end_of_day_if_no_time=True) == datetime(2026, 8, 3, 23, 59) and at("3 brumaire 2026") is None and at("") is None
    with pytest.raises(ValueError, match="date"):
        at("31 février 2026")


def test_normalisers(spark):
    rows = [("Élève_ingénieur d’État (Bac+5) C# \t",), ("ﬁn ŒUVRE Straße",), (None,)]
    df = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in df.select(text.norm("v")).collect()][0] == "eleve ingenieur d etat bac+5 c#"
    exact = [r[0] for r in df.select(text.norm_exact("v")).collect()]
    assert exact[1] == "fin œuvre strasse" and exact[2] == ""
    assert text.norm_text(rows[0][0]) == "eleve ingenieur d etat bac+5 c#"


def test_folding_is_unicodes(spark):
    """Every code point and some texts as norm_exact has them."""
    known = lambda c: "Cn" != unicodedata.ucd_3_2_0.category(chr(c)) == unicodedata.category(chr(c))  # in every version of the tables
    letters = [chr(c) for c in (*range(0x20, 0xD800), *range(0xE000, 0x110000)) if known(c)]
    texts = ["".join(letters[i : i + 40]) for i in range(0, len(letters), 40)] + ["trạm", "ﬁnance", "１２", "Ω ς Σ", "№ 5 ½ ™ …", "ŉ ǰ ΐ", "한국어 각 힣a", "가" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    wrong = [(r["v"], r["a"], r["b"]) for r in df.select("v", text.norm("v").alias("a"), text.norm_exact("v").alias("b")).collect() if r["a"] != r["b"]]
    assert not wrong, wrong[:5]


def test_an_item_with_an_empty_first_line(spark):
    page = DETAIL.replace("<h2>Administration qui recrute</h2>", "").replace("<li>Grade : Technicien</li>", "<li>- <br>Grade : Technicien</li>")
    assert api.parse_detail(spark, page, extraction.BASE_URL + U1, "collec")["grade"] == ""


def test_listing_roles(spark):
    cases = {
        "Avis de concours de recrutement de Ingénieur échelle 11 Agence X annonce 1 poste": "Ingénieur échelle 11", "Recrutement d'un Technicien  Université Y": "Technicien", "recrutement de Comptable": "Comptable",
        "Recrutement des agents": "", "": "", "Avis de recrutement": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["r"] for r in text.with_listing_role(df, "t", "r").collect()} == cases


def test_redirects(spark):
    base = extraction.BASE_URL
    hop = lambda s, u: [{"status": s, "url": u}]
    rows = [
        (base + U1, hop(302, base + U1), base + "/fr/concours-liste/"), (base + U1, hop(302, base + U1), "https://other.example/fr/concours-liste"), (base + U1, [], base + "/fr/concours-liste"),
        (base + U1, hop(200, base + U1), base + "/fr/concours-liste"), (base + U1, hop(302, base + U2), base + "/fr/concours-liste"), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "url string, hops array<struct<status:int,url:string>>, final string")
    assert [r[0] is not None for r in df.select(extraction.retired_target(F.col("url"), F.col("hops"), F.col("final"))).collect()] == [True, False, False, False, False, False]


def gate(spark, expected, parsed, retired, failed):
    f = lambda xs: spark.createDataFrame([(x,) for x in xs], "url string")
    return crawl_audit.detail_gate(*map(f, (expected, parsed, retired, failed))).first()


def test_detail_gate(spark):
    assert gate(spark, ["good", "old"], ["good"], ["old"], [])["detail_gate"]
    r = gate(spark, ["good"], [], [], ["good"])
    assert not r["detail_gate"] and r["missing_urls"] == 1
    assert not gate(spark, ["good"], ["good"], ["else"], [])["detail_gate"]
    assert not gate(spark, ["good"], ["good", "more"], [], [])["detail_gate"]
    assert gate(spark, [], [], [], [])["detail_gate"]


def test_politeness_and_pages():
    assert crawl.robots_allow(None, "https://x", status=404)[0]
    assert crawl.robots_allow("User-agent: *\nDisallow: /private", "https://x")[0]
    assert not crawl.robots_allow("User-agent: *\nDisallow: /fr/", "https://x")[0]
    assert crawl.target_pages(1571) >= 175 and crawl.target_pages(0) == 12
    assert crawl.listing_params("collec", 3)["stat"] == "collec"
    assert [p.scope for p in crawl.ListingReader({"scopes": "a,b"}).partitions()] == ["a", "b"]
    for wrong in (-1, 100_001):
        with pytest.raises(ValueError):
            crawl.target_pages(wrong)


def test_whole_audit(spark):
    page = DETAIL.replace("<h2>Administration qui recrute</h2>", "")
    base = extraction.BASE_URL
    two = LISTING.replace("42 Résultats", "2 Résultats")
    listing = spark.createDataFrame([("collec", 1, s, two) for s in ("first", "body", "final")], crawl.RAW_LISTING)
    rows = [(base + U1, "collec", "t", 200, [], base + U1, page), (base + U2 + "/", "collec", "t", 200, [{"status": 302, "url": base + U2 + "/"}], base + "/fr/concours-liste", "")]
    out = audit(listing, spark.createDataFrame(rows, crawl.RAW_DETAIL), F.lit("2026-08-10 00:00:00").cast("timestamp_ntz"))
    row = out["audit"].first()
    assert row["gate"] and row["jobs"] == 1 and row["accepted"] == 1 and row["retired_urls"] == 1
    assert out["scopes"].first()["listing_coverage_pct"] == 100.0
    assert out["accepted"].count() == 1 and out["rejected"].count() == 0
