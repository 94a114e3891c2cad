"""The crawl over a server on this machine: counters, stagnation, failures,
retries, redirects, and the audit command."""

import json
import threading
import time
from collections import Counter
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib import error, parse

import pytest
from pyspark.sql import functions as F

from tamarix import api, cli
from tamarix.functions import fixed_values as V
from tamarix.operators import crawl_audit, extraction
from tamarix.plans import audit as audit_plan
from tamarix.sources import crawl
from tamarix.sources.files import read_jobs

FAST = {"pause": 0.0, "backoff": 0.01}
_NOW = datetime.now()
TODAY = f"{_NOW.day} {list(V.MONTHS)[[*V.MONTHS.values()].index(_NOW.month)]} {_NOW.year}"
uuid = lambda scope, n: f"{ord(scope[0]):08x}-0000-0000-0000-{n:012x}"


class Site:
    """sizes: announcements by scope, nine a page. Odd things by scope: `moving`
    has one more when it is read again, `gap` never shows its last page, `flaky`
    answers 500 at page 2 in its first scan."""

    def __init__(self, sizes):
        self.sizes, self.asked, self.robots = sizes, Counter(), "User-agent: *\nDisallow: /private"
        self.connections, self.times, self.close = 0, [], False

    def page(self, scope, page):
        self.asked[scope, page] += 1
        n, firsts = self.sizes[scope], self.asked[scope, 1]
        if scope == "flaky" and page == 2 and firsts == 1:
            return 500, ""
        official = n + (scope == "moving" and firsts >= 2)
        last = n - n % 9 if scope == "gap" else official
        links = [f'<a href="/fr/concours/details/{uuid(scope, i)}">T{scope}{i}</a>' for i in range((page - 1) * 9, min(page * 9, last))]
        if scope == "moving" and page == 1 and firsts >= 2:
            links.append(f'<a href="/fr/concours/details/{uuid(scope, n)}">new</a>')
        return 200, f"<div>{official} Résultats</div>{''.join(links)}<h2>Dernière chance pour postuler</h2><a href='/fr/concours/details/{uuid('x', 1)}'>x</a>"

    def detail(self, path):
        n = int(path[-12:], 16)
        self.asked[path] += 1
        if n == 3:
            return 302, "/fr/concours-liste"
        if n == 4 and self.asked[path] <= 1:
            return 404, ""
        if n == 5:
            return 410, ""
        if n == 6 and self.asked[path] <= 2:
            return 503, ""
        return 200, f"<h3>Administration qui recrute Office {n}</h3><p>Date de publication {TODAY}</p><p>Délai de dépôt des candidatures 19 août 2099</p><ul><li>Nombre de postes : 2</li><li>Nom du poste : Agent {n}</li></ul>"


@pytest.fixture
def site():
    state = Site({"service": 25, "flaky": 20, "moving": 10, "gap": 40, "empty": 0})

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            state.connections += 1
            super().setup()

        def do_GET(self):
            state.times.append(time.time())
            self.close_connection = self.close_connection or state.close  # without a word
            url = parse.urlsplit(self.path)
            asked = dict(parse.parse_qsl(url.query))
            if url.path == "/robots.txt":
                status, body = (200, state.robots) if state.robots is not None else (404, "")
            elif url.path == "/fr/concours-liste":
                status, body = state.page(asked.get("stat", "empty"), int(asked.get("page", 1)))
            elif url.path == "/wait":
                state.asked["wait"] += 1
                status, body = (429, "") if state.asked["wait"] == 1 else (200, "done")
            else:
                status, body = state.detail(url.path)
            self.send_response(status)
            if status == 302:
                self.send_header("Location", body)
            if status == 429:
                self.send_header("Retry-After", "Wed, 21 Oct 2015 07:28:00 GMT")
            data = body.encode()
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state.url = f"http://127.0.0.1:{server.server_port}"
    yield state
    server.shutdown()


def scans(site, scope, **more):
    reader = crawl.ListingReader({"base_url": site.url, "rest": "0"} | {k: str(v) for k, v in FAST.items()} | more)
    return list(reader.read(next(p for p in crawl.ListingReader({"scopes": scope}).partitions())))


def test_scans(site):
    rows = scans(site, "service")
    assert [(r[1], r[2], r[4], r[5]) for r in rows] == [(1, "first", 1, None), (2, "body", 1, None), (3, "body", 1, None), (1, "final", 1, None)]
    assert [(r[1], r[2]) for r in scans(site, "empty")] == [(1, "first"), (1, "final")]


def test_a_scan_that_fails_is_made_again(site, monkeypatch):
    monkeypatch.setattr(crawl, "AGAIN", (429,))
    rows = scans(site, "flaky")
    first, second = [r for r in rows if r[4] == 1], [r for r in rows if r[4] == 2]
    assert [(r[1], r[5] and r[5].split(":")[0]) for r in first] == [(1, None), (2, "HTTPError"), (3, None), (4, None), (5, None), (6, None), (1, None)] and [r[1] for r in second] == [1, 2, 3, 1]


def test_a_scan_stops_after_stagnant_pages(site):
    first = [r[1] for r in scans(site, "gap") if r[4] == 1]
    assert first == [1, 2, 3, 4, 5, 6, 7, 1]  # 36 of 40 by page 4, then three pages without any


def test_a_page_without_a_counter_is_refused(site):
    with pytest.raises(ValueError, match="counter"):
        crawl.H.listing_facts("<p>rien</p>")
    with pytest.raises(ValueError, match="count"):
        list(crawl.scan(lambda page: "<div>100001 Résultats</div>", 1))


def test_retries(site):
    began = time.monotonic()
    assert crawl.fetch(site.url + "/wait", **FAST).text == "done" and time.monotonic() - began < 5
    with pytest.raises(error.URLError):
        crawl.fetch("http://127.0.0.1:9/", retries=1, **FAST)
    assert crawl.waiting("2.5", 0, 1) == 2.5 and crawl.waiting("soon", 2, 1) == 4 and crawl.waiting(None, 1, 0.5) == 1


def test_connections_are_kept(site):
    assert len(scans(site, "service")) == 4 and site.connections == 1
    site.close = True  # the host closes after each page: a kept connection is made anew
    assert len(scans(site, "service")) == 4 and site.connections == 4
    site.close = False
    got = crawl.fetch(f"{site.url}/fr/concours/details/{uuid('x', 3)}", **FAST)
    assert got.final_url == f"{site.url}/fr/concours-liste" and [h[0] for h in got.hops] == [302]
    with pytest.raises(ValueError, match="address"):
        crawl.fetch("javascript:x", **FAST)


def test_slots_of_tasks_differ():
    for tasks in (1, 3, 8):
        own = [crawl.Slots(10.0, tasks, i) for i in range(tasks)]
        times = sorted(round(s.next(1000.03 + n / 7), 6) for s in own for n in range(20))
        assert len(set(times)) == len(times) and times[0] >= 1000.03 and all(b - a > 0.0999 for a, b in zip(times, times[1:], strict=False))


@pytest.mark.parametrize("slots", [1, 8])
def test_a_rate_is_shared(spark, site, slots):
    urls = [(f"{site.url}/fr/concours/details/{uuid('s', 100 + n)}", "s", "t") for n in range(40)]
    pages = crawl.detail_pages(spark.createDataFrame(urls, "url string, scope string, title string"), slots=slots, rate=20.0, **FAST)
    assert pages.filter("error is null").count() == 40
    times = sorted(site.times)
    assert max(sum(t <= x < t + 0.5 for x in times) for t in times) <= 12  # 10, and what is late by a moment
    assert site.connections <= slots
    with pytest.raises(ValueError, match="slots"):
        crawl.detail_pages(pages, rate=1.0)


def test_a_read_that_died_goes_on(spark, site, tmp_path):
    """A second reader asks for no page that the first one got."""
    landing = str(tmp_path / "pages")
    reader = crawl.ListingReader({"base_url": site.url, "rest": "0", "scopes": "service", "landing": landing, "pause": "0"})
    part = reader.partitions()[0]
    rows = reader.read(part)
    assert [next(rows)[1] for _ in range(2)] == [1, 2]
    rows.close()  # dies with pages 1 and 2 read
    assert len(list(reader.read(part))) == 4 and site.asked == Counter({("service", 1): 2, ("service", 2): 1, ("service", 3): 1})
    assert len(list(reader.read(part))) == 4 and sum(site.asked.values()) == 4
    urls = spark.createDataFrame([(f"{site.url}/fr/concours/details/{uuid('s', n)}", "s", "t") for n in (1, 2, 5)], "url string, scope string, title string")
    for _ in range(2):
        got = crawl.detail_pages(urls, slots=2, landing=landing, **FAST).collect()
        assert sorted(bool(r["html"]) for r in got) == [False, True, True]
    assert [site.asked[f"/fr/concours/details/{uuid('s', n)}"] for n in (1, 2, 5)] == [1, 1, 2]  # what failed is asked for again


def test_a_whole_crawl(spark, site, tmp_path):
    listings, states, outcomes = audit_plan.crawl_site(spark, site.url, str(tmp_path), ("service", "flaky", "moving", "gap", "empty"), rest=0.0, **FAST)
    got = {r["scope"]: (r["attempt"], r["official_before"], r["official_after"], r["discovered"], r["complete"]) for r in states.collect()}
    assert got["service"] == (1, 25, 25, 25, True) and got["empty"] == (1, 0, 0, 0, True) and got["gap"][3:] == (36, False)
    assert got["moving"] == (2, 11, 11, 11, True)
    found = audit_plan.verified(listings, states, outcomes, F.lit(_NOW.replace(hour=23, minute=59).isoformat(sep=" ")).cast("timestamp_ntz"))
    jobs, failures, retired = outcomes
    urls = {r["url"] for r in listings.select(F.explode("urls").alias("url")).collect()}
    gone = {u for u in urls if u.endswith("000003")}
    lost = {u for u in urls if u.endswith("000005")}
    assert {r["url"] for r in retired.collect()} == gone and {r["url"] for r in failures.collect()} == lost
    assert {r["url"] for r in jobs.collect()} == urls - gone - lost  # those that came at the second try too
    row = found["audit"].first()
    assert not row["gate"] and row["missing_urls"] == len(lost) and row["accepted"] == len(urls - gone - lost)


def test_scopes_and_details_one_by_one(spark, site):
    how = {"pause": 0, "backoff": 0.01}
    service = api.crawl_scope(spark, site.url, "service", **how)
    assert service["listing_complete"] and len(service["discovered_urls"]) == 25 == service["official_after"] and service["titles"][service["discovered_urls"][1]] == "Tservice1"
    assert not api.crawl_scope(spark, site.url, "gap", rest=0, **how)["listing_complete"]
    again = service | {"scope": "other", "discovered_urls": service["discovered_urls"][:2] + [f"{site.url}/fr/concours/details/{uuid('x', 5)}"]}
    got = api.crawl_details(spark, [service | {"scope": "service"}, again], site.url, parallel=3, rest=0.0, **FAST)
    assert len(got["jobs"]) == 23 and {j["scope"] for j in got["jobs"]} == {"service"} and [j["uuid"] for j in got["jobs"]] == sorted((j["uuid"] for j in got["jobs"]), reverse=True)
    assert len(got["retired_redirects"]) == 1 and sorted(m.split(":")[0] for m in got["failures"].values()) == ["HTTPError"] * 2
    assert api.robots_allows(site.url, pause=0.0)[0]
    site.robots = "User-agent: *\nDisallow: /fr/"
    assert not api.robots_allows(site.url, pause=0.0)[0] and not api.robots_allows("http://127.0.0.1:9", pause=0.0, retries=0)[0]


def test_links_that_only_the_last_reading_has(spark):
    pages = [("a", 1, "first", ["u1", "u2"], {"u1": "one", "u2": "two"}), ("a", 2, "body", ["u3", "u1"], {"u3": "three", "u1": "uno"}), ("a", 1, "final", ["u5", "u4", "u2"], {"u5": "five", "u4": "four", "u2": "deux"})]
    df = spark.createDataFrame(pages, "scope string, page int, snapshot string, urls array<string>, titles map<string,string>")
    got = [(r["url"], r["title"]) for r in extraction.numbered(df).orderBy("position").collect()]
    assert got == [("u4", "four"), ("u5", "five"), ("u1", "uno"), ("u2", "deux"), ("u3", "three")]


def test_audit_command(spark, site, tmp_path, capsys):
    run = lambda *a: cli.run(spark, cli.parser().parse_args(["audit", "--base-url", site.url, "--pause", "0", *a]))
    out = tmp_path / "out"
    site.sizes = {"service": 3, "empty": 0}
    assert run("--output", str(out), "--scopes", "service,empty") == 0
    report = json.loads((out / "audit.json").read_text(encoding="utf-8"))
    assert report["gate"] and report["accepted"] == 3 and report["scopes"][0]["complete"] and json.loads(capsys.readouterr().out) == report
    assert read_jobs(spark, str(out / "jobs")).count() == 3 and read_jobs(spark, str(out / "all_announcements")).count() == 3
    site.sizes["gap"] = 13
    assert run("--output", str(out), "--scopes", "gap") == 1 and run("--output", str(out), "--scopes", "gap", "--no-gate") == 0
    site.robots = "User-agent: *\nDisallow: /fr/"
    assert run("--output", str(out)) == 2 and not json.loads((out / "audit.json").read_text(encoding="utf-8"))["robots_allowed"]
    site.robots = None
    assert run("--output", str(out), "--scopes", "empty") == 0


def test_best_attempt_of_landed_scans(spark):
    rows = [("a", 1, s, f"<div>{n} Résultats</div>", t, None) for t, n in ((1, 2), (2, 0)) for s in ("first", "final")] + [("a", 2, "body", None, 1, "TimeoutError: x")]
    listings, best = crawl_audit.scanned(spark.createDataFrame(rows, crawl.LISTING_PAGES), extraction.BASE_URL)
    assert [(r["attempt"], r["complete"]) for r in best.collect()] == [(2, True)] and listings.count() == 2
