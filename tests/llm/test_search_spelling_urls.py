"""Ranked search, spelling variants and URL rules against plain versions, on odd
rows and on none."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import EDGE
from pyspark.sql import functions as F
from test_operators import last, same

from tamarix.llm import common, lexical_search, spelling, url_filter

PAIRS = [(r[0], r[1]) for r in EDGE]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ---


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    """[(item, rank, doc_id, score)], every document scored for every item."""
    of = [(d, Counter(plain_terms(t))) for d, t in docs]
    of = [(d, c) for d, c in of if c]
    n, length = len(of), sum(sum(c.values()) for _, c in of)
    df = Counter(t for _, c in of for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for i, wanted in asked.items():
        found = []
        for d, c in of:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(i, rank + 1, d, -s) for rank, (s, _, d) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k])]
    return out


def searched(index, items, **how):
    return [(r["item"], r["rank"], r["id"], r["score"]) for r in index.search(items, **how).collect()]


ITEMS = [(1, "deux MOTS a"), (2, None), (3, ""), (4, "w5x5 w7x7 tail zz"), (None, "x b É"), (1, "seven"), (5, "!!! \t"), (6, "x " * 5000)]


def test_search_on_odd_rows(edge, empty, spark):
    items = spark.createDataFrame([(i, t, 9, "x", 2.5) for i, t in ITEMS], "item_id int, text string, term int, block string, score double")
    index = lexical_search.LexicalIndex(edge)
    same(searched(index, items), plain_search(PAIRS, ITEMS))
    same(searched(index, items, k=2), plain_search(PAIRS, ITEMS, 2))
    assert searched(lexical_search.LexicalIndex(empty), items) == [] and searched(index, items.limit(0)) == []


def test_search_with_ties_over_chunks(spark, monkeypatch):
    """Copies in every chunk, and a term that a third of all documents hold; items
    in blocks; the index of the items' terms alone."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30))) + (" Common" if i % 3 == 0 else "")) for i in range(400)] + [(1000 + i, "same text here common") for i in range(50)] + [(7, "same text here common")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.sample(words, 6)) + " common") for i in range(25)] + [(50, "same text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    want = plain_search(docs, items)
    terms = asked.select(F.explode(lexical_search.terms(F.col("text"))).alias("term"))
    for index in (lexical_search.LexicalIndex(df, chunk_bytes=900), lexical_search.LexicalIndex(df, wanted=terms, chunk_bytes=2000)):
        got = searched(index, asked)
        same(got, want)
    index.rows.createOrReplaceTempView("postings")
    assert spark.sql("SELECT max(c) AS m FROM (SELECT count(DISTINCT bucket) AS c FROM postings WHERE term = 'common')").first()["m"] > 1
    assert spark.sql("SELECT bool_and(term IN (SELECT explode(split('common same text here', ' '))) OR term LIKE 'w%' OR term IS NULL) AS b FROM postings").first()["b"]


# --- spelling ---


def plain_spelling(rows, least=7, most_rare=2, every=31, ratio=10):
    """{word: (form, root, n, n_near, form_n)}, all words with all."""
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= most_rare}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    of = {w: [x for x in words if near(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in of.items() if xs}
    form = {w: x for w, x in best.items() if words[x] >= ratio * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(of[w]), words[form[w]] if w in form else None)
    return out


def spelt(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.variants().collect()}


def test_spelling_on_odd_rows(edge, empty):
    assert spelt(spelling.Spelling(edge, every=3)) == plain_spelling(PAIRS, every=3)
    assert spelling.Spelling(empty).variants().count() == 0


def families(seed, n=120):
    rng, rows = random.Random(seed), []
    letters = "abcéÿ"
    base = ["".join(rng.choices(letters, k=rng.randrange(6, 12))) for _ in range(12)] + ["aaaaaaaa", "aaaaaaaaa", "bananabanana", "À" * 9, "z" * 3000, "z" * 3001]
    for i in range(n):
        words = []
        for _ in range(30):
            w = rng.choice(base)
            if len(w) < 20 and rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i if i % 10 else None, ("1" if i % 2 else ", ").join(words)))
    return rows


@pytest.mark.parametrize("piece", [20_000, 3])
def test_spelling_of_families(spark, monkeypatch, piece):
    """Words of few letters, with grams that repeat; keys dealt over cells."""
    monkeypatch.setattr(spelling, "PIECE", piece)
    monkeypatch.setattr(spelling, "BUCKET_ROWS", 500)
    monkeypatch.setattr(spelling, "AT_ONCE", 50)
    rows = families(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = spelt(spelling.Spelling(df, every=7, ratio=2, chunk_bytes=2000)), plain_spelling(rows, every=7, ratio=2)
    assert got == want
    assert any(v[1] != v[0] and v[0] for v in want.values()) and max(v[3] for v in want.values()) > 20


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abàÿ", min_size=6, max_size=10), min_size=2, max_size=8, unique=True))
def test_pairs_of_one_edit(words):
    s = spelling.Symbols(pa.array(words))
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i != j and len(b) - len(a) in (0, 1)]
    if not pairs:
        return
    x, y = (np.array(c) for c in zip(*pairs, strict=True))
    got = {pairs[i] for i in spelling.one_edit(s, x, y).tolist()}

    def near(a, b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == {(i, j) for i, j in pairs if near(words[i], words[j])}


# --- URL rules ---


def plain_rule(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host, best = host.translate(LOWER), None
    for rule, verdict in rules:
        at = rule.find("/") if "/" in (rule or "") else len(rule or "")
        h, p = (rule or "")[:at].translate(LOWER), (rule or "")[at:]
        if h and host and (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (len(h + p), h.count("."), h + p, verdict == "block")
            best = max(best or key, key)
    return host, path, best and best[2], ("block" if best[3] else "allow") if best else default


ODD_URLS = [
    None, "", "no scheme", "http://", "://a.org", "http://A.ORG/x", "http://a.org?x=/y", "http://a.org#/y", "http://x.a.org/es/1", "http://xa.org/es/", "ftp://u:p@a.org:80/en", "http://a.org/é/\U0001f600/x", "http://.org/",
    "http://a..org/", "http://a.org./", "x://y://b.org/", "http://b.org/" + "p/" * 20_000, "HTTP://ORG/", "http://a.org/\nx?y",
]
RULES = [("org/", "allow"), ("a.org/es/", "block"), ("A.org/", "block"), ("a.org/", "allow"), ("org", "block"), ("b.org/" + "p/" * 5, "block"), ("org/es", "allow"), ("/x", "block"), (None, "block"), ("", "allow"), ("a.org/é/\U0001f600", "allow"), ("org/en/1", "block"), ("org/en/1", "block")]


def judged(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i, u, "k", 1, "h") for i, u in enumerate(urls)], "page_id long, url string, keys string, host int, FIT string")
    f = url_filter.UrlFilter(pages, spark.createDataFrame(rules, "rule string, verdict string"), **how)
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in f.judged().collect()}
    kept = f.allowed()
    assert kept.columns == pages.columns and sorted(r["page_id"] for r in kept.collect()) == sorted(i for i, v in got.items() if v[3] == "allow")
    return got


@pytest.mark.parametrize("default", ["allow", "block"])
def test_urls_on_odd_rows(spark, default):
    assert judged(spark, ODD_URLS, RULES, default=default) == {i: plain_rule(u, RULES, default) for i, u in enumerate(ODD_URLS)}


def test_urls_without_rules_or_pages(spark):
    assert judged(spark, ODD_URLS, []) == {i: plain_rule(u, []) for i, u in enumerate(ODD_URLS)}
    assert judged(spark, [], RULES) == {}


def crawl(seed):
    rng = random.Random(seed)
    hosts = [".".join(rng.choices(["a", "b", "cc", "d"], k=rng.randrange(1, 4))) + rng.choice([".org", ".com"]) for _ in range(60)]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['x', 'y', 'zz'])}/{rng.randrange(9)}" for _ in range(600)]
    rules = [(rng.choice(hosts) + rng.choice(["", "/", "/x/", "/y/1", "/zz/"]), rng.choice(["allow", "block"])) for _ in range(150)]
    return urls, rules


@pytest.mark.parametrize("how", [{}, {"rate": 0.5}, {"rate": 0.5, "most_bytes": 8}])
def test_urls_of_many_rules(spark, how):
    """Filters so loose that many levels are needed; lists dealt over cascades."""
    urls, rules = crawl(4)
    assert judged(spark, urls, rules, **how) == {i: plain_rule(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    """Every key of the universe, at several levels; and the bits are few."""
    keys = spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("key"), F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256).alias("digest"))
    listed = keys.filter("substr(key, 2) % 7 = 0")
    cascade = url_filter.Cascade(listed, keys, rate=0.3)
    assert len(cascade.levels) > 3
    wrong = keys.withColumn("held", cascade.holds(F.col("digest"))).filter("held <> (substr(key, 2) % 7 = 0)")
    assert wrong.count() == 0
    assert sum(x.words for x in cascade.levels) * 64 < 8 * 4000
    plan = wrong._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
    mark = common.marked()
    cascade.discard()
    assert common.marked() == mark - len(cascade.levels)


assert last  # the order of odd rows
