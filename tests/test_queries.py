"""Every registered reference query against its SQL, on the smallest tables."""

import os
import random
from difflib import SequenceMatcher

import duckdb
import pytest

from tamarix import catalogue, demo
from tamarix.functions import text
from tamarix.operators import suggest
from tamarix.sources.schemas import PROFESSION

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def table(df):
    cols = sorted(df.columns)
    return cols, sorted(map(tuple, df[cols].astype(str).values.tolist()))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        assert table(got) == table(db.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got)


def asked(spark, *queries):
    return spark.createDataFrame([(q,) for q in queries], "query string")


def test_fuzzy_suggestions(spark):
    typed = ("esthéticien rin", "comptablee", "old anvill", "redwidget", "blue bolt")
    best = {r["query"]: r["profession_id"] for r in suggest.suggest(asked(spark, *typed), demo.taxonomy(spark)).filter("rank = 1").collect()}
    assert best == {"esthéticien rin": "beauty.estheticien", "comptablee": "finance.comptable", "old anvill": "hcp.1", "redwidget": "it.cybersecurite", "blue bolt": "it.technicien_developpement_informatique"}
    resolved = {r["query"]: r["profession_id"] for r in suggest.resolve(asked(spark, *typed, "hcp.3", "old anvil", "nothing", "blue bolt"), demo.taxonomy(spark)).collect()}
    assert resolved["esthéticien rin"] == "beauty.estheticien" and resolved["comptablee"] is None and resolved["hcp.3"] == "hcp.3" and resolved["old anvil"] == "hcp.1" and resolved["nothing"] is None


def test_the_index_finds_all_that_scores(spark):
    """Against every query with every term: rules and ratios."""
    rng = random.Random(6)
    words = ["ring", "rings", "old", "gold", "anvil", "vil", "an", "gear", "ear", "aab", "abab"]
    labels = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(60)})
    edits = [lambda t, i: t[:i] + t[i + 1 :], lambda t, i: t[:i] + rng.choice("aeg ") + t[i:], lambda t, i: t[i:], lambda t, i: t[: i + 1], lambda t, i: t[:i] + "x" + t[i + 1 :], lambda t, i: " ".join(t.split()[::-1])]
    queries = sorted({e(t, rng.randrange(len(t))) for t in labels for e in rng.sample(edits, 4)} - {""})
    terms = spark.createDataFrame([(i, f"p{i}", t, "s", "f", [], [], [], "market") for i, t in enumerate(labels)], PROFESSION)
    got = {(r["query"], r["term"]): r["score"] for r in suggest.term_scores(asked(spark, *queries), terms).collect()}
    want = {}
    for query in queries:
        q, qt = text.norm_text(query), set(text.token_list(query))
        for t in labels:
            ratio = SequenceMatcher(None, q, t).ratio()
            if not q:
                continue
            if q == t:
                want[query, t] = 1000.0
            elif t.startswith(q):
                want[query, t] = 920.0
            elif any(w.startswith(q) for w in t.split()):
                want[query, t] = 860.0
            elif f" {q} " in f" {t} ":
                want[query, t] = 820.0
            elif qt and qt <= set(text.token_list(t)):
                want[query, t] = 780.0 + min(len(qt), 5)
            elif ratio >= 0.85:
                want[query, t] = 500 + 100 * ratio
    assert got == want and sum(v < 600 for v in want.values()) > 40 and {780.0 // 10, 82.0, 86.0, 92.0, 100.0} <= {v // 10 for v in want.values()}
