"""Announcements enter the index, change and leave on their day."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from test_entry import taxonomy_dir

from tamarix import api
from tamarix.sources.index_store import SearchIndex, compact, expire
from tamarix.sources.schemas import JOB
from tamarix.streaming.retention import retained_index


def job(uuid, published, deadline, name="Comptable"):
    return {"uuid": uuid, "url": "u", "job_name": name, "publication_date": published, "deadline": deadline, "positions": 1}


def day(n, hour=0):
    return f"2026-08-{n:02}T{hour:02}:00:00"


def test_announcements_leave_on_their_day(spark, tmp_path):
    landed, out = tmp_path / "landed", str(tmp_path / "out")
    landed.mkdir()
    professions = api.Taxonomy(spark, taxonomy_dir(tmp_path)).professions
    schema = T.StructType([*JOB.fields, T.StructField("seen_at", T.TimestampType())])

    def crawl(n, hour, *jobs):
        name = f"{n:02}-{hour:02}"
        (landed / f"{name}.json").write_text("\n".join(json.dumps(j | {"seen_at": day(n, hour)}) for j in jobs), encoding="utf-8")
        go()
        return names()

    def go():
        retained_index(spark.readStream.schema(schema).json(str(landed)), professions, out, str(tmp_path / "cp"), once=True).awaitTermination()

    def names():
        return sorted((r["uuid"], r["job_name"]) for r in SearchIndex(spark, out).jobs().collect())

    a, b, c = job("a", day(1), day(3, 12)), job("b", day(1), day(30)), job("c", day(2), day(30))
    old, wrong = job("old", "2026-07-01T00:00:00", day(30)), job("wrong", "soon", day(30))
    assert crawl(1, 8, a, b, old, wrong, job(None, day(1), day(9))) == [("a", "Comptable"), ("b", "Comptable")]
    assert crawl(2, 8, a, b, c, c) == [("a", "Comptable"), ("b", "Comptable"), ("c", "Comptable")]
    assert crawl(3, 13, b, c | {"job_name": "Infirmier"}) == [("b", "Comptable"), ("c", "Infirmier")]  # a's deadline has passed
    before = SearchIndex(spark, out).manifest
    (tmp_path / "cp" / "commits" / sorted((f.name for f in (tmp_path / "cp" / "commits").iterdir() if f.name.isdigit()), key=int)[-1]).unlink()
    for f in (tmp_path / "cp" / "commits").glob(".*.crc"):
        f.unlink()
    go()  # the last batch again, as if it had failed at its end
    assert names() == [("b", "Comptable"), ("c", "Infirmier")] and SearchIndex(spark, out).manifest["number"] >= before["number"]
    assert crawl(16, 23, c | {"job_name": "Infirmier"}) == [("b", "Comptable"), ("c", "Infirmier")]  # the fifteenth day is the last
    assert crawl(17, 0, job("d", day(17), day(30))) == [("c", "Infirmier"), ("d", "Comptable")]
    found = SearchIndex(spark, out)
    search = lambda x, p: sorted(r["uuid"] for r in x.search(p, F.lit("2026-08-17 00:00:00").cast("timestamp_ntz")).collect())
    assert search(found, "finance.comptable") == ["d"] and search(found, "health.infirmier") == ["c"]
    compact(spark, out)
    assert names() == [("c", "Infirmier"), ("d", "Comptable")] and search(SearchIndex(spark, out), "finance.comptable") == ["d"]
    assert expire(spark, out) > 1 and names() == [("c", "Infirmier"), ("d", "Comptable")]
    assert api.search_by_profession(SearchIndex(spark, out).jobs(), "health.infirmier")[0]["uuid"] == "c"
