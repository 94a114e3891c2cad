"""A JSON array read by several tasks, against the reader of whole files."""

import json

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tamarix.sources import files, json_array
from tamarix.sources.schemas import JOB

TEXT = st.text(alphabet='ab",\\[]{}: \n\té \U0001f600', max_size=25)
RECORD = st.fixed_dictionaries({}, optional={"uuid": st.one_of(st.none(), TEXT), "listing_title": TEXT, "specialties": st.lists(TEXT, max_size=3), "positions": st.integers(-5, 5), "other": st.recursive(TEXT, lambda x: st.lists(x, max_size=2) | st.dictionaries(TEXT, x, max_size=2), max_leaves=5)})


@settings(max_examples=300, deadline=None)
@given(st.lists(RECORD, max_size=6), st.sampled_from([None, 1]), st.data())
def test_cuts_anywhere(records, indent, data):
    """Blocks that begin at any comma give the records, whatever the strings hold."""
    text = json.dumps(records, ensure_ascii=data.draw(st.booleans()), indent=indent).encode()
    commas = [i for i, c in enumerate(text) if c == ord(",")]
    at = [0, *sorted(data.draw(st.sets(st.sampled_from(commas))) if commas else []), len(text)]
    split, found = json_array._Split(False, 0), []
    state = (False, 0)
    for a, b in zip(at, at[1:], strict=False):
        block = np.frombuffer(text[a:b], np.uint8)
        own = json_array._Split(*state)  # a split of its own, too
        alone = own.read(block)
        odd, outer, inner = json_array.summary(block)
        state = state[0] ^ bool(odd), state[1] + (inner if state[0] else outer)
        got = split.read(block)
        found += got
        assert (split.within, split.depth) == state and all(x in got for x in alone)
    assert split.tail is None and state == (False, 0)
    assert [json.loads(x) for x in found if x.strip()] == records


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(RECORD, max_size=60), st.sampled_from([None, 2]))
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, records, indent):
    path = tmp_path / "jobs.json"
    path.write_text(json.dumps(records, indent=indent, ensure_ascii=False), encoding="utf-8")
    key = lambda r: json.dumps(r.asDict(), sort_keys=True)
    want = sorted(map(key, spark.read.schema(JOB).json(str(path), multiLine=True).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.read_jobs(spark, str(path))
        assert sorted(map(key, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_several_tasks_and_files(spark, tmp_path):
    """Long records over splits, several files of one folder; an object is none."""
    rows = [{"uuid": str(i), "listing_title": "x, \\\"[" * (3000 if i == 7 else 2), "positions": i} for i in range(400)]
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(rows[n * 200 : n * 200 + 200]), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = json_array.read_array(spark, str(tmp_path / "in"), JOB)
        assert json_array._pieces(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 8
        assert sorted((r["uuid"], r["listing_title"], r["positions"]) for r in got.select("uuid", "listing_title", "positions").collect()) == sorted((r["uuid"], r["listing_title"], r["positions"]) for r in rows)
        (tmp_path / "one.json").write_text('{"uuid": "1"}', encoding="utf-8")
        with pytest.raises(ValueError, match="no array"):
            json_array.states(spark, str(tmp_path / "one.json"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
