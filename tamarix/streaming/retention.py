"""Announcements that leave the index on their day, as a stream.

Each crawl's announcements come with the time it saw them (`seen_at`, the event
time). By uuid, the state keeps when an announcement leaves, which is after its
deadline or when it is too old, and a digest of it; a timer of event time stands
for that moment. An announcement that is new goes out as `add`, one that was
changed as `change`, and one whose timer has come, or that no longer is fresh and
open when it is seen again, as `remove`. What is seen again unchanged is no row.

The changes of a micro-batch are published in the index under its number, with the
list of what they make void in earlier batches; a batch that is run again replaces
itself.

Defined results: an announcement without an uuid or without readable dates is
never added; of several sightings in one micro-batch the latest counts, of equal
ones the one with the greatest digest; one that has left comes back as new if it
is seen fresh and open again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import fixed_values as V
from ..functions.dates import freshness, local_time
from ..plans.index import build_index
from ..shipping import ship
from ..sources.index_store import publish
from ..sources.schemas import JOB, as_jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = T.StructType([T.StructField("action", T.StringType()), *JOB.fields])


class Retention(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "leaves long, digest long")

    def _forget(self) -> None:
        known = self.known.get()
        self.handle.deleteTimer(known[0])
        self.known.clear()

    def _gone(self, key: tuple) -> Row:
        return Row(action="remove", **dict.fromkeys(JOB.fieldNames()) | {"uuid": key[0]})

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = max(rows, key=lambda r: (r["seen_ms"], r["digest"]))
        known = self.known.get() if self.known.exists() else None
        if last["leaves_ms"] is None or last["leaves_ms"] <= timerValues.getCurrentWatermarkInMs():
            if known:
                self._forget()
                yield self._gone(key)
            return
        if known and (known[0], known[1]) == (last["leaves_ms"], last["digest"]):
            return
        if known:
            self._forget()
        self.handle.registerTimer(last["leaves_ms"])
        self.known.update((last["leaves_ms"], last["digest"]))
        yield Row(action="change" if known else "add", **{c: last[c] for c in JOB.fieldNames()})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # the timer of a date that was changed is deleted, so this one counts
        self.known.clear()
        yield self._gone(key)

    def close(self) -> None:
        pass


def changes(jobs: DataFrame, late: str = "0 seconds") -> DataFrame:
    """action and the announcement, of a stream of announcements with seen_at, a
    timestamp: a time of the site, written as the session's."""
    spark = jobs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)
    seen = F.col("seen_at").cast("timestamp_ntz")
    published, until = local_time("publication_date"), local_time("deadline")
    old = F.date_add(published.cast("date"), V.MAXIMUM_AGE_DAYS + 1).cast("timestamp_ntz")
    moment = lambda c: F.unix_millis(c.cast("timestamp"))
    leaves = F.when(freshness("publication_date", "deadline", seen) == "accepted", F.least(moment(old), moment(until) + 1))
    rows = as_jobs(jobs).filter("uuid IS NOT NULL").withWatermark("seen_at", late)
    rows = rows.select(*JOB.fieldNames(), "seen_at", moment(F.col("seen_at")).alias("seen_ms"), leaves.alias("leaves_ms"), F.xxhash64(*JOB.fieldNames()).alias("digest"))
    return rows.groupBy("uuid").transformWithState(Retention(), CHANGES, "Update", "EventTime")


def apply(batch: DataFrame, number: int, professions: DataFrame, path: str, **kinds) -> None:
    """Publishes a micro-batch of changes()."""
    batch = batch.persist()
    try:
        added = batch.filter("action <> 'remove'").drop("action")
        void = batch.filter("action <> 'add'").select("uuid")
        publish(build_index(added, professions, **kinds), path, number, void=void)
    finally:
        batch.unpersist()


def retained_index(jobs: DataFrame, professions: DataFrame, path: str, checkpoint: str, rules=None, once: bool = False) -> StreamingQuery:
    """The index of what is fresh and open, kept up by a stream of sightings."""
    kinds = {} if rules is None else {"rules": rules}
    writer = changes(jobs).writeStream.outputMode("update").foreachBatch(lambda batch, number: apply(batch, number, professions, path, **kinds)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
