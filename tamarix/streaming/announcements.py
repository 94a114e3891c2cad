"""New announcements as a stream: an extension of the batch plans.

Announcements are deduplicated by uuid within the retention of 15 days, and each
micro-batch is classified by the batch plan and published in the index under its
number, so that a batch that is run again after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import local_time
from ..functions.fixed_values import MAXIMUM_AGE_DAYS
from ..plans.index import build_index
from ..sources.index_store import publish


def new_announcements(jobs: DataFrame) -> DataFrame:
    """A stream of announcements without those seen within the retention."""
    at = local_time("publication_date").cast("timestamp")
    return jobs.withColumn("published_at", at).withWatermark("published_at", f"{MAXIMUM_AGE_DAYS} days").dropDuplicatesWithinWatermark(["uuid"])


def index_stream(jobs: DataFrame, professions: DataFrame, path: str, checkpoint: str, rules=None, once: bool = False) -> StreamingQuery:
    """Adds the classified announcements to an index at `path`."""
    kinds = {} if rules is None else {"rules": rules}

    def add(batch: DataFrame, number: int) -> None:
        publish(build_index(batch.drop("published_at"), professions, **kinds), path, number)

    writer = new_announcements(jobs).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
