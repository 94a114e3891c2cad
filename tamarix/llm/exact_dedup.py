"""Exact dedup (10): stateful streaming deduplication.

The documents land in the shared folder, each row with the digest of its
normalised text and a content locator (its place in the landed table). A
Structured Streaming query reads the landed files; its keyed state, in RocksDB
and without expiry, retains per digest the smallest stable identifier, that
row's locator and the number of rows. Rows of one digest are combined in each
task before they are sent to the state, so a hot group costs one row a task.

Digests met more than once are hits: all bytes of their texts are grouped, and a
digest with two texts is taken apart by them, so texts that only share a digest
stay apart. The row at the locator of its group's first stays.

A digest with a `HOT`-th of all rows or more is hot. There are `HOT` of them at
most, so they are broadcast: a hot group's texts are combined in each task and
none of its rows is sent to one place.

Defined results: a null text counts as empty; texts of any length are compared
whole; a null identifier sorts after all others; of rows with equal text and
equal identifier, the first landed one stays; an empty table gives an empty
result; other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hot digests are broadcast; so many can there be, of so many rows at least.
HOT, HOT_ROWS = 10_000, 1000
#: Without preallocation a state partition takes the disk of its rows alone.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), common.SPACES, " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


class ExactDedup:
    """rows(): one row per document, `document_id`, `locator`, `keep_id`,
    `group_size`, `kept`, `digest`. kept_documents(): the rows that stay, with
    the columns of the input."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000):
        self.spark, self.columns = docs.sparkSession, docs.columns
        self.row, self.dig = common.fresh(docs, "xd_row"), common.fresh(docs, "xd_digest")
        self.id_col, self.text_col = id_col, text_col
        self.path = common.registered(common.shared_path(self.spark, "exact-landed"))
        held = docs.withColumn(self.dig, digest(normalised(text_col))).withColumn(self.row, F.monotonically_increasing_id())
        held.write.option("compression", "zstd").parquet(self.path)
        self.schema = held.schema
        self.landed = self.spark.read.schema(self.schema).parquet(self.path)
        self.state = common.landed(self._streamed(files_per_batch), "exact-digests")

    def _streamed(self, files_per_batch: int) -> DataFrame:
        """The state after the stream has read all landed files."""
        spark, at = self.spark, common.registered(common.shared_path(self.spark, "exact-state"))
        before = {k: spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            spark.conf.set(k, v)
        try:
            arrivals = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_batch).parquet(self.path)
            first = F.struct(F.col(self.id_col).isNull().alias("no_id"), F.col(self.id_col).alias("id"), F.col(self.row).alias("locator"))
            (
                arrivals.groupBy(F.unhex(self.dig).alias("digest")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
                .writeStream.format("noop").outputMode("update").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
            )
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        key_col, value_col = "key", "value"
        held = spark.read.format("statestore").load(at)
        values = held.schema[value_col].dataType.names
        digest = held.schema[key_col].dataType.names[0]
        return held.select(
            F.lower(F.hex(F.col(key_col)[digest])).alias("digest"),
            F.col(value_col)[values[-2]].alias("first"),
            F.col(value_col)[values[-1]].alias("group_size"),
        )

    def rows(self) -> DataFrame:
        total = self.state.agg(F.sum("group_size").alias("n")).first()["n"] or 0
        bar = max(HOT_ROWS, total // HOT + 1)
        hot = F.broadcast(self.state.filter(F.col("group_size") >= bar))  # HOT rows at most
        cold = self.state.filter(F.col("group_size") < bar).hint("merge")  # grows with the documents: a shuffle at every size
        held = self.landed.select(F.col(self.id_col).alias("document_id"), F.col(self.row).alias("locator"), F.col(self.dig).alias("digest"))
        of = held.join(hot, "digest").unionByName(held.join(hot.select("digest"), "digest", "left_anti").join(cold, "digest"))
        texts = self._texts()
        # hot texts are combined before they are sent, others after the one exchange by digest
        met = [texts.join(hot, "digest"), texts.join(hot.select("digest"), "digest", "left_anti").join(cold.filter("group_size > 1").hint("merge"), "digest")]
        several = [x.groupBy("digest", normalised("text").alias("bytes")).agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias("texts")).filter("texts > 1").select("digest") for x in met]
        split = common.landed(several[0].unionByName(several[1]), "exact-split")
        out = ("document_id", "locator", "first", "group_size", "digest")
        if not split.isEmpty():  # a digest with several texts
            checked = common.landed(texts.join(split, "digest").withColumn("bytes", normalised("text")).drop("text"), "exact-checked")
            first = F.struct(F.col("document_id").isNull().alias("no_id"), F.col("document_id").alias("id"), F.col("locator"))
            classes = checked.groupBy("digest", "bytes").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
            of = of.join(split, "digest", "left_anti").select(*out).unionByName(checked.join(classes, ["digest", "bytes"]).select(*out))
        return of.select("document_id", "locator", F.col("first.id").alias("keep_id"), "group_size", (F.col("locator") == F.col("first.locator")).alias("kept"), "digest")

    def _texts(self) -> DataFrame:
        return self.landed.select(F.col(self.id_col).alias("document_id"), F.col(self.row).alias("locator"), F.col(self.dig).alias("digest"), F.col(self.text_col).alias("text"))

    def kept_documents(self) -> DataFrame:
        dropped = self.rows().filter("not kept").select(F.col("locator").alias(self.row))
        return self.landed.join(dropped, self.row, "left_anti").select(*[F.col(f"`{c}`") for c in self.columns])
