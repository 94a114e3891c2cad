"""The search index as files: versions that are published by one rename.

An index at `path` has, for each build of a batch, announcements by publication
day and postings, a row a (profession, announcement), by bucket of the
profession:

    jobs/batch=B/build=U/publication_day=D/..
    postings/batch=B/build=U/bucket=K/..
    void/batch=B/build=U/..       (uuids whose rows of earlier batches don't count)
    manifests/N.json

The manifest with the highest number says which build of each batch counts, and
carries the envelope (version, generated_at, source, classification_policy). A
build writes its files aside and then renames its manifest into place, which
fails if another one took the number; then it is made again from that one. So
readers see the whole of a build or nothing of it, a build that fails midway
leaves the index as it was, and a batch that comes again replaces itself. The
file system must have a rename that doesn't overwrite (HDFS, local disks).

A search reads the bucket of its profession alone. Buckets are written by
rebalancing, so a profession that many announcements have gets several files,
sorted, with statistics of professions and days.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

VERSION = 2
POLICY = "exact_and_strong_only"
BUCKETS = 64


class _Files:
    """A folder, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.system = self._at("").getFileSystem(self.conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self.system.listStatus(at)) if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether the file could be written; False if there is one already."""
        aside = f"{name}.{uuid.uuid4().hex}"
        stream = self.system.create(self._at(aside), False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        qualified = lambda n: self.system.makeQualified(self._at(n))
        try:
            context.rename(qualified(aside), qualified(name), plain)
        except Py4JJavaError as e:
            self.remove(aside)
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self._at(name), True)


def _numbers(files: _Files) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names("manifests") if n.endswith(".json"))


def _manifest(files: _Files, number: int) -> dict[str, Any]:
    return json.loads(files.read(f"manifests/{number:012d}.json"))


def bucket(profession_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(profession_id), F.lit(buckets)).cast("int")


def publish(index: DataFrame, path: str, batch: int = -1, source: str | None = None, generated_at: str | None = None, buckets: int = BUCKETS, void: DataFrame | None = None, alone: bool = False) -> dict[str, Any]:
    """Writes a build of a batch (-1: not from a stream) of the index and publishes
    it; returns its manifest. `void`: the uuids whose rows in earlier batches don't
    count any more. With `alone` no other batch counts from then on."""
    spark = index.sparkSession
    files = _Files(spark, path)
    build = f"batch={batch}/build={uuid.uuid4().hex}"
    index.withColumn("publication_day", F.substring("publication_date", 1, 10)).write.partitionBy("publication_day").parquet(f"{path}/jobs/{build}")
    posted = "profession_matches" in index.columns
    if posted:
        rows = search.postings(spark.read.schema(index.schema).parquet(f"{path}/jobs/{build}")).withColumn("bucket", bucket(F.col("profession_id"), buckets))
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "profession_id", "publication_date").write.partitionBy("bucket").parquet(f"{path}/postings/{build}")
    if void is not None:
        void.select("uuid").distinct().write.parquet(f"{path}/void/{build}")
    now = generated_at or datetime.now(timezone.utc).isoformat()
    while True:
        numbers = _numbers(files)
        last = _manifest(files, numbers[-1]) if numbers else {"parts": {}, "number": -1}
        parts = ({} if alone else last["parts"]) | {str(batch): {"build": build, "buckets": buckets if posted else 0, "void": void is not None}}
        new = {"version": VERSION, "generated_at": now, "source": source, "classification_policy": POLICY, "number": last["number"] + 1, "parts": parts}
        if files.write_new(f"manifests/{new['number']:012d}.json", json.dumps(new)):
            return new


def expire(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Removes the builds that the last `keep` manifests don't have, and older
    manifests; returns how many builds. Not while a build is being written, or
    an older manifest read."""
    files = _Files(spark, path)
    numbers = _numbers(files)
    used = {p["build"] for n in numbers[-keep:] for p in _manifest(files, n)["parts"].values()}
    gone = 0
    for n in numbers[:-keep]:
        files.remove(f"manifests/{n:012d}.json")
    for kind in ("jobs", "postings", "void"):
        for batch in files.names(kind):
            for build in files.names(f"{kind}/{batch}"):
                if f"{batch}/{build}" not in used:
                    files.remove(f"{kind}/{batch}/{build}")
                    gone += kind == "jobs"
    return gone


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> dict[str, Any]:
    """One build of all that counts, under the number of the last batch."""
    index = SearchIndex(spark, path)
    last = max(int(b) for b in index.manifest["parts"])
    return publish(index.jobs(), path, last, index.manifest["source"], index.manifest["generated_at"], buckets, alone=True)


class SearchIndex:
    """The index at a path as its last manifest has it; builds published later
    aren't seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        files = _Files(spark, path)
        numbers = _numbers(files)
        self.manifest = _manifest(files, numbers[-1]) if numbers else {"parts": {}}

    @property
    def envelope(self) -> dict[str, Any]:
        return {k: v for k, v in self.manifest.items() if k != "parts"}

    def _read(self, kind: str, builds: list[str]) -> DataFrame:
        # without a manifest there is no such folder either, as the reader says
        at = [f"{self.path}/{kind}/{b}" for b in builds] or [f"{self.path}/{kind}"]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*at)

    def jobs(self, since: str | None = None) -> DataFrame:
        """The announcements; with `since` (a day, as 2026-08-05) only the folders
        of that publication day and later are read."""
        index = self._read("jobs", [p["build"] for p in self.manifest["parts"].values()])
        if since is not None:
            index = index.filter(F.col("publication_day") >= F.lit(since).cast(index.schema["publication_day"].dataType))
        return self._counting(index).drop("publication_day", "batch", "build")

    def _counting(self, rows: DataFrame) -> DataFrame:
        """rows (uuid, batch) that no later batch made void."""
        builds = [p["build"] for p in self.manifest["parts"].values() if p.get("void")]
        if not builds:
            return rows
        void = self._read("void", builds).groupBy(F.col("uuid").alias("void_uuid")).agg(F.max("batch").alias("void_at"))
        found = rows.join(void, rows["uuid"] == void["void_uuid"], "left")
        return found.filter(F.col("void_at").isNull() | (F.col("void_at") <= F.col("batch"))).drop("void_uuid", "void_at")

    def postings(self, profession_id: str) -> DataFrame:
        """The postings of a profession, from the files of its bucket."""
        found = None
        for buckets in sorted({p["buckets"] for p in self.manifest["parts"].values()} - {0}):
            rows = self._read("postings", [p["build"] for p in self.manifest["parts"].values() if p["buckets"] == buckets])
            rows = rows.filter((F.col("bucket") == bucket(F.lit(profession_id), buckets)) & (F.col("profession_id") == profession_id))
            rows = self._counting(rows).drop("batch", "build", "bucket")
            found = rows if found is None else found.unionByName(rows)
        return self._read("postings", []) if found is None else found

    def search(self, profession_id: str, now: Column, limit: int = 20) -> DataFrame:
        """search.search() of the announcements, from the postings."""
        return search.search_postings(self.postings(profession_id), now, limit)
