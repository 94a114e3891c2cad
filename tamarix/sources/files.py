"""Readers and writers: JSON announcements, taxonomy files, exports. Tables are
written as folders of JSON lines (or Parquet), reports of one row as one file."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import if_any, text
from . import json_array
from .schemas import JOB

_MARKET = "professions array<struct<id:string,label:string,sector:string,family:string,hcp_codes:array<string>,aliases:array<string>,diplomas:array<string>>>"
_OFFICIAL = "records array<struct<code:string,label:string,major_group_label:string,grand_group_label:string,subgroup_label:string>>"
MARKET, OFFICIAL = "market", "official"


_RULE = "rules array<struct<id:string,profession_id:string,job_name_any:array<string>,grade_any:array<string>,specialty_any:array<string>,score:double>>"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _file(spark, path)
    return system.exists(at)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Announcements: a file with a JSON array, or a folder of JSON lines. An
    array larger than a partition of Spark's readers is read by several tasks."""
    at, system = _file(spark, path)
    status = system.getFileStatus(at) if system.exists(at) else None
    if status is not None and status.isFile() and status.getLen() > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return json_array.read_array(spark, path, JOB)
    return spark.read.schema(JOB).json(path, multiLine=status is None or not status.isDirectory())


def read_rules(spark: SparkSession, path: str) -> tuple[dict[str, Any], ...]:
    """A taxonomy's conjunctive rules (a few); none if there is no such file."""
    if not exists(spark, path):
        return ()
    rows = spark.read.schema(_RULE).json(path, multiLine=True).select(F.inline("rules")).collect()
    return tuple({k: v for k, v in r.asDict().items() if v is not None} for r in rows)


def read_market(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_MARKET).json(path, multiLine=True).select(F.posexplode("professions").alias("ord", "p"))
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.col(f"p.{c}"), none).alias(c) for c in ("hcp_codes", "aliases", "diplomas")]
    return rows.select(F.col("ord").cast("long").alias("ord"), "p.id", "p.label", "p.sector", "p.family", *lists, F.lit(MARKET).alias("source"))


def read_official(spark: SparkSession, path: str, first_ord: int = 1_000_000) -> DataFrame:
    """The national nomenclature, after all market professions."""
    r = spark.read.schema(_OFFICIAL).json(path, multiLine=True).select(F.posexplode("records").alias("ord", "r"))
    none = F.array().cast("array<string>")
    return r.select(
        (F.col("ord") + first_ord).cast("long").alias("ord"), F.concat(F.lit("hcp."), F.col("r.code")).alias("id"), "r.label",
        F.coalesce(if_any(F.col("r.major_group_label"), F.col("r.grand_group_label")), F.lit("HCP")).alias("sector"), text("r.subgroup_label").alias("family"),
        F.array("r.code").alias("hcp_codes"), none.alias("aliases"), none.alias("diplomas"), F.lit(OFFICIAL).alias("source"),
    )


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a local session without it gets a
    temporary folder, a cluster must name one that all its machines see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        base = "file://" + tempfile.mkdtemp(prefix="tamarix-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(spark: SparkSession, report: Any, path: str) -> None:
    """A report as one readable JSON file."""
    at, system = _file(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2, default=str), "utf-8"))
    finally:
        out.close()
