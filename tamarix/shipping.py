"""Python functions need this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends this package to the executors, once for each application; the active
    session's if none is given, nothing if there is none."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="tamarix-")) / "tamarix.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(name))
    _SHIPPED.add(sc.applicationId)
