"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable for the Python workers, once an application, unless PYTHONPATH already does."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    where = Path(tempfile.mkdtemp(prefix="lexisift-")) / "lexisift.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(where))
    _shipped.add(app)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that all executors share; only a session that names none (tests) gets a local one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="lexisift-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and its rows stay as they are."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
