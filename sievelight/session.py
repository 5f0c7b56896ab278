"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="sievelight-"), "sievelight.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(target)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset on one machine (tests) a temporary folder, which is then set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        folder = tempfile.mkdtemp(prefix="sievelight-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def save(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes a table and reads it back, which cuts its lineage."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/sievelight-{uuid.uuid4().hex}"


#: Rows up to which a table of a batch of notes is broadcast: 20 MB or so.
FEW = 200_000


def small(rows: DataFrame) -> DataFrame:
    """Rows of a batch of notes, stored and counted; those that are few are broadcast, whatever else grows."""
    rows = save(rows, new_folder(rows.sparkSession))
    return F.broadcast(rows) if rows.count() <= FEW else rows
