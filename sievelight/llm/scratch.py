"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievelight.session import shared_folder


#: Spark's own bound on an Arrow batch, and the one that replaces it.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Batches of texts between the JVM and Python workers hold about 4 MB each, unless the session has a bound of its own.

    Whole batches lie outside the heap on one side and in Python on the other, so
    with long texts Spark's 64 MB a running task are what fills an executor.
    """
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has (Spark compares names without regard to case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts_for(df: DataFrame, bytes_a_part: int, least: int | None = None) -> int:
    """How many partitions of about ``bytes_a_part`` a table makes, by the size that its plan states: ``least`` or more, by default (and where the plan states no size) as many as the session deals."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    dealt = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    return max(least or dealt, -(-size // bytes_a_part)) if size < 1 << 52 else dealt


class Scratch:
    """Writes tables to a folder of its own, so that lost executors cost no lineage, and deletes those no longer needed."""

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/sievelight-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = self.path()
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_scratch"] = path
        return out

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table."""
        if path := df.__dict__.pop("_scratch", None):
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
