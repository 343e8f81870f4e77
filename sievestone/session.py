"""Tables of intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="sievestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sievestone/{uuid.uuid4().hex}"


#: Shuffle files of a statement go when it ends, as far as this Spark has the setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that go to a task's Python at a time.
ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df there and read it back: iterative operators cut their lineage so, and what was shuffled for it is deleted.

    rows: as many go to Python functions of df at a time, where rows are large."""
    spark = df.sparkSession
    path, settings = shared_dir(spark), {CLEANUP: "true"} | ({ROWS: str(rows)} if rows else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df to be broadcast if it is counted as small, else as it is for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
