"""Session helpers that the operators of this folder share: the shared folder, materialised tables, cleaned input."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a small side that may be broadcast.  A side is counted first; beyond this it goes through a shuffle join.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor sees.  Only where that is unset in local mode
    (tests) a temporary folder takes its place, and the session is told; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = tempfile.mkdtemp(prefix="sievestone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sievestone/{uuid.uuid4().hex}"


#: Shuffle files of a statement go when it ends, as far as this Spark has the setting.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs only
    the tasks that it was running.  What was shuffled for it is deleted, so that the disk holds one step's at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows by count; else df itself, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased; every other character stays (lower() would also fold the Kelvin sign and the like)."""
    return F.translate(text, UPPER, UPPER.lower())


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds: long documents would make batches of 10,000 rows very large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
