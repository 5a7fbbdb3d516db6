"""Tables written to the folder that all executors share, to cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's own setting: a job's shuffle files are removed when it ends, as nothing reads them after that.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under spark.checkpoint.dir, deleted when the application ends; a local folder only for a one-machine master without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-store-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, tag: str = "table", path: str | None = None, rows: int | None = None, size: int | None = None) -> DataFrame:
    """df, written once and read back. path: where, if not at a fresh one; rows, size: most rows and bytes that Python workers get at once, in all of its steps."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    own = {CLEANUP: "true"} | ({} if rows is None else {BATCH: str(rows)}) | ({} if size is None else {BYTES: str(size)})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
