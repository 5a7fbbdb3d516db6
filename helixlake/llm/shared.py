"""Tables in the folder that driver and executors share, and schema-safe inputs.

``saved`` cuts a plan's lineage: the rows are in Parquet under
``spark.checkpoint.dir``, so a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own setting: a job's shuffle files are removed when it ends, as nothing reads them after that.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local folder only for a one-machine master without one."""
    name = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if name:
        return name.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    name = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", name)
    return name


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def saved(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """df, written once to the shared folder and read back; the job's shuffle files go when it has ended. rows: most rows that Python workers get at once."""
    spark = df.sparkSession
    path, own = new_path(spark, tag), {CLEANUP: "true"} | ({} if rows is None else {BATCH: str(rows)})
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more."""
    for df in tables:
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            target = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, bool]:
    """A long that tells the rows of docs apart, and whether it is the id itself.

    It is the id where every row has one of its own. Else it is a hash of id and text, computed beside each row and
    checked to be distinct by a second hash, so no text moves; rows alike in id and text share it.
    """
    own, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    if docs.select(own.alias("i")).groupBy("i").agg(F.count("*").alias("n")).where("i is null or n > 1").isEmpty():
        return own, True
    seed = 0
    while True:
        key, other = (F.xxhash64(F.lit(seed + s), own.isNull(), own, text.isNull(), text) for s in (0, 1))
        both = docs.select(key.alias("k"), other.alias("o")).groupBy("k").agg(F.min("o").alias("lo"), F.max("o").alias("hi"))
        if both.where("lo < hi").isEmpty():
            return key, False
        seed += 2


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns can't clash with its own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
