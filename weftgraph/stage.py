"""Tables written between stages, in the folder that all machines of a cluster share.

A written table cuts lineage: what reads it survives lost executors, sees the same rows each time, and starts from a
scan, so that adaptive execution can split its skewed joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset (a local session)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = f"file://{path}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftgraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns it as read from there.

    What was shuffled for it is given up once it is written, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def sorted_side(df: DataFrame) -> DataFrame:
    """df for a join that never sends it whole: Spark takes a table for as large as its compressed files, and sends small ones by the driver.

    For tables that grow with the input; names and numbers in order are compressed to a small part of what they fill in memory.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application staged; frames that read them are unusable afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftgraph-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
