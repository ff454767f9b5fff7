"""The size of the batches in which rows reach Python."""

from __future__ import annotations

from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df itself; its session's Arrow batches are held to BATCH_BYTES, unless they are smaller already.

    Texts differ in length a thousandfold, so a bound on rows alone doesn't bound a worker's memory. Plans read the setting
    when they run, so it is lowered for the session and stays so; a smaller one (in any of Spark's units) is left alone.
    """
    spark = df.sparkSession
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_KEY))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_KEY, f"{BATCH_BYTES}b")
    return df
