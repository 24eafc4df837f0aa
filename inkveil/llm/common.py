"""What the operators share: reading, folds, written intermediates and batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.session import shared_dir

#: Rows of one Arrow batch. A batch of whole texts has to fit a Python worker, however long they are.
BATCH_ROWS = 500
#: Whether shuffle files go when the query that made them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that a Python worker gets at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``. A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, so that lost executors cost no recomputation.

    What was shuffled for it is needed no more then, and its files go at once; the session's setting returns.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that ``written`` gave, once all that was made of them is written itself."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        folders = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).getParent().toString() for f in df.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
