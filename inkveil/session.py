"""Session settings and the shared folder for data that has to outlive a stage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: The setting that names a folder shared by the driver and all executors.
SHARED = "spark.checkpoint.dir"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("inkveil")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without the setting falls back to a folder of this machine, one for the whole process.
    """
    root = spark.conf.get(SHARED, None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {SHARED} to a folder shared by the driver and all executors")
        root = _own_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@cache
def _own_folder() -> str:
    """The setting can't be changed in a running session, so the folder is kept here."""
    return tempfile.mkdtemp(prefix="inkveil-")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a plain scan that has fewer splits than there are cores.

    Inputs of any size have far more splits than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
