"""Session, table access and shared intermediate storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's settings; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(master).appName("terrane")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and the executors
    are this process (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not conf and known.isDefined():
        return known.get().rstrip("/")
    if not conf:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        conf = "file://" + os.path.join(tempfile.gettempdir(), "terrane-shared")
        spark.conf.set("spark.checkpoint.dir", conf)
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage is cut and lost executors recompute nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # removed when the driver's JVM ends
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what `materialize` wrote for `df`, once nothing reads it any more."""
    path = getattr(df, "_stage_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by `keys` when the scan gives fewer splits than there are cores; at scale the scan has more and nothing moves."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[F.col(k) for k in keys])
