"""Session defaults and the shared work folder.

Nothing here is needed when a session already exists: every operator takes its session from its DataFrame.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom").config("spark.driver.memory", memory)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a fresh local folder serves a local master; a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df once as a table in the shared folder and read it back: the lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_and_release(df: DataFrame) -> DataFrame:
    """cut, and the shuffle files that were needed for it go now, not when the driver next happens to collect its garbage."""
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out
