"""Session helpers: the settings operators rely on, and a durable place to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "sangam", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; `conf` keys use `__` for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. A folder of this machine is made only for a local master: on a cluster
    the executors wouldn't share it, so a missing setting is an error there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sangam-cp-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` once into the shared checkpoint folder and read it back: lineage is cut and any executor may be lost.

    The tables of one session lie in one folder, `sangam-<application>`; clean_up() deletes it when no result is needed."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sangam-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete every table that durable() wrote in this session; results not yet read are lost."""
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/sangam-{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark `df` for broadcast when it is proven to hold at most `max_rows` rows; otherwise leave the strategy to the planner.
    Only a count reaches the driver. `df` is run for it, so give a table that is already written."""
    if df.select(df.columns[0]).limit(max_rows + 1).count() <= max_rows:
        return df.hint("broadcast")
    return df
