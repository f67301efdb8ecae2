"""Parquet tables by name, in one directory (a file or a folder of part files each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, spread over them before costly work on each row; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def distinct_reports(reports: DataFrame, *columns: str) -> DataFrame:
    """One row per report id with the given columns. Redelivered rows are exact copies, so any copy serves; the least one
    (in column order) is taken, which makes the choice deterministic even if copies differed."""
    from pyspark.sql import functions as F

    rest = [c for c in columns if c != "id"]
    if not rest:
        return reports.select("id").distinct()
    return reports.groupBy("id").agg(F.min(F.struct(*rest)).alias("_s")).select("id", *[F.col(f"_s.{c}").alias(c) for c in rest])
