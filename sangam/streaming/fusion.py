"""Incremental fusion: new reports from a folder of files join existing clusters or found new ones, batch by batch.

A cluster never expires: two reports far apart in time can still score above the merge limit, so any time limit would be
an approximation and none is applied. State is a table of (id, founder) versions in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.operators.cluster import greedy


def read_reports(spark: SparkSession, folder: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def assign_new(new_ids: DataFrame, state: DataFrame, pairs: DataFrame, merge: float = 0.8) -> DataFrame:
    """(id, founder) of new records, given the clusters so far (id, founder) and pairs (a, b, score) that touch new records.

    New records are grouped by the clusters and records they can reach, so groups are small; ids decide ties."""
    import pandas as pd

    from sangam.operators.cluster import components

    strong = pairs.filter(F.col("score") >= merge)
    known = state.select(F.col("id").alias("x"), "founder")
    members = strong.select(F.col("a").alias("x")).union(strong.select("b")).distinct().join(known, "x")
    whole = members.select("founder").distinct().join(state, "founder")
    links = strong.select("a", "b").union(whole.select(F.col("founder").alias("a"), F.col("id").alias("b")).filter("a <> b"))
    comp = components(links)
    rows = strong.join(comp.withColumnRenamed("id", "a"), "a").select("component", "a", "b", "score", F.lit(None).cast("string").alias("founder"))
    olds = whole.join(comp, "id").select("component", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"), "founder")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        old = pdf[pdf["founder"].notna()]
        clusters: dict[str, list[str]] = {}
        for i, f in zip(old["a"], old["founder"]):
            clusters.setdefault(f, []).append(i)
        edges = pdf[pdf["founder"].isna()]
        score = {(min(a, b), max(a, b)): s for a, b, s in zip(edges["a"], edges["b"], edges["score"])}
        placed = {i for m in clusters.values() for i in m}
        out = []
        for r in sorted({x for p in score for x in p} - placed):
            best, at = None, r
            for f in sorted(clusters):
                s = [score.get((min(r, m), max(r, m)), 0.0) for m in clusters[f]]
                if min(s) >= merge and (best is None or sum(s) / len(s) > best):
                    best, at = sum(s) / len(s), f
            clusters.setdefault(at, []).append(r)
            out.append((r, at))
        return pd.DataFrame(out, columns=["id", "founder"])

    got = rows.union(olds).groupBy("component").applyInPandas(work, "id string, founder string")
    return new_ids.select("id").distinct().join(got, "id", "left").select("id", F.coalesce("founder", "id").alias("founder"))


def run(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None], trigger: dict | None = None):
    """Start the query: on_batch gets each micro-batch of distinct new reports; empty batches are skipped."""

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            on_batch(batch.dropDuplicates(["id"]), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["assign_new", "greedy", "read_reports", "run"]
