"""Complete-linkage clusters of records from their pair scores, the same whatever the order of the input.

Records are taken by ascending id; each joins the cluster all of whose members score at least `merge` with it (the one of
highest mean score, then the oldest), or founds its own. Such a cluster lies inside one component of the graph of pairs
of at least `merge`, so components are worked independently; records without such a pair are clusters of their own and
never reach Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import durable


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component) by propagating the least id along edges and jumping to the label's own label; each round is written
    to the shared folder, so a lost executor costs one round at most."""
    e = durable(edges.select(F.col(a).alias("s"), F.col(b).alias("d")).union(edges.select(b, a)).distinct(), "edges")
    labels = durable(e.groupBy("s").agg(F.least(F.col("s"), F.min("d")).alias("l")).select(F.col("s").alias("id"), "l"), "labels")
    for _ in range(max_rounds):
        near = e.join(labels.withColumnRenamed("id", "d"), "d").groupBy("s").agg(F.min("l").alias("m"))
        jump = labels.select(F.col("id").alias("l"), F.col("l").alias("j"))
        new = labels.join(near.withColumnRenamed("s", "id"), "id").join(jump, "l", "left").select("id", "l", F.least("l", "m", F.coalesce("j", "l")).alias("n"))
        new = durable(new, "labels")
        if new.filter("n <> l").isEmpty():
            return new.select("id", F.col("n").alias("component"))
        labels = new.select("id", F.col("n").alias("l"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def greedy(ids: list[str], score: dict[tuple[str, str], float], merge: float) -> dict[str, str]:
    """Record -> founder of its cluster; pairs that are missing score 0. Only clusters of records that a record scores `merge` with are tried."""
    strong: dict[str, dict[str, float]] = {}
    for (a, b), s in score.items():
        if s >= merge:
            strong.setdefault(max(a, b), {})[min(a, b)] = s
    clusters: list[list[str]] = []
    of: dict[str, int] = {}
    for r in sorted(ids):
        near = strong.get(r, {})  # those before r
        best, at = None, len(clusters)
        for k in sorted({of[m] for m in near}):
            members = clusters[k]
            if len(members) <= len(near) and all(m in near for m in members):
                mean = sum(near[m] for m in members) / len(members)
                if best is None or mean > best:
                    best, at = mean, k
        if at == len(clusters):
            clusters.append([])
        clusters[at].append(r)
        of[r] = at
    return {m: c[0] for c in clusters for m in c}


def invalid_scores(pairs: DataFrame, score: str = "score") -> DataFrame:
    """Pairs whose score is null, not a number or outside [0, 1]."""
    s = F.col(score)
    return pairs.filter(s.isNull() | F.isnan(s) | (s < 0) | (s > 1))


def cluster(records: DataFrame, pairs: DataFrame, merge: float = 0.8) -> DataFrame:
    """records (id), pairs (a < b, score) -> (id, founder). Raises on invalid scores, as clamping them would hide errors."""
    checked = pairs.select("a", "b", F.when(F.isnan("score") | (F.col("score") < 0) | (F.col("score") > 1) | F.col("score").isNull(), F.raise_error(F.lit("pair score outside [0, 1]"))).otherwise(F.col("score").cast("double")).alias("score"))
    strong = durable(checked.filter(F.col("score") >= merge), "strong")
    comp = components(strong)
    inside = strong.join(comp.withColumnRenamed("id", "a"), "a")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        edges: dict = {}
        for c, a, b, s in zip(pdf["component"], pdf["a"], pdf["b"], pdf["score"]):
            edges.setdefault(c, {})[a, b] = s
        found: dict = {}
        for score in edges.values():
            found |= greedy({x for p in score for x in p}, score, merge)
        return pd.DataFrame({"id": list(found), "founder": list(found.values())})

    kind = records.schema["id"].dataType.simpleString()
    # many components a task, as most are of a few records
    n = strong.count() // 20_000 + 1
    bucket = F.pmod(F.xxhash64("component"), F.lit(n)).alias("bucket")
    grouped = inside.groupBy(bucket).applyInPandas(work, f"id {kind}, founder {kind}")
    return records.select("id").distinct().join(grouped, "id", "left").select("id", F.coalesce("founder", "id").alias("founder"))


def numbered(clusters: DataFrame, prefix: str = "INC-") -> DataFrame:
    """(id, founder) -> plus cluster_id numbered by founder: counts per hash bucket would break order, so the founders (one
    row a cluster) are ranked after a range shuffle."""
    founders = clusters.select("founder").distinct().repartitionByRange("founder").sortWithinPartitions("founder").withColumn("_p", F.spark_partition_id())
    founders = durable(founders.withColumn("_k", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33)), "founders")
    from pyspark.sql import Window

    sizes = founders.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    number = founders.join(F.broadcast(sizes), "_p").select("founder", (F.col("_before") + F.col("_k") + 1).alias("n"))
    return clusters.join(number, "founder").select("id", "founder", F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), F.greatest(F.lit(3), F.length(F.col("n").cast("string"))), F.lit("0"))).alias("cluster_id"))


def related(clusters: DataFrame, pairs: DataFrame, low: float = 0.6, high: float = 0.8) -> DataFrame:
    """(cluster_a < cluster_b, score): cluster pairs whose best cross score lies in [low, high)."""
    a, b = clusters.select(F.col("id").alias("a"), F.col("founder").alias("fa")), clusters.select(F.col("id").alias("b"), F.col("founder").alias("fb"))
    x = pairs.filter(F.col("score") >= low).join(a, "a").join(b, "b").filter("fa <> fb")
    x = x.groupBy(F.least("fa", "fb").alias("cluster_a"), F.greatest("fa", "fb").alias("cluster_b")).agg(F.max("score").alias("score"))
    return x.filter(F.col("score") < high)
