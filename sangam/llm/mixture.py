"""Mixing sources to target weights by systematic sampling.

A source of T tokens that is to give W tokens gives each of its documents W / T expected copies. Documents are put in a
fixed order (hash bucket, size, id), the expected copies are summed along it, one random offset a source is added, and a
document comes out once for every integer its stretch of the sum crosses: floor or ceiling of the expectation, never
more than max_repeats. Ranks come from bucket counts and a rank within the bucket, so a source of any size is ranked in
pieces of about `bucket_rows` documents.

The total is `total_tokens`, or else the largest total at which every source with documents can hold its share (shares
of sources without documents are spread over the others in proportion), but not less than `least_total` of all usable
tokens: below that a small source gives all it may (max_repeats copies of everything) and its report shows the gap.

Defined results: documents with a null source, a source not listed, or a null or blank text stay out; a listed source
without documents has 0 copies and share 0; a null or non-positive target or max_repeats gives 0 copies; equal ids are
separate documents.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.llm.tokens import BYTE_BPE_50K, TOKENIZERS, count_tokens
from sangam.session import broadcast_if_small, durable

MAX_SOURCES = 100_000


def plan(sources: dict[str, tuple[float, int, int]], total: float | None, least_total: float) -> dict[str, float]:
    """Expected copies per document of each source: {source: (share, max_repeats, tokens)} -> {source: copies}."""
    live = {s: (w, m, t) for s, (w, m, t) in sources.items() if t > 0 and w and w > 0 and m and m > 0}
    if not live:
        return {}
    weight = sum(w for w, _, _ in live.values())
    if total is None:
        every = min(m * t * weight / w for w, m, t in live.values())
        total = max(every, least_total * sum(t for _, _, t in live.values()))
    out: dict[str, float] = {}
    rest, left = dict(live), total
    while rest:  # sources that can't reach their part give all they may; the others share what is left
        weight = sum(w for w, _, _ in rest.values())
        short = {s: m for s, (w, m, t) in rest.items() if left * w / weight > m * t * (1 + 1e-12)}
        if not short:
            out |= {s: min(float(m), left * w / weight / t) for s, (w, m, t) in rest.items()}
            break
        for s, m in short.items():
            out[s] = float(m)
            left -= m * rest.pop(s)[2]
    return out


def mix(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    total_tokens: float | None = None,
    least_total: float = 0.5,
    seed: int = 17,
    bucket_rows: int = 100_000,
    tokenizer_dir: str = TOKENIZERS,
    vocabulary: str = BYTE_BPE_50K,
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: id, source, n_tokens, copies >= 1. report: one row per listed source."""
    spark = docs.sparkSession
    usable = docs.filter(F.col(source_col).isNotNull() & F.col(text_col).rlike(r"[^\s  -​ 　﻿]"))
    listed = targets.select(F.col("source").alias("_source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    usable = usable.join(F.broadcast(listed.select("_source").distinct().limit(MAX_SOURCES)), F.col(source_col) == F.col("_source"), "left_semi")
    sized = count_tokens(usable.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text", "n_tokens", tokenizer_dir, vocabulary)
    sized = durable(sized.filter("n_tokens > 0"), "sized")
    rows = listed.groupBy("_source").agg(F.first("target_share").alias("w"), F.first("max_repeats").alias("m")).join(
        sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), F.col("_source") == F.col("source"), "left"
    ).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    copies = plan({r["_source"]: (r["w"], r["m"], r["t"] or 0) for r in rows}, total_tokens, least_total)
    facts = [(r["_source"], copies.get(r["_source"], 0.0), int(r["m"] or 0), random.Random(f"{seed}:{r['_source']}").random(), max(1, -(-(r["n"] or 0) // bucket_rows))) for r in rows if r["_source"] is not None]
    rates = F.broadcast(spark.createDataFrame(facts, "source string, rate double, most int, offset double, buckets bigint"))
    d = sized.join(rates, "source").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
    before = d.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    d = d.join(broadcast_if_small(before, 200_000), ["source", "bucket"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "bucket").orderBy("n_tokens", "id"))
    crossed = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    d = d.withColumn("rank", rank).withColumn("copies", F.least(crossed, F.col("most").cast("bigint")).cast("int"))
    mixture = d.filter("copies > 0").select(F.col("id").alias(id_col), "source", "n_tokens", "copies")
    used = mixture.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("documents"))
    report = listed.withColumnRenamed("_source", "source").join(have, "source", "left").join(used, "source", "left").na.fill(0, ["documents", "documents_used", "tokens", "most_repeats"])
    total = used.agg(F.sum("tokens").alias("total"))
    report = report.join(F.broadcast(total)).withColumn("actual_share", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)).drop("total")
    return mixture, report
