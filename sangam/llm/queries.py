"""Queries of the text problems, over whole tables, and the SQL of those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.llm import pii
from sangam.llm.canonical import canonicalise
from sangam.llm.language import fit, label_texts
from sangam.llm.mapping import map_values
from sangam.llm.mixture import mix
from sangam.llm.neardup import near_duplicate_classes, similar_pairs, word_sets
from sangam.llm.spans import shared_factors, shared_parts, shared_spans, sharing_pairs
from sangam.llm.tokens import encode_column
from sangam.session import durable
from sangam.sources.tables import table


def canonical_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of reports, redelivered ones too, with their canonical text."""
    return canonicalise(table(spark, sf_dir, "reports").select("id", "raw_text").filter("raw_text is not null"), "id", "raw_text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the gazetteer that each freely written location names, or `unmatched`."""
    e = table(spark, sf_dir, "extractions").filter("field_name = 'location_raw'").select(F.col("id").alias("extraction_id"), "value").distinct()
    m = map_values(e, F.col("value"), table(spark, sf_dir, "rampur"), "location_id", ["name_en", "name_hi", "name_hi_latn"], "aliases")
    return m.filter("entry is not null and not is_exact").groupBy("extraction_id").agg(F.min("entry").alias("location_id"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reports of at least 40 words whose sets of words have a Jaccard index of at least 0.8."""
    return similar_pairs(word_sets(canonical_reports(spark, sf_dir), "id", "canonical", 40), 0.8)


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per report of at least 40 words: its class of equal word sets and its number of linked classes."""
    return near_duplicate_classes(word_sets(canonical_reports(spark, sf_dir), "id", "canonical", 40), 0.8)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of reports with one canonical form and different raw texts. Texts are compared by 128-bit digests."""
    d = durable(canonical_reports(spark, sf_dir).select("id", F.md5("raw_text").alias("raw"), F.md5("canonical").alias("form")).distinct(), "forms")
    several = d.groupBy("form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).filter("a <> b").select("form")
    d = d.join(several, "form")
    a, b = d.select("form", F.col("id").alias("id_a"), F.col("raw").alias("raw_a")), d.select("form", F.col("id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, "form").filter("id_a < id_b and raw_a <> raw_b").select("id_a", "id_b")


def labelled_reports(spark: SparkSession, sf_dir: str, with_segments: bool) -> DataFrame:
    """All rows of reports, redelivered ones too."""
    r = table(spark, sf_dir, "reports").select("id", "raw_text", "language")
    return label_texts(r, "raw_text", fit(r, "id", "raw_text", "language"), with_segments=with_segments)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the whole sentences of each report whose label isn't exactly its only language."""
    d = labelled_reports(spark, sf_dir, False)
    right = (F.size("languages") == 1) & F.col("language").eqNullSafe(F.element_at("languages", 1))
    return d.filter((F.size("languages") > 0) & ~right).select("id", F.explode("languages").alias("language")).distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every report with its language and confidence."""
    d = labelled_reports(spark, sf_dir, True).select("id", F.explode("segments").alias("s")).distinct()
    return d.select("id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.language").alias("language"), F.round("s.confidence", 6).alias("confidence"))


def mentions_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "reports").select("id", "raw_text")
    return pii.find_mentions(r, "raw_text", pii.fit(r, "id", "raw_text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of personal information in the reports: kind and first character."""
    d = mentions_of_reports(spark, sf_dir).select("id", F.explode("mentions").alias("m"))
    return d.select("id", F.col("m.kind").alias("kind"), F.col("m.start").alias("start_pos")).distinct()


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report's text with typed placeholders for its mentions."""
    return mentions_of_reports(spark, sf_dir).select("id", F.size("mentions").alias("n_mentions"), "redacted").distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: each document that comes out, with its number of copies."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per listed source: target and actual share of the tokens, documents, repeats."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a common span of at least 240 code points."""
    return sharing_pairs(shared_factors(table(spark, sf_dir, "documents"), cover=False))


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document lies in spans of at least 240 code points shared with others."""
    docs = table(spark, sf_dir, "documents")
    return shared_parts(docs, shared_spans(docs))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p6_found": p6_found, "p6_segments": p6_segments, "p7_found": p7_found, "p7_redacted": p7_redacted, "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found, "p10_shares": p10_shares}
SQL: dict[str, str] = {}
