"""Queries of the fusion engine over the report, extraction, incident and gazetteer tables, each beside its SQL.

Rows delivered twice are exact copies, so every query starts from distinct rows. Floats are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sangam.functions import patterns as P
from sangam.functions import text as X
from sangam.operators import pairs as E
from sangam.operators.geo import haversine_m, valid_position
from sangam.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def reports(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "reports").select(*cols).distinct()


def texts(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Reports, redelivered rows too, with column t: the normalised raw text. Make results distinct, not texts."""
    return table(spark, d, "reports").select("id", "raw_text", *cols).withColumn("t", X.normalise(F.col("raw_text")))


_SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1C}-\x{1F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(coalesce(raw_text, '')),
 '[\x{200B}\x{200C}\x{200D}\x{FEFF}]', '', 'g'), '""" + _SPACES + r"""', ' ', 'g'), '!{2,}', '!', 'g'), '\?{2,}', '?', 'g'), '\.{4,}', '...', 'g'), ' ')"""  # fmt: skip
_TEXTS = f"WITH x AS (SELECT DISTINCT id, raw_text, source, language FROM reports), t AS (SELECT *, {_NORM} AS t FROM x)"
_VALID = "coalesce(isfinite({a}) AND isfinite({b}) AND {a} BETWEEN -90 AND 90 AND {b} BETWEEN -180 AND 180, false)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h}))"


# ---- A: sources and scans


@query("scan_reports", "SELECT DISTINCT id, reporter_id, processed FROM reports")
def scan_reports(spark, d):
    return reports(spark, d, "id", "reporter_id", "processed")


@query("seed_upsert_anti", "SELECT DISTINCT id, source FROM reports r WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE e.report_id = r.id)")
def seed_upsert_anti(spark, d):
    return reports(spark, d, "id", "source").join(table(spark, d, "extractions").select(F.col("report_id").alias("id")), "id", "left_anti")


@query("gazetteer_aliases", "SELECT location_id, alias, count(*) AS n FROM (SELECT location_id, unnest(aliases) AS alias FROM rampur) GROUP BY ALL")
def gazetteer_aliases(spark, d):
    return table(spark, d, "rampur").select("location_id", F.explode("aliases").alias("alias")).groupBy("location_id", "alias").agg(F.count("*").alias("n"))


@query("list_reports", "SELECT DISTINCT id, reporter_id FROM reports WHERE processed AND lower(trim(source)) = 'sms'")
def list_reports(spark, d):
    return table(spark, d, "reports").filter(F.col("processed") & (F.lower(F.trim("source")) == "sms")).select("id", "reporter_id").distinct()


@query("health_counts", "SELECT (SELECT count(DISTINCT id) FROM reports) AS reports, (SELECT count(DISTINCT id) FROM incidents) AS incidents, (SELECT count(DISTINCT id) FROM extractions) AS extractions")
def health_counts(spark, d):
    # one partial aggregation a table; the three one-row results are summed side by side
    one = [table(spark, d, n).select("id").distinct().agg(F.count("*").alias("n")).withColumn("k", F.lit(n)) for n in ("reports", "incidents", "extractions")]
    return one[0].union(one[1]).union(one[2]).groupBy().pivot("k", ["reports", "incidents", "extractions"]).agg(F.sum("n"))


@query("extraction_fields", "SELECT field_name, count(*) AS n, count(value) AS n_value, round(avg(confidence), 6) AS mean_confidence FROM (SELECT DISTINCT id, report_id, field_name, value, confidence FROM extractions) GROUP BY field_name")
def extraction_fields(spark, d):
    e = table(spark, d, "extractions").select("id", "report_id", "field_name", "value", "confidence").distinct()
    return e.groupBy("field_name").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


# ---- B: normalisation


@query("normalize_text", _TEXTS + " SELECT id, t AS normalized FROM t")
def normalize_text(spark, d):
    return texts(spark, d).select("id", F.col("t").alias("normalized")).distinct()


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"


@query(
    "normalize_timestamp",
    rf"""WITH x AS (SELECT DISTINCT id, trim(received_at, ' ') AS s FROM reports), p AS (SELECT id,
 CASE WHEN regexp_matches(s, '{_ISO}') THEN epoch_us(TRY_CAST(replace(regexp_extract(s, '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d{{1,6}})?'), 'T', ' ') AS TIMESTAMP)) END AS u,
 replace(regexp_extract(s, '(Z|[+-]\d{{2}}:?\d{{2}})$'), ':', '') AS z FROM x)
SELECT id, CAST(u - CASE WHEN z = 'Z' THEN 0 WHEN z = '' OR z IS NULL THEN 330
 ELSE (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (CAST(z[2:3] AS BIGINT) * 60 + CAST(z[4:5] AS BIGINT)) END * 60000000 AS BIGINT) AS utc_us FROM p""",
)
def normalize_timestamp(spark, d):
    return reports(spark, d, "id", "received_at").select("id", utc_of("received_at").alias("utc_us"))


def utc_of(column: str):
    """Microseconds of an ISO time; without a zone it is Indian time; null for anything else."""
    s = F.trim(F.col(column))
    local = F.when(s.rlike(_ISO), F.unix_micros(F.regexp_extract(s, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?", 0).try_cast("timestamp")))
    z = F.replace(F.regexp_extract(s, r"(Z|[+-]\d{2}:?\d{2})$", 1), F.lit(":"), F.lit(""))
    minutes = F.when(z == "Z", 0).when(z == "", 330).otherwise(F.when(F.substring(z, 1, 1) == "-", -1).otherwise(1) * (F.substring(z, 2, 2).try_cast("bigint") * 60 + F.substring(z, 4, 2).try_cast("bigint")))
    return local - minutes.cast("bigint") * F.lit(60_000_000).cast("bigint")


_SRC = "lower(trim(source, ' '))"
_SPACED = f"trim(regexp_replace(replace(replace({_SRC}, '_', ' '), '-', ' '), ' +', ' ', 'g'), ' ')"
_SRC_MAP = "MAP {" + ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in P.SOURCES.items()) + "}"
_SOURCE = f"coalesce({_SRC_MAP}[{_SPACED}], {_SRC_MAP}[replace({_SPACED}, ' ', '_')], {_SRC})"


@query("normalize_source", f"SELECT id, {_SOURCE} AS channel FROM (SELECT DISTINCT id, source FROM reports)")
def normalize_source(spark, d):
    return reports(spark, d, "id", "source").select("id", X.source_name(F.col("source")).alias("channel"))


_HITS = "len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(raw_text, '')), '[a-z]+'), lambda w: list_contains([" + ", ".join(map(_lit, P.ROMANISED)) + "], w))))"
_LANG = rf"""CASE WHEN trim(coalesce(raw_text, ''), ' ') = '' THEN CASE WHEN trim(coalesce(language, ''), ' ') <> '' THEN language ELSE 'en' END
 WHEN trim(coalesce(language, ''), ' ') <> '' THEN CASE WHEN language = 'en' AND h THEN 'hi' WHEN language = 'hi' AND NOT h AND n >= 3 THEN 'hi-Latn' ELSE language END
 WHEN h THEN 'hi' WHEN n >= 3 THEN 'hi-Latn' ELSE 'en' END"""


@query("romanized_hits", f"SELECT id, CAST({_HITS} AS INT) AS hits FROM (SELECT DISTINCT id, raw_text FROM reports)")
def romanized_hits(spark, d):
    return table(spark, d, "reports").select("id", X.romanised_hits(F.col("raw_text")).alias("hits")).distinct()


@query("detect_language", rf"SELECT id, {_LANG} AS language FROM (SELECT *, {_HITS} AS n, regexp_matches(coalesce(raw_text, ''), '[\x{{0900}}-\x{{097F}}]') AS h FROM (SELECT DISTINCT id, raw_text, language FROM reports))")
def detect_language(spark, d):
    return table(spark, d, "reports").select("id", X.language_by_rules(F.col("raw_text"), F.col("language")).alias("language")).distinct()


@query("normalize_reports", rf"""WITH x AS (SELECT DISTINCT id, raw_text, source, language FROM reports), y AS (SELECT *, {_HITS} AS n, regexp_matches(coalesce(raw_text, ''), '[\x{{0900}}-\x{{097F}}]') AS h FROM x)
SELECT id, {_NORM} AS normalized, {_SOURCE} AS channel, {_LANG} AS language FROM y""")
def normalize_reports(spark, d):
    r = texts(spark, d, "source", "language")
    return r.select("id", F.col("t").alias("normalized"), X.source_name(F.col("source")).alias("channel"), X.language_by_rules(F.col("raw_text"), F.col("language")).alias("language")).distinct()


# ---- D: places


@query("valid_coordinates", f"SELECT id, {_VALID.format(a='gps_lat', b='gps_lon')} AS valid FROM (SELECT DISTINCT id, gps_lat, gps_lon FROM reports)")
def valid_coordinates(spark, d):
    return reports(spark, d, "id", "gps_lat", "gps_lon").select("id", valid_position(F.col("gps_lat"), F.col("gps_lon")).alias("valid"))


_BOTH = f"{_VALID.format(a='gps_lat', b='gps_lon')} AND {_VALID.format(a='location_lat', b='location_lon')}"
_DIST = _hav("gps_lat", "gps_lon", "location_lat", "location_lon")


@query("haversine", f"SELECT id, round({_DIST}, 3) AS distance_m FROM (SELECT DISTINCT id, gps_lat, gps_lon, location_lat, location_lon FROM reports) WHERE {_BOTH}")
def haversine(spark, d):
    r = reports(spark, d, "id", "gps_lat", "gps_lon", "location_lat", "location_lon")
    r = r.filter(valid_position(F.col("gps_lat"), F.col("gps_lon")) & valid_position(F.col("location_lat"), F.col("location_lon")))
    return r.select("id", F.round(haversine_m(*map(F.col, ("gps_lat", "gps_lon", "location_lat", "location_lon"))), 3).alias("distance_m"))


@query("gps_text_conflict", f"SELECT location_resolved, count(*) AS reports, count(*) FILTER (WHERE {_DIST} >= 2000) AS conflicts FROM (SELECT DISTINCT id, location_resolved, gps_lat, gps_lon, location_lat, location_lon FROM reports) WHERE {_BOTH} GROUP BY 1")
def gps_text_conflict(spark, d):
    r = reports(spark, d, "id", "location_resolved", "gps_lat", "gps_lon", "location_lat", "location_lon")
    r = r.filter(valid_position(F.col("gps_lat"), F.col("gps_lon")) & valid_position(F.col("location_lat"), F.col("location_lon")))
    dist = haversine_m(*map(F.col, ("gps_lat", "gps_lon", "location_lat", "location_lon")))
    return r.groupBy("location_resolved").agg(F.count("*").alias("reports"), F.count_if(dist >= 2000).alias("conflicts"))


_DECODED = "CASE WHEN json_valid(value) THEN value ->> '$' ELSE value END"


def decoded(c: str = "value"):
    """JSON text decoded, with the text itself where it isn't JSON."""
    v = F.try_parse_json(F.col(c))
    return F.when(v.isNull(), F.col(c)).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.when(F.is_variant_null(v), F.lit(None).cast("string")).otherwise(F.to_json(v))))


@query("extraction_decode", f"SELECT DISTINCT id, {_DECODED} AS place FROM extractions WHERE field_name = 'location_raw'")
def extraction_decode(spark, d):
    return table(spark, d, "extractions").filter("field_name = 'location_raw'").select("id", decoded().alias("place")).distinct()


_PHRASE = r"lower(trim(regexp_replace(nfc_normalize({0}), '[\s,;:.!?()]+', ' ', 'g'), ' '))"


def phrase(c):
    return F.lower(F.trim(F.regexp_replace(X.nfc(c), r"[\s,;:.!?()]+", " ")))


_TARGETS = f"""targets AS (SELECT location_id, 0 AS ord, {_PHRASE.format('name_en')} AS p FROM rampur UNION ALL SELECT location_id, 1, {_PHRASE.format('name_hi')} FROM rampur
 UNION ALL SELECT location_id, 2, {_PHRASE.format('name_hi_latn')} FROM rampur UNION ALL SELECT location_id, 3, {_PHRASE.format('a')} FROM (SELECT location_id, unnest(aliases) AS a FROM rampur))"""


def targets(spark, d) -> DataFrame:
    g = table(spark, d, "rampur")
    names = F.array(*[F.struct(F.lit(k).alias("ord"), F.col(c).alias("s")) for k, c in enumerate(("name_en", "name_hi", "name_hi_latn"))])
    t = g.select("location_id", F.explode(F.concat(names, F.transform("aliases", lambda a: F.struct(F.lit(3).alias("ord"), a.alias("s"))))).alias("t"))
    return t.select("location_id", "t.ord", phrase(F.col("t.s")).alias("p"))


def exact_places(spark, d) -> DataFrame:
    """(extraction_id, location_id): places whose folded name the phrase equals, by name before alias."""
    e = extraction_decode(spark, d).select(F.col("id").alias("extraction_id"), phrase(F.col("place")).alias("p")).filter("p <> ''")
    best = targets(spark, d).groupBy("p").agg(F.min(F.struct("ord", "location_id")).alias("m")).select("p", "m.location_id")
    return e.join(best, "p").select("extraction_id", "location_id")


_EXACT = f"""e AS (SELECT DISTINCT id AS extraction_id, {_PHRASE.format('(' + _DECODED + ')')} AS p FROM extractions WHERE field_name = 'location_raw'), {_TARGETS},
 best AS (SELECT p, (min(struct_pack(ord := ord, location_id := location_id))).location_id AS location_id FROM targets GROUP BY p), exact AS (SELECT extraction_id, location_id FROM e JOIN best USING (p) WHERE p <> '')"""


@query("gazetteer_exact", f"WITH {_EXACT} SELECT extraction_id, location_id FROM exact")
def gazetteer_exact(spark, d):
    return exact_places(spark, d)


@query("resolve_location", f"""WITH {_EXACT}, x AS (SELECT DISTINCT id, gps_lat, gps_lon, {_VALID.format(a='gps_lat', b='gps_lon')} AS ok FROM reports),
 l AS (SELECT report_id AS id, min(location_id) AS place FROM exact JOIN (SELECT DISTINCT id AS extraction_id, report_id FROM extractions) USING (extraction_id) GROUP BY 1)
SELECT id, CASE WHEN ok THEN 'gps' WHEN place IS NOT NULL THEN 'exact' ELSE 'unresolved' END AS method, CASE WHEN NOT ok THEN place END AS location_id,
 CAST(CASE WHEN ok THEN 100 WHEN place IS NOT NULL THEN 90 ELSE 0 END AS INT) AS confidence FROM x LEFT JOIN l USING (id)""")
def resolve_location(spark, d):
    e = table(spark, d, "extractions").select(F.col("id").alias("extraction_id"), "report_id").distinct()
    place = exact_places(spark, d).join(e, "extraction_id").groupBy(F.col("report_id").alias("id")).agg(F.min("location_id").alias("place"))
    r = reports(spark, d, "id", "gps_lat", "gps_lon").withColumn("ok", valid_position(F.col("gps_lat"), F.col("gps_lon"))).join(place, "id", "left")
    method = F.when(F.col("ok"), "gps").when(F.col("place").isNotNull(), "exact").otherwise("unresolved")
    return r.select("id", method.alias("method"), F.when(~F.col("ok"), F.col("place")).alias("location_id"), F.when(F.col("ok"), 100).when(F.col("place").isNotNull(), 90).otherwise(0).alias("confidence"))


# ---- E: vectors and pair scores


@query("embedding_json_roundtrip", "SELECT vec_id, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")
def embedding_json_roundtrip(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.from_json(F.to_json(F.transform("embedding", lambda x: x.cast("double"))), "array<double>").alias("v"))
    return e.select("vec_id", F.size("v").cast("bigint").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("cosine_top5", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id, round(greatest(0, least(1, list_cosine_similarity(q.e, r.e))), 6) AS cosine
 FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) SELECT query_id, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS k FROM s) WHERE k <= 5""")
def cosine_top5(spark, d, k: int = 5, block: int = 1024):
    """The k nearest of every vector whose id is divisible by 20, against all vectors, in packed blocks: each task multiplies a
    block of queries with a block of rows and keeps k a query, so only k rows a query and block are shuffled."""
    import numpy as np
    import pandas as pd

    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")).distinct()
    n_q = max(1, e.filter("vec_id % 20 = 0").count() // block + 1)
    n_r = max(1, e.count() // (4 * block) + 1)
    q = e.filter("vec_id % 20 = 0").select(F.lit("q").alias("side"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).alias("qb")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = e.select(F.lit("r").alias("side"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_r)).alias("rb")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == "q"], pdf[pdf["side"] == "r"]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        x, y = np.stack(a["v"].to_list()), np.stack(b["v"].to_list())
        nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        c = np.clip(x @ y.T / np.maximum(nx[:, None] * ny[None, :], 1e-300), 0, 1).round(9)
        qi, ri = a["vec_id"].to_numpy(), b["vec_id"].to_numpy()
        out = []
        for i in range(len(qi)):
            order = np.lexsort((ri, -c[i].round(6)))[: k + 1]
            out += [(qi[i], ri[j], float(c[i, j])) for j in order if ri[j] != qi[i]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "cosine"])

    best = q.unionByName(r).groupBy("qb", "rb").applyInPandas(near, "query_id bigint, vec_id bigint, cosine double").withColumn("cosine", F.round("cosine", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return best.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= k).select("query_id", "vec_id", "cosine")


def pair_inputs(spark, d, any_format: bool = False) -> DataFrame:
    """(id, place, lat, lon, us, kind, e) of every report: a null location falls back to the GPS position, a null received_at_utc to
    received_at (ISO, or with any_format whatever one instant it reads as); e is the vector of the text."""
    from sangam.operators.timestamps import normalise_timestamps
    from sangam.operators.vectors import word_vectors
    from sangam.plans.problems import channel
    from sangam.session import durable

    kind = table(spark, d, "extractions").filter("field_name = 'incident_type'").select(F.col("report_id").alias("id"), decoded().alias("kind")).groupBy("id").agg(F.max("kind").alias("kind"))
    r = table(spark, d, "reports")
    text = X.normalise(F.col("raw_text")) if "raw_text" in r.columns else F.lit(None).cast("string")
    r = spread(r).select("id", "source", "location_resolved", "location_lat", "location_lon", "gps_lat", "gps_lon", "received_at", "received_at_utc", word_vectors(text).alias("e")).distinct()
    if any_format:  # written once, else the mixture's fit would make all vectors too
        r = normalise_timestamps(durable(r, "read"), "received_at", channel(), day_first=True, default_zone="Asia/Kolkata")
    else:
        r = r.withColumn("utc_us", utc_of("received_at"))
    us = F.coalesce(F.unix_micros("received_at_utc"), "utc_us")
    return r.select("id", F.col("location_resolved").alias("place"), F.coalesce("location_lat", "gps_lat").alias("lat"), F.coalesce("location_lon", "gps_lon").alias("lon"), us.alias("us"), "e").join(kind, "id", "left")


def scored_pairs(spark, d, least: float = 0.6) -> DataFrame:
    return E.linked_pairs(pair_inputs(spark, d), least)


_VALID_AT = _VALID.format(a="lat", b="lon")
_VECTORS = """tx AS (SELECT DISTINCT id, """ + _NORM + """ AS t FROM reports), w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{M}\\p{N}]{4,}')) AS w FROM tx), hs AS (SELECT id, CAST('0x' || md5(w)[1:4] AS INT) AS h FROM w),
 bins AS (SELECT id, h % 64 AS b, sum(1 - 2 * ((h // 64) % 2)) AS x FROM hs GROUP BY ALL),
 vec AS (SELECT i.id, list(CAST(greatest(-127, least(127, coalesce(x, 0))) AS DOUBLE) ORDER BY r.b) AS e FROM (SELECT DISTINCT id FROM tx) i CROSS JOIN (SELECT unnest(range(64)) AS b) r LEFT JOIN bins ON bins.id = i.id AND bins.b = r.b GROUP BY i.id)"""
_REL = " OR ".join(f"(least(a.kind, b.kind) = {_lit(min(p))} AND greatest(a.kind, b.kind) = {_lit(max(p))})" for p in P.RELATED_TYPES)
#: every pair of reports, without any limit of space or time
_SCORED = f"""{_VECTORS}, nt AS ({SQL["normalize_timestamp"]}), k AS (SELECT report_id AS id, nullif(lower(trim(max({_DECODED}))), '') AS kind FROM extractions WHERE field_name = 'incident_type' GROUP BY 1),
 r0 AS (SELECT DISTINCT id, nullif(location_resolved, '') AS place, coalesce(location_lat, gps_lat) AS lat, coalesce(location_lon, gps_lon) AS lon, epoch_us(received_at_utc) AS stored FROM reports),
 r AS (SELECT r0.id, place, CASE WHEN {_VALID_AT} THEN lat END AS lat, CASE WHEN {_VALID_AT} THEN lon END AS lon, coalesce(stored, nt.utc_us) AS us, kind, e, sqrt(list_dot_product(e, e)) AS nrm FROM r0 JOIN vec USING (id) LEFT JOIN nt USING (id) LEFT JOIN k USING (id)),
 p AS (SELECT a.id AS id_a, b.id AS id_b, CASE WHEN a.nrm > 0 AND b.nrm > 0 THEN greatest(0, least(1, list_dot_product(a.e, b.e) / (a.nrm * b.nrm))) ELSE 0 END AS sem,
  CASE WHEN a.lat IS NULL OR b.lat IS NULL THEN 0 WHEN a.place = b.place THEN 1 ELSE greatest(0, 1 - {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 2000) END AS geo,
  CASE WHEN abs(a.us - b.us) <= 3e8 THEN 1 WHEN abs(a.us - b.us) <= 5.4e9 THEN 1 - (abs(a.us - b.us) / 6e7 - 5) / 85 ELSE 0 END AS tmp, CASE WHEN a.kind = b.kind THEN 1 WHEN {_REL} THEN 0.5 ELSE 0 END AS typ FROM r a JOIN r b ON a.id < b.id),
 s AS (SELECT * FROM (SELECT *, round(sem * 0.4 + geo * 0.3 + tmp * 0.15 + typ * 0.15, 9) AS score FROM p) WHERE score >= 0.6)"""  # fmt: skip


def _factor(name: str):
    def run(spark, d):
        return scored_pairs(spark, d).select("id_a", "id_b", F.round(name, 6).alias(name))

    run.__doc__ = f"The factor {name} of every pair that scores at least 0.6."
    return run


for _key, _name in (("geo_score_pairs", "geo"), ("temporal_score_pairs", "tmp"), ("type_score_pairs", "typ")):
    query(_key, f"WITH {_SCORED} SELECT id_a, id_b, CAST(round({_name}, 6) AS DOUBLE) AS {_name} FROM s")(_factor(_name))


@query("pairwise_match", f"WITH {_SCORED} SELECT id_a, id_b, round(sem, 6) AS sem, CAST(round(geo, 6) AS DOUBLE) AS geo, CAST(round(tmp, 6) AS DOUBLE) AS tmp, CAST(typ AS DOUBLE) AS typ, round(score, 6) AS score FROM s")
def pairwise_match(spark, d):
    """All pairs of reports that score at least 0.6, with every factor."""
    return scored_pairs(spark, d).select("id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("sem", "geo", "tmp", "typ", "score")])


@query("match_score_bands", f"WITH {_SCORED} SELECT CASE WHEN score >= 0.8 THEN 'merge' ELSE 'related' END AS band, count(*) AS pairs FROM s GROUP BY 1")
def match_score_bands(spark, d):
    return scored_pairs(spark, d).select(F.when(F.col("score") >= 0.8, "merge").otherwise("related").alias("band")).groupBy("band").agg(F.count("*").alias("pairs"))


# ---- F: clusters


def linked(spark, d) -> DataFrame:
    """All pairs of reports that score at least 0.6. No report is left out."""
    return E.linked_pairs(pair_inputs(spark, d, any_format=True), 0.6)


def clustered(spark, d, merge: float = 0.8):
    from sangam.operators.cluster import cluster
    from sangam.session import durable

    pairs = durable(linked(spark, d).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "score"), "pairs")
    return durable(cluster(reports(spark, d, "id"), pairs, merge), "clusters"), pairs


@query("cluster_reports")
def cluster_reports(spark, d):
    from sangam.operators.cluster import numbered

    return numbered(clustered(spark, d)[0])


@query("cluster_stats")
def cluster_stats(spark, d):
    c, pairs = clustered(spark, d)
    a, b = c.select(F.col("id").alias("a"), F.col("founder").alias("fa")), c.select(F.col("id").alias("b"), F.col("founder").alias("fb"))
    inner = pairs.join(a, "a").join(b, "b").filter("fa = fb").groupBy(F.col("fa").alias("founder")).agg(F.min("score").alias("least"), F.avg("score").alias("mean"))
    size = c.groupBy("founder").agg(F.count("*").alias("size"))
    return size.join(inner, "founder", "left").select("founder", "size", F.round(F.coalesce("least", F.lit(1.0)), 6).alias("least"), F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("mean"))


@query("related_clusters")
def related_clusters(spark, d):
    from sangam.operators.cluster import related

    c, pairs = clustered(spark, d)
    return related(c, pairs)


@query("duplicate_ids", "SELECT id, count(*) AS n FROM reports GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "reports").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


@query("invalid_scores", "SELECT DISTINCT id, match_score FROM incident_reports WHERE match_score IS NULL OR isnan(match_score) OR match_score < 0 OR match_score > 1")
def invalid_scores(spark, d):
    from sangam.operators.cluster import invalid_scores as bad

    return bad(table(spark, d, "incident_reports").select("id", "match_score"), "match_score").distinct()


@query("incident_links", "SELECT incident_id, count(*) AS reports, sum(CAST(round(coalesce(match_score, 1) * 1000) AS BIGINT))::BIGINT AS score_milli, min(report_id) AS first_report FROM (SELECT DISTINCT incident_id, report_id, match_score FROM incident_reports) GROUP BY 1")
def incident_links(spark, d):
    l = table(spark, d, "incident_reports").select("incident_id", "report_id", "match_score").distinct()
    return l.groupBy("incident_id").agg(F.count("*").alias("reports"), F.sum(F.round(F.coalesce("match_score", F.lit(1.0)) * 1000).cast("bigint")).alias("score_milli"), F.min("report_id").alias("first_report"))


# ---- G: members of incidents (contradictions: records.py)


def members(spark, d) -> DataFrame:
    return table(spark, d, "incident_reports").select("incident_id", F.col("report_id").alias("id")).distinct()


_MEMBERS = "m AS (SELECT DISTINCT incident_id, report_id AS id FROM incident_reports)"
# ---- H: assessment


def priority_of(sev, conf):
    raw = sev * (0.4 + 0.6 * conf)
    return F.when((conf < 0.3) & (raw > 69), 69.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)))




# ---- I, L: the query surface


@query("incident_queue", """SELECT i.id, i.status, round(i.priority, 6) AS priority, coalesce(n.n, 0) AS reports FROM (SELECT DISTINCT id, status, priority, urgency, location_resolved FROM incidents) i
 LEFT JOIN (SELECT incident_id, count(DISTINCT report_id) AS n FROM incident_reports GROUP BY 1) n ON n.incident_id = i.id WHERE i.priority >= 40 AND lower(i.location_resolved) LIKE '%tola%'""")
def incident_queue(spark, d):
    n = members(spark, d).groupBy("incident_id").agg(F.count("*").alias("n"))
    i = table(spark, d, "incidents").select("id", "status", "priority", "urgency", "location_resolved").distinct().filter((F.col("priority") >= 40) & F.col("location_resolved").ilike("%tola%"))
    return i.join(n, i["id"] == n["incident_id"], "left").select("id", "status", F.round("priority", 6).alias("priority"), F.coalesce("n", F.lit(0)).alias("reports"))


@query("incident_topk", "SELECT id, round(priority, 6) AS priority FROM (SELECT DISTINCT id, priority FROM incidents WHERE priority IS NOT NULL) ORDER BY priority DESC, id LIMIT 50")
def incident_topk(spark, d):
    """The report of the 50 most pressing incidents."""
    i = table(spark, d, "incidents").select("id", "priority").dropna().distinct()
    return i.orderBy(F.desc("priority"), "id").limit(50).select("id", F.round("priority", 6).alias("priority"))


@query("incident_detail", """SELECT i.id, i.title, count(DISTINCT m.report_id) AS reports, count(DISTINCT r.source) AS sources, coalesce(bool_or(r.location_conflict), false) AS conflict FROM (SELECT DISTINCT id, title FROM incidents) i
 LEFT JOIN incident_reports m ON m.incident_id = i.id LEFT JOIN (SELECT DISTINCT id, source, location_conflict FROM reports) r ON r.id = m.report_id GROUP BY 1, 2""")
def incident_detail(spark, d):
    r = reports(spark, d, "id", "source", "location_conflict").join(members(spark, d), "id", "right")
    g = r.groupBy("incident_id").agg(F.count("*").alias("reports"), F.count_distinct("source").alias("sources"), F.bool_or("location_conflict").alias("c"))
    i = table(spark, d, "incidents").select("id", "title").distinct().join(g, F.col("id") == F.col("incident_id"), "left")
    return i.select("id", "title", F.coalesce("reports", F.lit(0)).alias("reports"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("c", F.lit(False)).alias("conflict"))


@query("incident_reports", "SELECT DISTINCT incident_id, r.id, r.source FROM incident_reports m JOIN reports r ON r.id = m.report_id")
def incident_reports(spark, d):
    return reports(spark, d, "id", "source").join(members(spark, d), "id").select("incident_id", "id", "source")


@query("audit_trail", "SELECT incident_id, count(*) AS entries, max(epoch_us(timestamp_utc)) AS last_us, arg_max(action, struct_pack(t := timestamp_utc, i := id)) AS last_action FROM (SELECT DISTINCT * FROM audit_logs) GROUP BY 1")
def audit_trail(spark, d):
    a = table(spark, d, "audit_logs").distinct()
    return a.groupBy("incident_id").agg(F.count("*").alias("entries"), F.max(F.unix_micros("timestamp_utc")).alias("last_us"), F.max_by("action", F.struct("timestamp_utc", "id")).alias("last_action"))


@query("unassigned_reports", "SELECT DISTINCT id, reporter_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM incident_reports m WHERE m.report_id = r.id)")
def unassigned_reports(spark, d):
    return reports(spark, d, "id", "reporter_id").join(members(spark, d).select("id"), "id", "left_anti")


@query("reprocess_eligible", "SELECT DISTINCT id FROM incidents i WHERE status = 'unverified' AND NOT EXISTS (SELECT 1 FROM audit_logs a WHERE a.incident_id = i.id)")
def reprocess_eligible(spark, d):
    return table(spark, d, "incidents").filter("status = 'unverified'").select("id").distinct().join(table(spark, d, "audit_logs").select(F.col("incident_id").alias("id")), "id", "left_anti")


@query("status_fold", "SELECT i.id, coalesce(a.last_action, 'none') AS last_action FROM (SELECT DISTINCT id FROM incidents) i LEFT JOIN (SELECT incident_id, arg_max(action, struct_pack(t := timestamp_utc, i := id)) AS last_action FROM audit_logs GROUP BY 1) a ON a.incident_id = i.id")
def status_fold(spark, d):
    a = table(spark, d, "audit_logs").groupBy("incident_id").agg(F.max_by("action", F.struct("timestamp_utc", "id")).alias("last_action"))
    return table(spark, d, "incidents").select("id").distinct().join(a, F.col("id") == F.col("incident_id"), "left").select("id", F.coalesce("last_action", F.lit("none")).alias("last_action"))


@query("queue_search", "SELECT DISTINCT id, urgency FROM incidents WHERE contains(lower(concat_ws(' ', id, location_resolved, title)), 'ghat')")
def queue_search(spark, d):
    return table(spark, d, "incidents").filter(F.contains(F.lower(F.concat_ws(" ", "id", "location_resolved", "title")), F.lit("ghat"))).select("id", "urgency").distinct()


@query("summary_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'unverified') AS unverified, count(*) FILTER (WHERE urgency = 'critical') AS critical, count(*) FILTER (WHERE urgency = 'high') AS high, count(*) FILTER (WHERE priority IS NULL) AS unscored FROM (SELECT DISTINCT id, status, urgency, priority FROM incidents)")
def summary_counts(spark, d):
    i = table(spark, d, "incidents").select("id", "status", "urgency", "priority").distinct()
    return i.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "unverified").alias("unverified"), F.count_if(F.col("urgency") == "critical").alias("critical"), F.count_if(F.col("urgency") == "high").alias("high"), F.count_if(F.col("priority").isNull()).alias("unscored"))


_ZONE = "CASE WHEN location_resolved LIKE 'GPS%' OR location_resolved IS NULL THEN 'outskirts' ELSE split_part(lower(trim(location_resolved, ' ')), ' ', -1) END"


def zone():
    return F.when(F.col("location_resolved").startswith("GPS") | F.col("location_resolved").isNull(), "outskirts").otherwise(F.split_part(F.lower(F.trim("location_resolved")), F.lit(" "), F.lit(-1)))


@query("zone_distribution", f"SELECT {_ZONE} AS zone, count(*) AS incidents FROM (SELECT DISTINCT id, location_resolved FROM incidents) GROUP BY 1")
def zone_distribution(spark, d):
    return table(spark, d, "incidents").select("id", "location_resolved").distinct().groupBy(zone().alias("zone")).agg(F.count("*").alias("incidents"))


@query("zone_marker_layout", f"WITH z AS (SELECT id, {_ZONE} AS zone FROM (SELECT DISTINCT id, location_resolved FROM incidents)), k AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY zone) AS n FROM z) SELECT id, zone, round(cos(2 * pi() * k / n), 6) + 0.0 AS dx, round(sin(2 * pi() * k / n), 6) + 0.0 AS dy FROM k")
def zone_marker_layout(spark, d):
    z = table(spark, d, "incidents").select("id", "location_resolved").distinct().select("id", zone().alias("zone"))
    z = z.withColumn("k", F.row_number().over(Window.partitionBy("zone").orderBy("id")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("zone")))
    a = 2 * F.pi() * F.col("k") / F.col("n")
    return z.select("id", "zone", (F.round(F.cos(a), 6) + 0.0).alias("dx"), (F.round(F.sin(a), 6) + 0.0).alias("dy"))


# ---- further sources, sinks and grouped results


@query("links_append_once", "SELECT DISTINCT incident_id, report_id FROM incident_reports a WHERE match_score IS NULL AND NOT EXISTS (SELECT 1 FROM incident_reports b WHERE b.match_score IS NOT NULL AND b.incident_id = a.incident_id AND b.report_id = a.report_id)")
def links_append_once(spark, d):
    """Links that an idempotent append would add to those that are scored: each key once, none that is there."""
    l = table(spark, d, "incident_reports")
    return l.filter("match_score is null").select("incident_id", "report_id").distinct().join(l.filter("match_score is not null"), ["incident_id", "report_id"], "left_anti")


@query("next_incident_number", "WITH n AS (SELECT DISTINCT TRY_CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT) AS n FROM incidents) SELECT min(n + 1) AS next FROM n WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n b WHERE b.n = n.n + 1)".replace("\\\\", "\\"))
def next_incident_number(spark, d):
    n = table(spark, d, "incidents").select(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint").alias("n")).dropna().distinct()
    return n.select((F.col("n") + 1).alias("n")).join(n, "n", "left_anti").agg(F.min("n").alias("next"))


@query("note_carryover", """SELECT i.id, a.notes FROM (SELECT DISTINCT id FROM incidents) i LEFT JOIN (SELECT incident_id, arg_max(notes, struct_pack(t := timestamp_utc, i := id)) AS notes FROM audit_logs WHERE notes <> '' GROUP BY 1) a ON a.incident_id = i.id""")
def note_carryover(spark, d):
    """The latest note of each incident, carried to its current version; incidents without one keep null."""
    a = table(spark, d, "audit_logs").filter("notes <> ''").groupBy("incident_id").agg(F.max_by("notes", F.struct("timestamp_utc", "id")).alias("notes"))
    return table(spark, d, "incidents").select("id").distinct().join(a, F.col("id") == F.col("incident_id"), "left").select("id", "notes")


@query("extraction_display", """SELECT DISTINCT id, CASE WHEN NOT json_valid(value) THEN value WHEN value ->> '$.count' IS NOT NULL THEN concat(value ->> '$.count', ' ', coalesce(value ->> '$.category', 'people'))
 WHEN value ->> '$.count_min' IS NOT NULL THEN concat(value ->> '$.count_min', '-', value ->> '$.count_max', ' ', coalesce(value ->> '$.category', 'people')) ELSE replace(value ->> '$', '_', ' ') END AS shown FROM extractions WHERE field_name <> 'location_raw'""")
def extraction_display(spark, d):
    j = lambda p: F.get_json_object("value", p)
    cat = F.coalesce(j("$.category"), F.lit("people"))
    shown = F.when(F.try_parse_json(F.col("value")).isNull(), F.col("value")).when(j("$.count").isNotNull(), F.concat(j("$.count"), F.lit(" "), cat)).when(j("$.count_min").isNotNull(), F.concat(j("$.count_min"), F.lit("-"), j("$.count_max"), F.lit(" "), cat)).otherwise(F.replace(decoded(), F.lit("_"), F.lit(" ")))
    return table(spark, d, "extractions").filter("field_name <> 'location_raw'").select("id", shown.alias("shown")).distinct()


@query("gazetteer_fuzzy")
def gazetteer_fuzzy(spark, d, least: float = 0.75, apart: float = 0.05):
    """Distinct phrases without an exact place -> the place of highest ratio, null where the second best is too near.

    Every phrase is compared with every target: the gazetteer travels with the tasks (error beyond 100,000 targets)."""
    from sangam.operators.vectors import ratios

    e = extraction_decode(spark, d).select(phrase(F.col("place")).alias("phrase")).filter("phrase <> ''").distinct()
    t = targets(spark, d).select("location_id", "p").distinct()
    e = e.join(t.select(F.col("p").alias("phrase")), "phrase", "left_anti")
    names = [tuple(r) for r in t.filter("p is not null").orderBy("location_id", "p").limit(100_001).collect()]
    if len(names) > 100_000:
        raise ValueError("more than 100,000 targets")
    s = ratios(e.repartition("phrase"), "phrase", names, least)
    best = s.groupBy("phrase", "location_id").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    top = best.groupBy("phrase").agg(F.max(F.struct("score", "location_id")).alias("m"), F.count("*").alias("candidates"))
    near = best.join(top.select("phrase", F.col("m.score").alias("top")), "phrase").filter(F.col("score") >= F.col("top") - apart).groupBy("phrase").agg(F.count("*").alias("rivals"))
    return top.join(near, "phrase").select("phrase", F.when(F.col("rivals") == 1, F.col("m.location_id")).alias("location_id"), F.round("m.score", 4).alias("score"), "candidates")


@query("embed_reports")
def embed_reports(spark, d):
    """A unit vector for every report's normalised text, by the offline embedder."""
    from sangam.operators.vectors import embed

    return texts(spark, d).select("id", embed("t").alias("embedding")).distinct()
