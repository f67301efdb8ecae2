"""Queries of the general problems: p2 (timestamps) and p5 (positions), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sangam.operators.geo import within_distance
from sangam.operators.timestamps import mixture_of, normalise_timestamps
from sangam.sources.tables import distinct_reports, table


def channel(c: str = "source"):
    """Spelling-free name of a channel."""
    return F.lower(F.trim(F.regexp_replace(F.col(c), "[_\\- ]+", " ")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports whose received_at is one instant while received_at_utc is null or another instant. A report id is taken once."""
    r = table(spark, sf_dir, "reports").select("id", "source", "received_at", "received_at_utc")
    n = normalise_timestamps(r, "received_at", channel(), day_first=True, default_zone="Asia/Kolkata")
    stored = F.unix_micros(F.col("received_at_utc"))
    return n.filter(F.col("utc_us").isNotNull() & (stored.isNull() | (stored != F.col("utc_us")))).select("id", "utc_us").distinct()


def p2_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of readings that EM fits for each channel, no day order being stated."""
    r = table(spark, sf_dir, "reports")
    m = mixture_of(r, "received_at", channel(), day_first=None)
    return m.select("source", "reading", F.round("weight", 9).alias("weight"))


def p2_unstated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every received_at that has readings of different instants when no day order is stated: what the channel's fitted mixture
    makes of it, with its posterior (utc_us is null where that leaves it ambiguous)."""
    r = table(spark, sf_dir, "reports").select("id", "source", "received_at")
    n = normalise_timestamps(r, "received_at", channel(), day_first=None, default_zone="Asia/Kolkata")
    doubtful = F.col("received_at").rlike(r"^\s*\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}\b") & F.col("ts_posterior").isNotNull()
    return n.filter(doubtful).select("id", "ts_status", "ts_reading", F.round("ts_posterior", 6).alias("posterior"), "utc_us").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report and gazetteer region for every report position inside the region's circle."""
    r = distinct_reports(table(spark, sf_dir, "reports"), "id", "gps_lat", "gps_lon")
    g = table(spark, sf_dir, "rampur")
    return within_distance(r, g, "id", "location_id", "gps_lat", "gps_lon", "lat", "lon", "radius_m").distinct()


QUERIES = {"p2_found": p2_found, "p2_formats": p2_formats, "p2_unstated": p2_unstated, "p5_found": p5_found}

_R = "6371000.0"
SQL = {
    "p5_found": f"""
SELECT DISTINCT r.id, g.location_id
FROM (SELECT DISTINCT id, gps_lat, gps_lon FROM reports
      WHERE isfinite(gps_lat) AND isfinite(gps_lon) AND gps_lat BETWEEN -90 AND 90 AND gps_lon BETWEEN -180 AND 180) r
JOIN rampur g ON abs(r.gps_lat - g.lat) <= degrees(g.radius_m / {_R}) * 1.001
 AND 2 * {_R} * atan2(
   sqrt(pow(sin(radians(g.lat - r.gps_lat) / 2), 2) + cos(radians(r.gps_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - r.gps_lon) / 2), 2)),
   sqrt(1 - (pow(sin(radians(g.lat - r.gps_lat) / 2), 2) + cos(radians(r.gps_lat)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - r.gps_lon) / 2), 2)))) <= g.radius_m
""",
}
