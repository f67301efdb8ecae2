"""Mixed timestamp formats and zones -> one UTC instant.

Each text gets the set of its valid readings: those of its format in every day order (a zone that isn't written is
default_zone, so it adds no reading). Expectation-maximisation per source then fits
a mixture over readings: every text adds to its readings in proportion to their posterior, and the fitted mixture
chooses among several readings or marks the text as ambiguous. A stated day order (day_first) is a prior of 0 on the other
orders: it leaves one reading a text, and the mixture has nothing left to choose. Texts are read in one Arrow UDF (a zone's skipped and
repeated hours have no built-in function); EM runs on counts aggregated by (source, set of readings), never on rows.

Defined results: null text -> status `missing`; blank, unreadable or impossible text -> `invalid`; a local time that a
named zone skips or repeats (with no offset to tell which) -> `invalid` with reason `gap` / `overlap`; several readings
of different instants whose best posterior is under `min_posterior` -> `ambiguous` with utc_us null. A null source is a
source of its own. Repeated rows stay repeated; other columns are untouched, those named like a result are replaced.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sangam.session import broadcast_if_small, durable

# Month names.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "june": 6, "july": 7, "august": 8, "september": 9, "sept": 9,
    "october": 10, "november": 11, "december": 12,
    "जनवरी": 1, "फ़रवरी": 2, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9, "सितम्बर": 9,
    "अक्टूबर": 10, "अक्तूबर": 10, "नवंबर": 11, "नवम्बर": 11, "दिसंबर": 12, "दिसम्बर": 12,
}
# Zone abbreviations in minutes east of UTC. IST is Indian, BST British summer time.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "IST": 330, "BST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "GST": 240, "PKT": 300, "NPT": 345, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp][Mm])(?![A-Za-z]))?"
_ZONE = r"(?:\s*(?P<z>Z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]+/[A-Za-z_/+\-0-9]+|[A-Za-z]{2,5}))?(?:\[(?P<named>[A-Za-z_/+\-0-9]+)\])?"
_DAY = r"(?:(?P<wd>[A-Za-z]{3,9})\.?,?\s+)?"
_NAME = r"(?P<mo>[^\W\d_][^\d\s,.]*)\.?"
SHAPES = {
    "year_first": re.compile(rf"(?P<y>\d{{4}})[-/.](?P<mo>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:T|,? ){_TIME}{_ZONE}"),
    "basic": re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})[T ](?P<h>\d{{2}}):?(?P<mi>\d{{2}})(?::?(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?{_ZONE}"),
    "day_name": re.compile(rf"{_DAY}(?P<d>\d{{1,2}})[ -]{_NAME},?[ -](?P<y>\d{{4}}),?\s+{_TIME}{_ZONE}"),
    "name_day": re.compile(rf"{_DAY}{_NAME}\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}}),?\s+{_TIME}{_ZONE}"),
    "numeric": re.compile(rf"(?P<d>\d{{1,2}})[-/.](?P<mo>\d{{1,2}})[-/.](?P<y>\d{{4}}|\d{{2}})(?:T|,? ){_TIME}{_ZONE}"),
}
READING = "array<struct<reading:string,utc_us:bigint,why:string>>"
_EPOCH = datetime(1970, 1, 1)
_CLEAN = {ord(c): t for c, t in zip("：／－＋．，", ":/-+.,")} | {base + i: str(i) for base in (0x966, 0xFF10) for i in range(10)} | dict.fromkeys([0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF])


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _local_to_utc(local: datetime, zone: ZoneInfo) -> tuple[int | None, str]:
    """Microseconds of a wall-clock time: `gap` where the zone skips it, `overlap` where it occurs twice."""
    found = set()
    for fold in (0, 1):
        u = local.replace(tzinfo=zone, fold=fold).astimezone(timezone.utc)
        if u.astimezone(zone).replace(tzinfo=None) == local:
            found.add((u.replace(tzinfo=None) - _EPOCH) // timedelta(microseconds=1))
    if len(found) == 1:
        return found.pop(), ""
    return None, "overlap" if found else "gap"


def _instant(g: dict, y: str, mo: str, d: str, default_zone: str | None) -> tuple[int | None, str]:
    h, ap = int(g["h"]), (g.get("ap") or "").lower()
    if ap and not 1 <= h <= 12:
        return None, "unreal"
    if ap:
        h = h % 12 + 12 * (ap == "pm")
    month = int(mo) if mo.isdecimal() else MONTHS.get(mo.lower(), 0)
    us = int((g["f"] or "0").ljust(6, "0")[:6])
    try:
        local = datetime(int(y) + 2000 * (len(y) == 2), month, int(d), h, int(g["mi"]), int(g["s"] or 0), us)
    except ValueError:
        return None, "unreal"
    wd = (g.get("wd") or "").lower()[:3]
    if wd and wd != WEEKDAYS[local.weekday()]:
        return None, "unreal"
    z, named, offset = g["z"] or "", g["named"], None
    if z[:1] in ("+", "-"):
        digits = z[1:].replace(":", "").ljust(4, "0")
        offset = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if z[0] == "-" else 1)
    elif "/" in z:
        named = named or z
    elif z:
        offset = ABBREVIATIONS.get(z.upper())
        if offset is None:
            return None, "unknown zone"
    if named is None and not z:
        if default_zone is None:
            return None, "no zone"
        named = default_zone
    zone = _zone(named) if named else None
    if named and zone is None:
        return None, "unknown zone"
    if offset is None:
        return _local_to_utc(local, zone)
    utc = local - timedelta(minutes=offset)
    if zone and utc.replace(tzinfo=timezone.utc).astimezone(zone).replace(tzinfo=None) != local:
        return None, "gap"
    return (utc - _EPOCH) // timedelta(microseconds=1), ""


def read_text(text: str | None, default_zone: str | None) -> list[tuple[str, int | None, str]]:
    """Every reading of one text: (reading, utc_us, why)."""
    t = " ".join((text or "").translate(_CLEAN).split())
    if t.isascii() and t.isdigit():
        for low, high, name, scale in ((9, 10, "epoch_s", 1_000_000), (12, 13, "epoch_ms", 1000), (15, 16, "epoch_us", 1)):
            if low <= len(t) <= high:
                return [(name, int(t) * scale, "")]
        return []
    for name, pattern in SHAPES.items():
        if m := pattern.fullmatch(t):
            g = m.groupdict()
            y, mo, d = g["y"], g["mo"], g["d"]
            if name != "numeric":
                return [(name, *_instant(g, y, mo, d, default_zone))]
            out = [("dmy", *_instant(g, y, mo, d, default_zone)), ("mdy", *_instant(g, y, d, mo, default_zone))]
            if len(y) == 2:
                out.append(("ymd2", *_instant(g, d.zfill(2), mo, y, default_zone)))
            return out
    return []


def with_readings(df: DataFrame, text: str, default_zone: str | None) -> DataFrame:
    """`df` plus `_all`: array of struct(reading, utc_us, why), one for every reading of the text; utc_us is null where the
    reading denotes no instant."""

    @F.pandas_udf(READING)
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"reading": r, "utc_us": u, "why": w} for r, u, w in read_text(t, default_zone)] for t in texts])

    return df.withColumn("_all", read(F.col(text)))


def convention(day_first: bool | None) -> dict[str, float]:
    """Prior of the readings that a stated day order rules out; readings not named have prior 1."""
    return {True: {"mdy": 0.0, "ymd2": 0.0}, False: {"dmy": 0.0, "ymd2": 0.0}, None: {}}[day_first]


def fit_mixture(counts: DataFrame, prior: dict[str, float], rounds: int = 30, smoothing: float = 0.5) -> DataFrame:
    """EM per source over rows (source, names array<string>, n). Returns (source, reading, weight).

    One group is one source's distinct reading sets: at most 2^|READINGS| rows, whatever the data."""

    def em(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({x for s in pdf["names"] for x in s})
        at = {x: i for i, x in enumerate(names)}
        believed = [prior.get(x, 1.0) for x in names]
        w = [1.0 / len(names)] * len(names)
        for _ in range(rounds):
            got = [smoothing] * len(names)
            for s, n in zip(pdf["names"], pdf["n"]):
                total = sum(w[at[x]] * believed[at[x]] for x in s)
                for x in s:
                    got[at[x]] += n * w[at[x]] * believed[at[x]] / total if total else 0.0
            z = sum(got)
            w = [g / z for g in got]
        return pd.DataFrame({"source": [pdf["source"].iloc[0]] * len(names), "reading": names, "weight": [a * b for a, b in zip(w, believed)]})

    schema = StructType([StructField("source", StringType()), StructField("reading", StringType()), StructField("weight", DoubleType())])
    return counts.groupBy("source").applyInPandas(em, schema)


def _sets(d: DataFrame) -> DataFrame:
    """(source, names, n) of rows with columns source and _all."""
    names = F.array_sort(F.transform(F.filter("_all", lambda r: r["utc_us"].isNotNull()), lambda r: r["reading"]))
    return d.select("source", names.alias("names")).filter("size(names) > 0").groupBy("source", "names").agg(F.count("*").alias("n"))


def mixture_of(df: DataFrame, text: str, source: str | Column, day_first: bool | None = None, default_zone: str | None = "Asia/Kolkata") -> DataFrame:
    """The fitted mixture: (source, reading, weight)."""
    source = F.col(source) if isinstance(source, str) else source
    return fit_mixture(_sets(with_readings(df.select(source.alias("source"), F.col(text).alias("_text")), "_text", default_zone)), convention(day_first))


def normalise_timestamps(
    df: DataFrame,
    text: str,
    source: str | Column,
    day_first: bool | None = True,
    default_zone: str | None = "Asia/Kolkata",
    min_posterior: float = 0.95,
    max_broadcast_rows: int = 50_000,
) -> DataFrame:
    """`df` plus utc_us, ts_status, ts_reading, ts_posterior, ts_why. day_first None lets EM alone decide the order of numeric dates."""
    source = F.col(source) if isinstance(source, str) else source
    weights = mixture_of(df, text, source, day_first, default_zone)
    weights = weights.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("reading", "weight"))).alias("_w"))
    # written once: EM isn't run again for the count and the join
    weights = broadcast_if_small(durable(weights.withColumnRenamed("source", "_wsrc"), "mixture"), max_broadcast_rows)
    d = with_readings(df.withColumn("_src", source), text, default_zone)
    d = d.join(weights, F.col("_src").eqNullSafe(F.col("_wsrc")), "left")
    scored = F.transform(
        F.filter("_all", lambda r: r["utc_us"].isNotNull()),
        lambda r: F.struct(F.coalesce(F.try_element_at("_w", r["reading"]), F.lit(0.0)).alias("w"), r["reading"].alias("reading"), r["utc_us"].alias("utc_us")),
    )
    d = d.withColumn("_sc", F.filter(scored, lambda r: r["w"] > 0)).withColumn("_best", F.array_max("_sc"))
    total = F.aggregate("_sc", F.lit(0.0), lambda a, r: a + r["w"])
    mass = F.aggregate("_sc", F.lit(0.0), lambda a, r: a + F.when(r["utc_us"] == F.col("_best.utc_us"), r["w"]).otherwise(0.0))
    d = d.withColumn("_post", F.when(F.size("_sc") > 0, mass / total))
    status = F.when(F.col(text).isNull(), "missing").when(F.size("_sc") == 0, "invalid").when(F.col("_post") >= min_posterior, "resolved").otherwise("ambiguous")
    d = d.withColumn("_st", status)
    return d.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("utc_us", "ts_status", "ts_reading", "ts_posterior", "ts_why")],
        F.when(F.col("_st") == "resolved", F.col("_best.utc_us")).alias("utc_us"),
        F.col("_st").alias("ts_status"),
        F.when(F.col("_st") == "resolved", F.col("_best.reading")).alias("ts_reading"),
        F.col("_post").alias("ts_posterior"),
        F.when(F.col("_st") == "invalid", F.coalesce(F.get("_all", F.lit(0))["why"], F.lit("unreadable"))).alias("ts_why"),
    )
