"""Projection-level text operators: normalisation, language and source rules, fact extraction by wordings.

All take and give Columns; null texts count as empty. Only NFC needs Python (Arrow), and only for texts outside ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sangam.functions import patterns as P

SPACES = r"[\s\x85\xA0\x1C-\x1F  -     　]+"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts])


def nfc(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), _nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c))).otherwise(c)


def normalise(c: Column) -> Column:
    """NFC, no zero-width characters, one blank for any white space, runs of ! ? . shortened, trimmed."""
    c = F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), "[​‌‍﻿]", "")
    c = F.regexp_replace(c, SPACES, " ")
    for pattern, to in ((r"!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{4,}", "...")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def source_name(c: Column) -> Column:
    """The channel a spelling stands for, else the spelling in lower case."""
    low = F.lower(F.trim(c))
    spaced = F.regexp_replace(F.regexp_replace(low, "[_-]", " "), " +", " ")
    known = F.create_map(*[F.lit(x) for kv in P.SOURCES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, spaced), F.try_element_at(known, F.replace(spaced, F.lit(" "), F.lit("_"))), low)


def romanised_hits(c: Column) -> Column:
    """How many distinct romanised Hindi words a text holds."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    return F.size(F.array_intersect(words, F.array(*map(F.lit, P.ROMANISED))))


def language_by_rules(text: Column, declared: Column) -> Column:
    """Declared language corrected by script and romanised words; without one, the same evidence decides."""
    t = F.coalesce(text, F.lit(""))
    hindi, roman = t.rlike("[ऀ-ॿ]"), romanised_hits(t) >= 3
    has = declared.isNotNull() & (F.trim(declared) != "")
    return (
        F.when(F.trim(t) == "", F.when(has, declared).otherwise("en"))
        .when(has & (declared == "en") & hindi, "hi").when(has & (declared == "hi") & ~hindi & roman, "hi-Latn").when(has, declared)
        .when(hindi, "hi").when(roman, "hi-Latn").otherwise("en")
    )


def best_confidence(t: Column, rules: list[tuple[str, int]]) -> Column:
    """Largest confidence (in hundredths) of the rules that match, 0 for none."""
    return F.greatest(F.lit(0), *[F.when(t.rlike(f"(?iu){p}"), c).otherwise(0) for p, c in rules]) if rules else F.lit(0)


def incident_type(t: Column) -> Column:
    """struct(value, confidence): most confident type, then the more specific, then the first listed."""
    scores = []
    for k, (name, (rank, rules)) in enumerate(P.INCIDENT_TYPES.items()):
        c = best_confidence(t, rules)
        scores.append(F.when(c > 0, c * 1000 + rank * 10 + (9 - k)))
    top = F.greatest(*scores)
    value = F.when(top.isNull(), None)
    for k, name in enumerate(P.INCIDENT_TYPES):
        value = value.when(top % 10 == 9 - k, name)
    return F.struct(value.alias("value"), F.coalesce(F.floor(top / 1000), F.lit(0)).cast("int").alias("confidence"))


def severity_hint(t: Column) -> Column:
    value, conf = F.lit(None).cast("string"), F.lit(0)
    for level, rules in reversed(P.SEVERITY.items()):
        c = best_confidence(t, rules)
        value, conf = F.when(c > 0, level).otherwise(value), F.when(c > 0, c).otherwise(conf)
    return F.struct(value.alias("value"), conf.alias("confidence"))


def vulnerable(t: Column) -> Column:
    return best_confidence(t, P.VULNERABLE)


def trapped(t: Column) -> Column:
    return F.greatest(best_confidence(t, P.TRAPPED), F.when(t.rlike(r"(?iu)\bstranded\b(?!\s+(?:vehicles?|cars?|traffic))"), P.STRANDED[1]).otherwise(0))


def urgent(t: Column) -> Column:
    return F.greatest(
        best_confidence(t, P.URGENT),
        F.when(t.rlike(r"(?iu)(?<!\bno\s)\bimmediate\s+rescue\b"), 95).otherwise(0),
        F.when(t.rlike(r"(?iu)(?<!\bno\s)\bimmediate?l?y?\b(?!\s+danger)"), 90).otherwise(0),
    )


def info_type(t: Column, source: Column) -> Column:
    told, heard = F.greatest(best_confidence(t, P.EXPLICIT), F.when(source == "field_worker", 80).otherwise(0)), best_confidence(t, P.INFERRED)
    value = F.when((told > 0) & (told >= heard), "explicit").when(heard > 0, "inferred")
    return F.struct(value.alias("value"), F.when((told > 0) & (told >= heard), told).otherwise(heard).alias("confidence"))


def _range(category: str):
    return lambda x, y: F.struct(F.lit(category).alias("category"), x.try_cast("bigint").alias("low"), y.try_cast("bigint").alias("high"))


def _count(category: str):
    return lambda x: _range(category)(x, x)


def people(t: Column) -> Column:
    """Array of struct(category, low, high) of every count or range of people, repeats folded."""
    one = []
    for p, cat in P.PEOPLE:
        got = F.regexp_extract_all(t, F.lit(f"(?iu){p}"), F.lit(1))
        one.append(F.transform(got, _count(cat)))
    for p, cat in P.PEOPLE_RANGES:
        a, b = (F.regexp_extract_all(t, F.lit(f"(?iu){p}"), F.lit(k)) for k in (1, 2))
        one.append(F.zip_with(a, b, _range(cat)))
    return F.array_distinct(F.flatten(F.array(*one)))
