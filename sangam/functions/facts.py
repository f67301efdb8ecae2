"""Facts with evidence: every field found in a text as struct(value, confidence in hundredths, evidence array).

Evidence is what the pattern matched, in the order of the patterns, each once. Absent facts have a null value, confidence 0
and no evidence. Each pattern runs once a text: results are picked from one array of matches, so expressions stay small."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import patterns as P

_RUN = r"([W\s]+?)"


def none() -> Column:
    return F.array().cast("array<string>")


def _re(p: str) -> str:
    return "(?iu)" + p.replace("W", r"\p{L}\p{N}_")


def needed(p: str) -> str | None:
    """The longest run of letters that every match of a pattern holds, in lower case; None if there is none to be sure of."""
    flat, before = p, ""
    while flat != before:
        before, flat = flat, re.sub(r"\((?:\?(?:[:=!]|<[=!]))?[^()]*\)[?*+]?", ".", flat)
    if "|" in flat:
        return None
    flat = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]", ".", flat)
    runs = [x for x in re.findall(r"[^\W\d_](?:[^\W\d_]|[\u0900-\u0963])*", flat) if len(x) > 2]
    return max(runs, key=len).lower() if runs else None


def _if_held(t: Column, p: str, found: Column, otherwise: Column) -> Column:
    """The costly pattern only where the text (in lower case: column _low) holds what it needs."""
    word = needed(p)
    return F.when(F.contains(F.col("_low"), F.lit(word)), found).otherwise(otherwise) if word else found


def matches(t: Column, p: str, group: int = 0) -> Column:
    """All matches of a pattern, trimmed."""
    if p.startswith(_RUN):
        # a run of words can only match from its start or from the match before, so no other place is tried: linear, not quadratic
        p = r"(?:(?<![W\s])|\G)" + p
    return _if_held(t, p, F.transform(F.regexp_extract_all(t, F.lit(_re(p)), F.lit(group)), lambda x: F.trim(x)), none())


def _all(t: Column, rules: list[tuple[str, int]]) -> Column:
    """array<struct(c, e array)> of the rules that match."""
    return F.filter(F.array(*[F.struct(F.lit(c).alias("c"), matches(t, p).alias("e")) for p, c in rules]), lambda x: F.size(x["e"]) > 0)


def found_in(t: Column) -> Column:
    """struct of everything the patterns match in a text, each pattern run once; the facts below are picked from its fields.

    Explode it before picking (`with_found`), as projections that are merged would run the patterns again for every use."""
    types = [
        F.struct(F.lit(c).alias("c"), F.lit(rank).alias("rank"), F.lit(-k).alias("k"), F.lit(name).alias("name"), _if_held(t, p, F.trim(F.regexp_extract(t, _re(p), 0)), F.lit("")).alias("e"))
        for k, (name, (rank, rules)) in enumerate(P.INCIDENT_TYPES.items()) for p, c in rules
    ]
    stranded = r"\bstranded\s+(?:people|persons?|residents?|family)\b|\bstranded\b(?!\s+(?:vehicles?|cars?|traffic))"
    denied = [(r"(?<!\bno\s)\bimmediate\s+rescue\b", 95), (r"(?<!\bno\s)\bimmediatel?y?\b(?!\s+danger)", 90)]
    levels = [F.struct(F.lit(k).alias("k"), F.lit(name).alias("name"), F.lit(c).alias("c"), F.slice(matches(t, p), 1, 1).alias("e")) for k, (name, rules) in enumerate(P.SEVERITY.items()) for p, c in rules]

    def rows(p: str, category: str, confidence: int, unit: str | None, ranged: bool) -> Column:
        low = F.regexp_extract_all(t, F.lit(_re(p)), F.lit(1))
        return F.transform(
            F.arrays_zip(matches(t, p).alias("e"), _if_held(t, p, low, none()).alias("a"), (F.regexp_extract_all(t, F.lit(_re(p)), F.lit(2)) if ranged else _if_held(t, p, low, none())).alias("b")),
            lambda x: F.struct(F.lit(category).alias("category"), F.lit(unit).cast("string").alias("unit"), x["a"].try_cast("bigint").alias("low"), x["b"].try_cast("bigint").alias("high"), F.lit(confidence).alias("confidence"), x["e"].alias("evidence")),
        )

    people = [*[rows(p, c, 80, None, False) for p, c in P.PEOPLE], *[rows(p, c, 75, None, True) for p, c in P.PEOPLE_RANGES], *[rows(p, c, 70, "families", False) for p, c in P.FAMILIES]]
    return F.struct(
        F.filter(F.array(*types), lambda x: x["e"] != "").alias("types"), _all(t, P.VULNERABLE).alias("vulnerable"), _all(t, [*P.TRAPPED, (stranded, P.STRANDED[1])]).alias("trapped"), _all(t, [*denied, *P.URGENT]).alias("urgent"),
        F.filter(F.array(*levels), lambda x: F.size(x["e"]) > 0).alias("levels"), _all(t, P.EXPLICIT).alias("told"), _all(t, P.INFERRED).alias("heard"),
        F.filter(F.flatten(F.array(*[matches(t, p, 1) for p in P.PLACES])), lambda x: F.length(x) >= 3).alias("places"), F.flatten(F.array(*people)).alias("people"),
    )


def with_found(df: DataFrame, text: str) -> DataFrame:
    """`df` plus the fields of found_in(text) as columns, computed once a row."""
    low = df.withColumn("_low", F.lower(F.upper(text)))  # upper first: some small letters have no other way to their like
    return low.withColumn("_found", F.explode(F.array(found_in(F.col(text))))).select(*df.columns, "_found.*")


def _most(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda x: x["c"])), F.lit(0))


def _evidence(found: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(found, lambda x: x["e"])))


def _fact(found: Column, value: Column) -> Column:
    return F.struct(F.when(F.size(found) > 0, value).alias("value"), _most(found).alias("confidence"), _evidence(found).alias("evidence"))


def incident_type() -> Column:
    """Type of the most confident first match, then the more specific one, then the first listed; evidence of that confidence."""
    best = F.array_max(F.transform("types", lambda x: F.struct(x["c"], x["rank"], x["k"], x["name"])))
    evidence = F.array_distinct(F.transform(F.filter("types", lambda x: (x["name"] == best["name"]) & (x["c"] == best["c"])), lambda x: x["e"]))
    return F.struct(best["name"].alias("value"), F.coalesce(best["c"], F.lit(0)).alias("confidence"), F.coalesce(evidence, none()).alias("evidence"))


def flag(column: str) -> Column:
    return _fact(F.col(column), F.lit("true"))


def urgency() -> Column:
    """Signals distinct whatever their case; evidence distinct as written."""
    said = F.array_distinct(F.transform(F.flatten(F.transform("urgent", lambda x: x["e"])), lambda x: F.lower(x)))
    return _fact(F.col("urgent"), F.array_join(F.array_sort(said), "|"))


def severity() -> Column:
    """The most severe level that matches; evidence is the first match of each of its patterns."""
    level = F.array_min(F.transform("levels", lambda x: x["k"]))
    own = F.filter("levels", lambda x: x["k"] == level)
    return _fact(own, F.get(own, F.lit(0))["name"])


def info_type(channel: Column) -> Column:
    """Explicit wins ties; a field worker's report is explicit by itself."""
    by_channel = channel == "field_worker"
    a, b = F.greatest(_most(F.col("told")), F.when(by_channel, 80).otherwise(0)), _most(F.col("heard"))
    own = F.when(by_channel, F.array(F.lit("source: field_worker"))).otherwise(none())
    return (
        F.when((a > 0) & (a >= b), F.struct(F.lit("explicit").alias("value"), a.alias("confidence"), F.concat(own, _evidence(F.col("told"))).alias("evidence")))
        .when(b > 0, F.struct(F.lit("inferred").alias("value"), b.alias("confidence"), _evidence(F.col("heard")).alias("evidence")))
        .otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0).alias("confidence"), none().alias("evidence")))
    )


def place() -> Column:
    """The first phrase that holds or is part of a known place (90), else the first phrase (80); evidence: all phrases."""
    got, parts = F.col("places"), F.array(*map(F.lit, P.PLACE_PARTS))
    known = F.filter(got, lambda x: F.exists(parts, lambda k: F.contains(F.lower(x), k) | F.contains(k, F.lower(x))))
    first = F.get(known, F.lit(0))
    return F.struct(F.coalesce(first, F.get(got, F.lit(0))).alias("value"), F.when(first.isNotNull(), 90).when(F.size(got) > 0, 80).otherwise(0).alias("confidence"), F.array_distinct(got).alias("evidence"))


def people() -> Column:
    """array<struct(category, unit, low, high, confidence, evidence)>: counts, ranges, families; an evidence counts once, as first met."""
    evidence = F.transform("people", lambda x: x["evidence"])
    return F.filter("people", lambda x, i: F.array_position(evidence, x["evidence"]) == i + 1)


def word(p: str, t: Column) -> Column:
    """Whether the words of `p` stand in a text between borders of letters, digits and _; a mark of another class (a vowel sign)
    is a border."""
    w = r"[\p{L}\p{N}_]"
    border = rf"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"
    return t.rlike(rf"(?iu){border}{p}{border}")
