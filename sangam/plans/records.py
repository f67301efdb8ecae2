"""Facts, contradictions and assessments with what they rest on, each query beside its SQL.

A report's facts are those of the table extractions and, for fields it lacks there, those found in its text. Results are
projected before they are made distinct, so whole texts don't move. Contradictions stand between classes of equal claims of
an incident, each side with its value, its first report and its number of reports; pairs of members are never formed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions import facts as X
from sangam.functions import patterns as P
from sangam.functions.text import normalise, source_name
from sangam.operators.vectors import word_vectors
from sangam.plans.fusion import _DECODED, _MEMBERS, _NORM, _SOURCE, _lit, decoded, members, priority_of
from sangam.session import durable
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


def texts(spark, d, *cols: str) -> DataFrame:
    """Reports, redelivered rows too, with column t: the normalised raw text."""
    return spread(table(spark, d, "reports").select("id", "raw_text", *cols)).select("id", *cols, normalise(F.col("raw_text")).alias("t"))


# ---- facts in SQL

_T = f"x AS (SELECT DISTINCT id, raw_text, source FROM reports), t AS (SELECT id, {_NORM} AS t, {_SOURCE} AS channel FROM x)"


def _p(p: str) -> str:
    return _lit(p.replace("W", r"\p{L}\p{N}_"))


def _found(p: str, t: str = "t", group: int = 0) -> str:
    return f"list_transform(regexp_extract_all({t}, {_p(p)}, {group}, 'i'), lambda y: trim(y))"


def _hits(rules: list[tuple[str, int]], *more: str) -> str:
    return "list_filter([" + ", ".join([f"{{'c': {c}, 'e': {_found(p)}}}" for p, c in rules] + list(more)) + "], lambda z: len(z.e) > 0)"


def _joined(lists: str) -> str:
    return f"array_to_string(list_sort(list_distinct({lists})), '|')"


def _evidence(h: str) -> str:
    return _joined(f"flatten(list_transform({h}, lambda z: z.e))")


def _most(h: str) -> str:
    return f"coalesce(list_max(list_transform({h}, lambda z: z.c)), 0)"


_TYPE_ROWS = "list_filter([" + ", ".join(f"{{'c': {c}, 'r': {rank}, 'k': {-k}, 'n': {_lit(n)}, 'e': trim(regexp_extract(t, {_p(p)}, 0, 'i'))}}" for k, (n, (rank, rules)) in enumerate(P.INCIDENT_TYPES.items()) for p, c in rules) + "], lambda z: z.e <> '')"
_STRANDED = r"{'c': 80, 'e': list_transform(regexp_extract_all(regexp_replace(t, '\bstranded\s+(?:vehicles?|cars?|traffic)', '#', 'gi'), '\bstranded\s+(?:people|persons?|residents?|family)\b|\bstranded\b', 0, 'i'), lambda y: trim(y))}"
_DENIED = [
    r"{'c': 95, 'e': list_transform(regexp_extract_all(regexp_replace(t, '\bno\simmediate', '#', 'gi'), '\bimmediate\s+rescue\b', 0, 'i'), lambda y: trim(y))}",
    r"{'c': 90, 'e': list_transform(regexp_extract_all(regexp_replace(regexp_replace(t, '\bno\simmediate', '#', 'gi'), '\bimmediatel?y?\s+danger', '#', 'gi'), '\bimmediatel?y?\b', 0, 'i'), lambda y: trim(y))}",
]
_LEVELS = [f"list_filter([{', '.join(f'''{{'c': {c}, 'e': {_found(p)}[:1]}}''' for p, c in rules)}], lambda z: len(z.e) > 0)" for rules in P.SEVERITY.values()]
_LEVEL = "CASE " + " ".join(f"WHEN len({h}) > 0 THEN {h}" for h in _LEVELS) + f" ELSE {_LEVELS[0]} END"
_LEVEL_NAME = "CASE " + " ".join(f"WHEN len({h}) > 0 THEN {_lit(n)}" for n, h in zip(P.SEVERITY, _LEVELS)) + " END"
_PLACES = "list_filter(flatten([" + ", ".join(_found(p, group=1) for p in P.PLACES) + "]), lambda y: length(y) >= 3)"
_PARTS = "[" + ", ".join(map(_lit, P.PLACE_PARTS)) + "]"
_PEOPLE = " UNION ALL ".join(
    f"SELECT id, {k} AS k, unnest(range(len({_found(p)}))) AS i, {_lit(c)} AS category, {u} AS unit, {n} AS confidence, unnest({_found(p)}) AS evidence, TRY_CAST(unnest(regexp_extract_all(t, {_p(p)}, 1, 'i')) AS BIGINT) AS low, TRY_CAST(unnest(regexp_extract_all(t, {_p(p)}, {g}, 'i')) AS BIGINT) AS high FROM t"
    for k, (p, c, u, n, g) in enumerate([(p, c, "NULL::VARCHAR", 80, 1) for p, c in P.PEOPLE] + [(p, c, "NULL::VARCHAR", 75, 2) for p, c in P.PEOPLE_RANGES] + [(p, c, "'families'", 70, 1) for p, c in P.FAMILIES])
)
#: one row a report and field, with evidence as a sorted joined text
_FACTS = f"""{_T}, h AS (SELECT id, channel, {_TYPE_ROWS} AS ty, {_hits(P.VULNERABLE)} AS vu, {_hits(P.TRAPPED, _STRANDED)} AS tr, {_hits(P.URGENT, *_DENIED)} AS ur, {_LEVEL} AS sh, {_LEVEL_NAME} AS sn, {_hits(P.EXPLICIT)} AS ex, {_hits(P.INFERRED)} AS inf, {_PLACES} AS pl FROM t),
 h2 AS (SELECT *, list_reverse_sort(list_transform(ty, lambda z: {{'c': z.c, 'r': z.r, 'k': z.k, 'n': z.n}}))[1] AS best, greatest({_most('ex')}, CASE WHEN channel = 'field_worker' THEN 80 ELSE 0 END) AS a, {_most('inf')} AS b, list_filter(pl, lambda y: len(list_filter({_PARTS}, lambda w: contains(lower(y), w) OR contains(w, lower(y)))) > 0) AS kn FROM h),
 pe AS (SELECT *, row_number() OVER (PARTITION BY id, evidence ORDER BY k, i) AS nth FROM ({_PEOPLE})),
 f AS (SELECT id, 'incident_type' AS field_name, best.n AS value, coalesce(best.c, 0) AS confidence, {_joined('list_transform(list_filter(ty, lambda z: z.n = best.n AND z.c = best.c), lambda z: z.e)')} AS evidence FROM h2
  UNION ALL SELECT id, 'vulnerable_persons', CASE WHEN len(vu) > 0 THEN 'true' END, {_most('vu')}, {_evidence('vu')} FROM h2
  UNION ALL SELECT id, 'trapped_or_rescue', CASE WHEN len(tr) > 0 THEN 'true' END, {_most('tr')}, {_evidence('tr')} FROM h2
  UNION ALL SELECT id, 'urgency_signals', CASE WHEN len(ur) > 0 THEN {_joined('list_transform(flatten(list_transform(ur, lambda z: z.e)), lambda y: lower(y))')} END, {_most('ur')}, {_evidence('ur')} FROM h2
  UNION ALL SELECT id, 'severity_hint', sn, {_most('sh')}, {_evidence('sh')} FROM h2
  UNION ALL SELECT id, 'info_type', CASE WHEN a > 0 AND a >= b THEN 'explicit' WHEN b > 0 THEN 'inferred' END, CASE WHEN a > 0 AND a >= b THEN a ELSE b END,
   CASE WHEN a > 0 AND a >= b THEN {_joined("list_concat(CASE WHEN channel = 'field_worker' THEN ['source: field_worker'] ELSE [] END, flatten(list_transform(ex, lambda z: z.e)))")} WHEN b > 0 THEN {_evidence('inf')} ELSE '' END FROM h2
  UNION ALL SELECT id, 'location_raw', coalesce(kn[1], pl[1]), CASE WHEN len(kn) > 0 THEN 90 WHEN len(pl) > 0 THEN 80 ELSE 0 END, {_joined('pl')} FROM h2
  UNION ALL SELECT id, 'people_estimate', concat(low, CASE WHEN high <> low THEN concat('-', high) ELSE '' END, ' ', category, coalesce(concat(' ', unit), '')), confidence, evidence FROM pe WHERE nth = 1)"""  # fmt: skip


def facts_of(rows: DataFrame) -> DataFrame:
    """(id, t, channel) -> (id, field_name, value, confidence, evidence array, category, low, high): eight fields of each text, null
    where absent; a row for each mention of people."""
    found = {
        "incident_type": X.incident_type(), "vulnerable_persons": X.flag("vulnerable"), "trapped_or_rescue": X.flag("trapped"), "urgency_signals": X.urgency(),
        "severity_hint": X.severity(), "info_type": X.info_type(F.col("channel")), "location_raw": X.place(),
    }
    none = [F.lit(None).cast("string").alias("category"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("high")]
    # one step matches, the next picks, the last unpivots; a generator between them keeps the planner from merging them
    r = X.with_found(rows, "t")
    r = r.select("id", F.explode(F.array(F.struct(*[v.alias(f"_{k}") for k, v in found.items()], X.people().alias("_people")))).alias("_p")).select("id", "_p.*")
    one = [F.struct(F.lit(k).alias("field_name"), F.col(f"_{k}.value"), F.col(f"_{k}.confidence"), F.col(f"_{k}.evidence"), *none) for k in found]
    shown = lambda p: F.concat(p["low"].cast("string"), F.when(p["high"] != p["low"], F.concat(F.lit("-"), p["high"].cast("string"))).otherwise(""), F.lit(" "), p["category"], F.coalesce(F.concat(F.lit(" "), p["unit"]), F.lit("")))
    people = F.transform("_people", lambda p: F.struct(F.lit("people_estimate").alias("field_name"), shown(p).alias("value"), p["confidence"].alias("confidence"), F.array(p["evidence"]).alias("evidence"), p["category"].alias("category"), p["low"].alias("low"), p["high"].alias("high")))
    return r.select("id", F.explode(F.concat(F.array(*one), people)).alias("f")).select("id", "f.*")


def text_facts(spark, d) -> DataFrame:
    r = spread(table(spark, d, "reports").select("id", "raw_text", "source")).select("id", normalise(F.col("raw_text")).alias("t"), source_name(F.col("source")).alias("channel"))
    return facts_of(r).dropDuplicates(["id", "field_name", "value", "evidence"])


def _shown(f: DataFrame) -> DataFrame:
    return f.select("id", "field_name", "value", "confidence", F.array_join(F.array_sort("evidence"), "|").alias("evidence"))


@query("extract_fields_long", f"WITH {_FACTS} SELECT id, field_name, value, CAST(confidence AS INT) AS confidence, evidence FROM f")
def extract_fields_long(spark, d):
    return _shown(text_facts(spark, d))


def _field(name: str):
    def run(spark, d):
        f = _shown(text_facts(spark, d).filter(F.col("field_name") == name)).drop("field_name")
        return f

    run.__doc__ = f"The field {name} of every report: value, confidence in hundredths, evidence."
    return run


for _key, _name in [("extract_incident_type", "incident_type"), ("extract_people", "people_estimate"), ("extract_vulnerable", "vulnerable_persons"), ("extract_trapped", "trapped_or_rescue"), ("extract_urgency", "urgency_signals"), ("extract_location", "location_raw"), ("extract_severity_hint", "severity_hint"), ("extract_info_type", "info_type")]:
    query(_key, f"WITH {_FACTS} SELECT id, value, CAST(confidence AS INT) AS confidence, evidence FROM f WHERE field_name = {_lit(_name)}")(_field(_name))

# ---- facts by precedence: the table's fields, else the text's

_ALL = f"""{_FACTS}, tab AS (SELECT DISTINCT id AS x, report_id AS id, CASE WHEN field_name LIKE 'people%' THEN 'people_estimate' ELSE field_name END AS field_name, {_DECODED} AS value, confidence, coalesce(CASE WHEN json_valid(evidence) THEN CAST(json_array_length(evidence) AS BIGINT) ELSE length(evidence) END, 0) AS n_evidence,
  CASE WHEN field_name LIKE 'people%' AND json_valid(value) THEN value END AS j FROM extractions),
 allf AS (SELECT id, field_name, lower(trim(value)) AS value, confidence, n_evidence, j ->> '$.category' AS category, TRY_CAST(coalesce(j ->> '$.count', j ->> '$.count_min') AS BIGINT) AS low, TRY_CAST(coalesce(j ->> '$.count', j ->> '$.count_max') AS BIGINT) AS high, '' AS evidence, true AS stored FROM tab
  UNION ALL SELECT f.id, f.field_name, lower(trim(f.value)), f.confidence / 100.0, CASE WHEN f.evidence = '' THEN 0 ELSE 1 END, pe.category, pe.low, pe.high, f.evidence, false FROM f LEFT JOIN pe ON f.field_name = 'people_estimate' AND pe.id = f.id AND pe.evidence = f.evidence AND pe.nth = 1
   WHERE f.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tab WHERE tab.id = f.id AND tab.field_name = f.field_name))"""


def all_facts(spark, d) -> DataFrame:
    """(id, field_name, value lower case, confidence, n_evidence, category, low, high, evidence, stored)."""
    j = lambda p: F.get_json_object("value", p)
    folk = F.col("field_name").startswith("people")
    listed = F.from_json("evidence", "array<string>")
    t = table(spark, d, "extractions").select("id", "report_id", "field_name", "value", "confidence", "evidence").distinct()
    t = t.select(
        F.col("report_id").alias("id"), F.when(folk, "people_estimate").otherwise(F.col("field_name")).alias("field_name"), F.lower(F.trim(decoded())).alias("value"), F.col("confidence").cast("double").alias("confidence"),
        F.coalesce(F.when(F.try_parse_json("evidence").isNotNull(), F.size(listed)).otherwise(F.length("evidence")), F.lit(0)).alias("n_evidence"),
        F.when(folk, j("$.category")).alias("category"), F.when(folk, F.coalesce(j("$.count"), j("$.count_min"))).try_cast("bigint").alias("low"), F.when(folk, F.coalesce(j("$.count"), j("$.count_max"))).try_cast("bigint").alias("high"),
        X.none().alias("evidence"), F.lit(True).alias("stored"),
    )
    have = t.select("id", "field_name").distinct()
    f = text_facts(spark, d).filter("value is not null").join(have, ["id", "field_name"], "left_anti")
    return t.unionByName(f.select("id", "field_name", F.lower(F.trim("value")).alias("value"), (F.col("confidence") / 100.0).alias("confidence"), F.least(F.size("evidence"), F.lit(1)).alias("n_evidence"), "category", "low", "high", "evidence", F.lit(False).alias("stored")))


@query("extraction_access", f"WITH {_ALL} SELECT field_name, stored, count(*) AS facts, count(DISTINCT id) AS reports FROM allf WHERE value IS NOT NULL GROUP BY ALL")
def extraction_access(spark, d):
    """Facts per field by where they come from: the table, or the text where the table has none."""
    return all_facts(spark, d).filter("value is not null").groupBy("field_name", "stored").agg(F.count("*").alias("facts"), F.count_distinct("id").alias("reports"))


# ---- contradictions: classes of equal claims, pairs of classes that exclude each other

_BAD = " OR ".join(f"(least(a.value, b.value) = {_lit(min(p))} AND greatest(a.value, b.value) = {_lit(max(p))})" for p in P.INCOMPATIBLE_TYPES)
_HAZARDS = [("hazard_structural", "structural_integrity", "damaged_or_collapse_risk", P.DAMAGED, "intact_or_stable", P.INTACT), ("hazard_access", "road_access", "blocked", P.BLOCKED, "passable", P.PASSABLE)]
_SUFFIX = {"numeric": "NUM-", "severity": "SEV", "incident_type": "TYPE", "location": "LOC", "hazard_structural": "HAZ-STRUCT", "hazard_access": "HAZ-ACCESS"}
_CLAIM_SQL = f"""{_ALL}, {_MEMBERS}, claims AS (
  SELECT incident_id, 'numeric' AS kind, concat('people_', category) AS field, concat(low, '-', high) AS value, low, high, id FROM allf JOIN m USING (id) WHERE field_name = 'people_estimate' AND category IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL
  UNION ALL SELECT incident_id, 'severity', 'severity_hint', value, NULL, NULL, id FROM allf JOIN m USING (id) WHERE field_name = 'severity_hint' AND value IN ('critical', 'severe', 'minor')
  UNION ALL SELECT incident_id, 'incident_type', 'incident_type', value, NULL, NULL, id FROM allf JOIN m USING (id) WHERE field_name = 'incident_type' AND value IS NOT NULL
  UNION ALL SELECT incident_id, 'location', 'location_resolved', lower(trim(location_resolved, ' ')), NULL, NULL, id FROM (SELECT DISTINCT id, location_resolved FROM reports) JOIN m USING (id) WHERE trim(location_resolved, ' ') <> ''
  {' '.join(f"UNION ALL SELECT incident_id, '{k}', '{f}', '{v}', NULL, NULL, id FROM t JOIN m USING (id) WHERE regexp_matches(t, {_p(p)}, 'i')" for k, f, v1, p1, v2, p2 in _HAZARDS for v, p in ((v1, p1), (v2, p2)))}),
 k AS (SELECT incident_id, kind, field, value, min(low) AS low, min(high) AS high, min(id) AS first, count(DISTINCT id) AS n FROM claims GROUP BY ALL),
 con AS (SELECT a.incident_id, a.kind, a.field, a.value AS value_a, a.first AS report_a, a.n AS reports_a, b.value AS value_b, b.first AS report_b, b.n AS reports_b FROM k a JOIN k b ON a.incident_id = b.incident_id AND a.kind = b.kind AND a.field = b.field AND a.value < b.value
  WHERE CASE a.kind WHEN 'numeric' THEN a.high < b.low OR b.high < a.low WHEN 'severity' THEN (a.value = 'minor') <> (b.value = 'minor') WHEN 'incident_type' THEN {_BAD} ELSE true END)"""  # fmt: skip


def claims(spark, d, facts: DataFrame | None = None) -> DataFrame:
    """(incident_id, kind, field, value, low, high, first, n): the classes of equal claims of each incident."""
    m = members(spark, d)
    f = facts or durable(all_facts(spark, d), "facts")
    none = F.lit(None).cast("bigint")
    people = f.filter("field_name = 'people_estimate' and category is not null and low is not null and high is not null").select("id", F.lit("numeric").alias("kind"), F.concat(F.lit("people_"), "category").alias("field"), F.concat_ws("-", "low", "high").alias("value"), "low", "high")
    said = f.filter("(field_name = 'severity_hint' and value in ('critical', 'severe', 'minor')) or (field_name = 'incident_type' and value is not null)")
    said = said.select("id", F.when(F.col("field_name") == "severity_hint", "severity").otherwise("incident_type").alias("kind"), F.col("field_name").alias("field"), "value", none.alias("low"), none.alias("high"))
    r = table(spark, d, "reports")
    places = r.select("id", F.lit("location").alias("kind"), F.lit("location_resolved").alias("field"), F.lower(F.trim("location_resolved")).alias("value"), none.alias("low"), none.alias("high")).filter("value <> ''")
    t = F.col("t")
    states = [F.when(t.rlike(f"(?iu){p}"), F.struct(F.lit(k).alias("kind"), F.lit(f).alias("field"), F.lit(v).alias("value"))) for k, f, v1, p1, v2, p2 in _HAZARDS for v, p in ((v1, p1), (v2, p2))]
    hazards = texts(spark, d).select("id", F.explode(F.array_compact(F.array(*states))).alias("s")).select("id", "s.*", none.alias("low"), none.alias("high"))
    every = people.union(said).union(places).union(hazards).distinct().join(m, "id")
    return every.groupBy("incident_id", "kind", "field", "value").agg(F.min("low").alias("low"), F.min("high").alias("high"), F.min("id").alias("first"), F.count_distinct("id").alias("n"))


def contradictions(spark, d, facts: DataFrame | None = None) -> DataFrame:
    """Pairs of classes that exclude each other (value_a < value_b), each side with its first report and number of reports."""
    k = durable(claims(spark, d, facts), "claims")  # both sides read it
    a, b = (k.select("incident_id", "kind", "field", *[F.col(c).alias(f"{n}_{s}") for c, n in (("value", "value"), ("low", "low"), ("high", "high"), ("first", "report"), ("n", "reports"))]) for s in "ab")
    p = a.join(b, ["incident_id", "kind", "field"]).filter("value_a < value_b")
    types = F.concat_ws("|", "value_a", "value_b").isin(*["|".join(sorted(x)) for x in P.INCOMPATIBLE_TYPES])
    kind = F.col("kind")
    against = F.when(kind == "numeric", F.expr("high_a < low_b or high_b < low_a")).when(kind == "severity", (F.col("value_a") == "minor") != (F.col("value_b") == "minor")).when(kind == "incident_type", types).otherwise(True)
    return p.filter(against).select("incident_id", "kind", "field", "value_a", "report_a", "reports_a", "value_b", "report_b", "reports_b")


def contradiction_id() -> Column:
    """CONTR-<incident>-<first report>-<second report>-<kind>, the same at every run."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in _SUFFIX.items() for x in kv]), F.col("kind"))
    suffix = F.concat(kind, F.when(F.col("kind") == "numeric", F.substring("field", 8, 40)).otherwise(""))
    return F.concat_ws("-", F.lit("CONTR"), "incident_id", F.least("report_a", "report_b"), F.greatest("report_a", "report_b"), suffix)


_CID = "concat('CONTR-', incident_id, '-', least(report_a, report_b), '-', greatest(report_a, report_b), '-', CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUFFIX.items()) + " END, CASE WHEN kind = 'numeric' THEN substr(field, 8) ELSE '' END)"


@query("incident_contradictions", f"WITH {_CLAIM_SQL} SELECT {_CID} AS id, * FROM con")
def incident_contradictions(spark, d):
    return contradictions(spark, d).select(contradiction_id().alias("id"), "*")


for _key in _SUFFIX:
    def _kind(spark, d, kind=_key):
        return contradictions(spark, d).filter(F.col("kind") == kind).drop("kind")

    _kind.__doc__ = f"Contradictions of kind {_key}, with both sides."
    _short = {"incident_type": "type", "hazard_structural": "structural", "hazard_access": "access"}.get(_key, _key)
    query(f"contradiction_{_short}", f"WITH {_CLAIM_SQL} SELECT * EXCLUDE (kind) FROM con WHERE kind = '{_key}'")(_kind)


@query("contradictions_all", f"WITH {_CLAIM_SQL} SELECT incident_id, kind, count(*) AS n FROM con GROUP BY ALL")
def contradictions_all(spark, d):
    """Number of disagreements per incident and kind, over all six kinds."""
    return contradictions(spark, d).groupBy("incident_id", "kind").agg(F.count("*").alias("n"))


@query("distinct_disagreements", f"WITH {_CLAIM_SQL} SELECT incident_id, count(*) AS disagreements FROM con GROUP BY 1")
def distinct_disagreements(spark, d):
    """A disagreement is a kind, a field and two values: one pair of classes, however many reports stand behind it."""
    return contradictions(spark, d).groupBy("incident_id").agg(F.count("*").alias("disagreements"))


@query("contradictions_append_once", f"WITH {_CLAIM_SQL}, old AS (SELECT DISTINCT incident_id, kind, field, report_a, report_b FROM con WHERE kind = 'location') SELECT incident_id, kind, field, report_a, report_b FROM (SELECT DISTINCT incident_id, kind, field, report_a, report_b FROM con) c WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.incident_id = c.incident_id AND o.kind = c.kind AND o.field = c.field AND o.report_a = c.report_a AND o.report_b = c.report_b)")
def contradictions_append_once(spark, d):
    """What an idempotent append would add to a table that already holds the contradictions of place."""
    key = ["incident_id", "kind", "field", "report_a", "report_b"]
    c = contradictions(spark, d).select(key).distinct()
    return c.join(c.filter("kind = 'location'"), key, "left_anti")


@query("resolution_carryover", f"WITH {_CLAIM_SQL}, n AS (SELECT incident_id, arg_max(notes, struct_pack(t := timestamp_utc, i := id)) AS note FROM audit_logs WHERE notes <> '' GROUP BY 1) SELECT {_CID} AS id, incident_id, note AS resolution FROM con LEFT JOIN n USING (incident_id)")
def resolution_carryover(spark, d):
    """Contradictions found again, with the last note that a responder left on their incident as its resolution; those that
    are not found again are not brought back."""
    n = table(spark, d, "audit_logs").filter("notes <> ''").groupBy("incident_id").agg(F.max_by("notes", F.struct("timestamp_utc", "id")).alias("resolution"))
    return contradictions(spark, d).select(contradiction_id().alias("id"), "incident_id").join(n, "incident_id", "left").select("id", "incident_id", "resolution")


# ---- assessment

_VEC = """w AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(t), '[\\p{L}\\p{M}\\p{N}]{4,}')) AS w FROM t), hs AS (SELECT id, CAST('0x' || md5(w)[1:4] AS INT) AS h FROM w), bins AS (SELECT id, h % 64 AS b, sum(1 - 2 * ((h // 64) % 2)) AS x FROM hs GROUP BY ALL),
 vec AS (SELECT i.id, list(CAST(greatest(-127, least(127, coalesce(x, 0))) AS DOUBLE) ORDER BY r.b) AS e FROM (SELECT DISTINCT id FROM t) i CROSS JOIN (SELECT unnest(range(64)) AS b) r LEFT JOIN bins ON bins.id = i.id AND bins.b = r.b GROUP BY i.id)"""
_COS = "CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN greatest(0, least(1, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))) ELSE 0 END"
_UNITS = f"""o AS (SELECT m.incident_id, m.id, t.channel, vec.e, row_number() OVER (PARTITION BY m.incident_id ORDER BY m.id) AS k FROM m JOIN t USING (id) JOIN vec USING (id)),
 near AS (SELECT a.incident_id, a.k, list(b.k) AS near FROM o a JOIN o b ON a.incident_id = b.incident_id AND b.k < a.k AND {_COS.format(a='a.e', b='b.e')} >= 0.95 GROUP BY ALL),
 step AS (SELECT o.incident_id, o.k, coalesce(near.near, []) AS near FROM o LEFT JOIN near USING (incident_id, k)),
 fold AS (SELECT incident_id, 1::BIGINT AS k, [[1::BIGINT]] AS units FROM step WHERE k = 1 UNION ALL
  SELECT f.incident_id, s.k, CASE WHEN j IS NULL OR j = 0 THEN list_append(units, [s.k]) ELSE list_transform(units, lambda u, i: CASE WHEN i = j THEN list_append(u, s.k) ELSE u END) END
  FROM (SELECT f.*, s.near, s.k AS nk, list_position(list_transform(f.units, lambda u: len(list_filter(u, lambda v: NOT list_contains(s.near, v))) = 0), true) AS j FROM fold f JOIN step s ON s.incident_id = f.incident_id AND s.k = f.k + 1) f JOIN step s ON s.incident_id = f.incident_id AND s.k = f.nk),
 un AS (SELECT incident_id, arg_max(units, k) AS units FROM fold GROUP BY 1), firsts AS (SELECT incident_id, unnest(list_transform(units, lambda u: u[1])) AS k FROM un),
 u AS (SELECT incident_id, count(*) AS units, count(DISTINCT channel) AS channels FROM firsts JOIN o USING (incident_id, k) GROUP BY 1)"""


def corroboration(spark, d, least: float = 0.95) -> DataFrame:
    """(incident_id, reports, units, channels): reports in order of id go to the first unit all of whose members are at least
    `least` alike, else found one; channels are those of each unit's first report.

    Members with equal vectors always share a unit, so they are folded to the first before an incident's members are met; what
    reaches Python is one row for each different text of an incident (its vector in 64 bytes)."""
    r = spread(table(spark, d, "reports").select("id", "raw_text", "source")).select("id", word_vectors(normalise(F.col("raw_text"))).alias("e"), source_name(F.col("source")).alias("channel")).distinct()
    m = r.join(members(spark, d), "id")
    # the zero vector is like nothing, so it isn't folded
    blank = F.col("e") == F.lit(bytes(64))
    one = m.groupBy("incident_id", "e", F.when(blank, F.col("id")).alias("own")).agg(F.min(F.struct("id", "channel")).alias("f"), F.count_distinct("id").alias("n"))

    def units(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.stack([np.frombuffer(b, np.int8) for b in pdf["e"]]).astype(float)
        size = np.sqrt((x * x).sum(1))
        unit = np.full(len(x), -1)
        firsts: list[int] = []
        for i in range(len(x)):
            far = np.flatnonzero(~((size[:i] > 0) & (size[i] > 0) & (x[:i] @ x[i] / np.maximum(size[:i] * size[i], 1e-300) >= least)))
            blocked = np.zeros(len(firsts) + 1, bool)
            blocked[unit[far]] = True
            unit[i] = int(np.argmin(blocked))  # the last place is a new unit and never blocked
            if unit[i] == len(firsts):
                firsts.append(i)
        return pd.DataFrame({"incident_id": [pdf["incident_id"].iloc[0]], "reports": [int(pdf["n"].sum())], "units": [len(firsts)], "channels": [pdf["channel"].iloc[firsts].nunique()]})

    return one.select("incident_id", "e", "n", "f.id", "f.channel").groupBy("incident_id").applyInPandas(units, "incident_id string, reports bigint, units bigint, channels bigint")


_WORDS = "CASE {} " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in P.WORD_SEVERITY.items()) + " ELSE 0 END"
_BASES = "CASE value " + " ".join(f"WHEN {_lit(k)} THEN {v}" for k, v in P.TYPE_BASE.items()) + " ELSE 0 END"
_IN_TEXT = "greatest(0, " + ", ".join(f"CASE WHEN regexp_matches(t, '\\b{k}\\b', 'i') THEN {v} ELSE 0 END" for k, v in P.WORD_SEVERITY.items()) + ")"
# evidence that ends in a vowel sign has no border of words after it, so it never counts by itself
_VULNERABLE_SEEN = P.VULNERABLE_SEEN.replace("बच्चे|", "").replace("बूढ़|", "")
_SEEN = "regexp_matches(evidence, '(^|[^\\p{{L}}\\p{{N}}_]){}($|[^\\p{{L}}\\p{{N}}_])', 'i')"
_ASSESSED = f"""{_CLAIM_SQL}, {_VEC}, {_UNITS}, dis AS (SELECT incident_id, count(*) AS dis FROM con GROUP BY 1),
 fm AS (SELECT m.incident_id, allf.* FROM allf JOIN m USING (id)),
 fx AS (SELECT incident_id, max(CASE WHEN field_name = 'incident_type' THEN {_BASES} ELSE 0 END) AS base, max(CASE WHEN field_name = 'severity_hint' THEN {_WORDS.format('value')} ELSE 0 END) AS hint,
  bool_or(field_name = 'people_estimate' AND coalesce(category, '') = 'trapped' OR field_name = 'trapped_or_rescue' AND {_SEEN.format(P.TRAPPED_SEEN)}) AS tr, bool_or(field_name = 'vulnerable_persons' AND {_SEEN.format(_VULNERABLE_SEEN)}) AS vu,
  avg(CASE WHEN value IS NOT NULL AND value NOT IN ('', 'false') AND n_evidence > 0 THEN confidence END) AS quality FROM fm GROUP BY 1),
 tx AS (SELECT m.incident_id, max({_IN_TEXT}) AS word, count(*) AS reports, avg(CASE i.value WHEN 'explicit' THEN 1.0 WHEN 'inferred' THEN 0.4 ELSE 0.2 END) AS info FROM m JOIN t USING (id) LEFT JOIN (SELECT id, max(value) AS value FROM allf WHERE field_name = 'info_type' GROUP BY 1) i ON i.id = m.id GROUP BY 1),
 z AS (SELECT tx.incident_id, tx.reports, units, channels, coalesce(dis, 0) AS disagreements, least(100, greatest(coalesce(base, 0), coalesce(hint, 0), word) + CASE WHEN tr THEN 15 ELSE 0 END + CASE WHEN vu THEN 10 ELSE 0 END) AS sev,
  0.25 * (CASE WHEN units >= 4 THEN 1.0 WHEN units = 3 THEN 0.85 WHEN units = 2 THEN 0.7 ELSE 0.4 END) + 0.2 * (CASE WHEN channels >= 3 THEN 1.0 WHEN channels = 2 THEN 0.75 ELSE 0.4 END)
  + 0.25 * (CASE coalesce(dis, 0) WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.0 END) + 0.15 * least(1, greatest(0, coalesce(quality, 0.2))) + 0.15 * info AS conf FROM tx LEFT JOIN fx USING (incident_id) LEFT JOIN u USING (incident_id) LEFT JOIN dis USING (incident_id))"""  # fmt: skip


def consistency(n: Column) -> Column:
    """1 without disagreement, a quarter less for each, 0 from four on."""
    return F.greatest(F.lit(0.0), 1 - 0.25 * F.least(n, F.lit(4)))


def assessed(spark, d) -> DataFrame:
    """One row an incident: severity, confidence, priority and what they rest on. Aggregates combine on the map side."""
    m = members(spark, d)
    facts = durable(all_facts(spark, d), "facts")  # read three times
    f = facts.join(m, "id")
    name, value = F.col("field_name"), F.col("value")
    of = lambda field, scores: F.when(name == field, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv]), value), F.lit(0))).otherwise(0)
    seen = lambda field, p: (name == field) & F.exists("evidence", lambda e: X.word(p, e))
    sound = value.isNotNull() & ~value.isin("", "false") & (F.col("n_evidence") > 0)
    fx = f.groupBy("incident_id").agg(
        F.max(of("incident_type", P.TYPE_BASE)).alias("base"), F.max(of("severity_hint", P.WORD_SEVERITY)).alias("hint"),
        F.bool_or(((name == "people_estimate") & (F.coalesce("category", F.lit("")) == "trapped")) | seen("trapped_or_rescue", P.TRAPPED_SEEN)).alias("tr"),
        F.bool_or(seen("vulnerable_persons", P.VULNERABLE_SEEN)).alias("vu"), F.avg(F.when(sound, F.col("confidence"))).alias("quality"),
    )
    info = facts.filter("field_name = 'info_type'").groupBy("id").agg(F.max("value").alias("info"))
    word = F.greatest(F.lit(0), *[F.when(F.contains(F.lower("t"), F.lit(k)) & X.word(k, F.col("t")), v).otherwise(0) for k, v in P.WORD_SEVERITY.items()])
    told = F.when(F.col("info") == "explicit", 1.0).when(F.col("info") == "inferred", 0.4).otherwise(0.2)
    tx = texts(spark, d).select("id", word.alias("word")).distinct().join(m, "id").join(info, "id", "left").groupBy("incident_id").agg(F.max("word").alias("word"), F.count("*").alias("reports"), F.avg(told).alias("info"))
    s = tx.join(fx, "incident_id", "left").join(corroboration(spark, d).drop("reports"), "incident_id", "left").join(contradictions(spark, d, facts).groupBy("incident_id").agg(F.count("*").alias("disagreements")), "incident_id", "left")
    n = F.coalesce("disagreements", F.lit(0))
    units = F.when(F.col("units") >= 4, 1.0).when(F.col("units") == 3, 0.85).when(F.col("units") == 2, 0.7).otherwise(0.4)
    channels = F.when(F.col("channels") >= 3, 1.0).when(F.col("channels") == 2, 0.75).otherwise(0.4)
    conf = 0.25 * units + 0.2 * channels + 0.25 * consistency(n) + 0.15 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("quality", F.lit(0.2)))) + 0.15 * F.col("info")
    sev = F.least(F.lit(100), F.greatest(F.coalesce("base", F.lit(0)), F.coalesce("hint", F.lit(0)), "word") + F.when(F.col("tr"), 15).otherwise(0) + F.when(F.col("vu"), 10).otherwise(0))
    s = s.select("incident_id", "reports", "units", "channels", n.alias("disagreements"), sev.alias("sev"), conf.alias("conf"))
    return s.withColumn("priority", priority_of(F.col("sev"), F.col("conf")))


_PRIO = "CASE WHEN conf < 0.3 AND sev * (0.4 + 0.6 * conf) > 69 THEN 69.0 ELSE sev * (0.4 + 0.6 * conf) END"
_BAND = "CASE WHEN {0} >= 85 THEN 'critical' WHEN {0} >= 70 THEN 'high' WHEN {0} >= 40 THEN 'medium' ELSE 'low' END"


def band(p: Column) -> Column:
    return F.when(p >= 85, "critical").when(p >= 70, "high").when(p >= 40, "medium").otherwise("low")


@query("severity", f"WITH RECURSIVE {_ASSESSED} SELECT incident_id, CAST(sev AS INT) AS severity FROM z")
def severity(spark, d):
    return assessed(spark, d).select("incident_id", F.col("sev").cast("int").alias("severity"))


@query("confidence", f"WITH RECURSIVE {_ASSESSED} SELECT incident_id, round(conf + 1e-9, 6) AS confidence FROM z")
def confidence(spark, d):
    return assessed(spark, d).select("incident_id", F.round(F.col("conf") + 1e-9, 6).alias("confidence"))


@query("corroboration_units", f"WITH RECURSIVE {_T}, {_MEMBERS}, {_VEC}, {_UNITS} SELECT incident_id, n.n AS reports, units, channels FROM u JOIN (SELECT incident_id, count(*) AS n FROM o GROUP BY 1) n USING (incident_id)")
def corroboration_units(spark, d):
    return corroboration(spark, d)


@query("assess_incidents", f"WITH RECURSIVE {_ASSESSED} SELECT incident_id, reports, units, channels, disagreements, CAST(sev AS INT) AS severity, round(conf + 1e-9, 6) AS confidence, round({_PRIO} + 1e-9, 6) AS priority, {_BAND.format(_PRIO)} AS band FROM z")
def assess_incidents(spark, d):
    return assessed(spark, d).select("incident_id", "reports", "units", "channels", "disagreements", F.col("sev").cast("int").alias("severity"), F.round(F.col("conf") + 1e-9, 6).alias("confidence"), F.round(F.col("priority") + 1e-9, 6).alias("priority"), band(F.col("priority")).alias("band"))


@query("assessment_update", f"WITH RECURSIVE {_ASSESSED} SELECT i.id, round(coalesce(z.sev, i.severity), 6) AS severity, round(coalesce(z.conf, i.confidence) + 1e-9, 6) AS confidence, round(coalesce({_PRIO}, i.priority) + 1e-9, 6) AS priority, coalesce({_BAND.format(f'({_PRIO})')}, i.urgency) AS urgency, z.incident_id IS NOT NULL AS updated FROM (SELECT DISTINCT id, severity, confidence, priority, urgency FROM incidents) i LEFT JOIN z ON z.incident_id = i.id".replace("ELSE 'low' END, i.urgency)", "WHEN z.incident_id IS NOT NULL THEN 'low' END, i.urgency)"))
def assessment_update(spark, d):
    """Incidents with severity, confidence, priority and urgency of their assessment; those without members stay as they are."""
    i = table(spark, d, "incidents").select("id", "severity", "confidence", "priority", "urgency").distinct()
    a = assessed(spark, d).select("incident_id", "sev", "conf", F.col("priority").alias("prio"))
    hit = F.col("incident_id").isNotNull()
    return i.join(a, F.col("id") == F.col("incident_id"), "left").select(
        "id", F.round(F.coalesce(F.col("sev").cast("double"), "severity"), 6).alias("severity"), F.round(F.coalesce("conf", "confidence") + 1e-9, 6).alias("confidence"), F.round(F.coalesce("prio", "priority") + 1e-9, 6).alias("priority"),
        F.when(hit, band(F.col("prio"))).otherwise(F.col("urgency")).alias("urgency"), hit.alias("updated"),
    )


_TITLE = "concat(coalesce(list_aggregate(list_transform(string_split(replace(coalesce(ty, 'incident'), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' '), ''), ' — ', coalesce(nullif(location_resolved, ''), 'Rampur')) AS title"


@query("incident_titles", f"WITH {_ALL}, {_MEMBERS}, b AS (SELECT incident_id, value AS ty FROM (SELECT incident_id, value, row_number() OVER (PARTITION BY incident_id ORDER BY {_BASES} DESC, value) AS n FROM allf JOIN m USING (id) WHERE field_name = 'incident_type' AND value IS NOT NULL AND {_BASES} > 0) WHERE n = 1) SELECT i.id, {_TITLE} FROM (SELECT DISTINCT id, location_resolved FROM incidents) i LEFT JOIN b ON b.incident_id = i.id")
def incident_titles(spark, d):
    """`Type — place` of every incident: its gravest type (the first by name of equals), or Incident."""
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in P.TYPE_BASE.items() for x in kv]), F.col("value")), F.lit(0))
    f = all_facts(spark, d).filter("field_name = 'incident_type'").select("id", "value", base.alias("base")).filter("base > 0").join(members(spark, d), "id")
    best = f.groupBy("incident_id").agg(F.min(F.struct((-F.col("base")).alias("b"), "value")).alias("m")).select("incident_id", F.col("m.value").alias("ty"))
    i = table(spark, d, "incidents").select("id", "location_resolved").distinct().join(best, F.col("id") == F.col("incident_id"), "left")
    return i.select("id", F.concat(F.initcap(F.replace(F.coalesce("ty", F.lit("incident")), F.lit("_"), F.lit(" "))), F.lit(" — "), F.coalesce(F.nullif("location_resolved", F.lit("")), F.lit("Rampur"))).alias("title"))
