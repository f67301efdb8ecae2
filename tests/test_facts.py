import math

import pytest
from pyspark.sql import functions as F

from sangam.functions import text as X
from sangam.operators.vectors import embed_text, indel_ratio
from sangam.plans.fusion import priority_of

TEXTS = {
    "a": "Flooding near Kotwali, 5 people trapped, need rescue immediately!!!!",
    "b": "No immediate danger. Minor flooding, vehicles can pass slowly.",
    "c": "Road completely blocked; stranded vehicles on both sides.",
    "d": "stranded residents are screaming for help, 10-15 log",
    "e": "परिवार छत पर फंस गया, तुरंत मदद भेजो, बच्चे साथ हैं",
    "f": "",
    "g": None,
    "h": "power outage reportedly; someone said wall leaning, about 20 residents",
    "i": "x " * 20000 + "critical",
}


@pytest.fixture(scope="module")
def facts(spark):
    t = F.col("t")
    d = spark.createDataFrame([*TEXTS.items(), ("a", TEXTS["a"])], "id string, raw string").withColumn("t", X.normalise(F.col("raw")))
    cols = {"kind": X.incident_type(t)["value"], "sev": X.severity_hint(t)["value"], "vul": X.vulnerable(t), "trap": X.trapped(t), "urg": X.urgent(t), "info": X.info_type(t, F.lit("sms"))["value"], "people": X.people(t), "t": t}
    return {r["id"]: r for r in d.select("id", *[c.alias(k) for k, c in cols.items()]).collect()}


def test_types_and_levels(facts):
    assert [facts[k]["kind"] for k in "abcdefgh"] == ["rescue_needed", "flood", "road_blocked", "rescue_needed", "rescue_needed", None, None, "power_outage"]
    assert facts["b"]["sev"] == "minor" and facts["c"]["sev"] == "severe" and facts["i"]["sev"] == "critical"


def test_looking_around(facts):
    assert facts["a"]["urg"] == 90 and facts["b"]["urg"] == 0 and facts["e"]["urg"] == 90
    assert facts["c"]["trap"] == 0 and facts["d"]["trap"] == 95 and facts["a"]["trap"] == 90
    assert facts["e"]["vul"] == 90 and facts["a"]["vul"] == 0


def test_people_and_info(facts):
    assert [tuple(p) for p in facts["a"]["people"]] == [("trapped", 5, 5)]
    assert [tuple(p) for p in facts["d"]["people"]] == [("nearby", 10, 15)]
    assert [tuple(p) for p in facts["h"]["people"]] == [("affected", 20, 20)]
    assert facts["h"]["info"] == "inferred" and facts["f"]["info"] is None


def test_normalised_text(facts, spark):
    assert facts["a"]["t"].endswith("immediately!") and facts["g"]["t"] == "" and facts["f"]["t"] == ""
    odd = spark.createDataFrame([("  a​ \t b...... what???  ",), ("क़",)], "raw string").select(X.normalise(F.col("raw")).alias("t")).collect()
    assert odd[0]["t"] == "a b... what?" and odd[1]["t"] == "क़"


def test_rules_for_source_and_language(spark):
    d = spark.createDataFrame([("Field-Worker", "paani bahut tez hai", "hi"), (" WA ", "सड़क", "en"), ("web portal", "all fine", None), (None, None, " ")], "s string, t string, l string")
    got = [tuple(r) for r in d.select(X.source_name(F.col("s")), X.language_by_rules(F.col("t"), F.col("l"))).collect()]
    assert got == [("field_worker", "hi-Latn"), ("whatsapp", "hi"), ("web portal", "en"), (None, "en")]


def test_evidence(spark):
    from sangam.plans.records import facts_of

    d = spark.createDataFrame([*TEXTS.items()], "id string, raw string").select("id", X.normalise(F.col("raw")).alias("t"), F.when(F.col("id") == "f", "field_worker").otherwise("sms").alias("channel"))
    got = {}
    for r in facts_of(d).collect():
        got.setdefault((r["id"], r["field_name"]), []).append(r)
    one = lambda i, f: got[i, f][0]
    assert one("a", "incident_type")["evidence"] == ["trapped", "rescue"] or one("a", "incident_type")["evidence"] == ["rescue", "trapped"]
    assert one("a", "urgency_signals")["evidence"] == ["immediately", "need rescue"] and one("b", "urgency_signals")["value"] is None
    assert one("a", "people_estimate")["value"] == "5-5 trapped".replace("5-5", "5") and one("a", "people_estimate")["evidence"] == ["5 people trapped"]
    assert one("e", "vulnerable_persons")["evidence"] == ["बच्चे"] and one("c", "trapped_or_rescue")["value"] is None
    assert one("a", "location_raw")["value"].startswith("Kotwali") and one("a", "location_raw")["confidence"] == 90
    assert one("f", "info_type")["value"] == "explicit" and one("g", "info_type")["value"] is None
    texts = {r["id"]: r["t"] for r in d.collect()}
    for (i, f), rows in got.items():
        for r in rows:
            assert (r["value"] is None) == (not r["evidence"]) and all(e in texts[i] for e in r["evidence"] if f != "info_type")
    assert facts_of(d.limit(0)).count() == 0


@pytest.fixture(scope="module")
def incident(spark, tmp_path_factory):
    """One incident with a disagreement of every kind, and one without."""
    from sangam.plans import records

    p = str(tmp_path_factory.mktemp("incident"))
    rows = [
        ("R1", "sms", "Critical: 8 people trapped, wall collapsed, road completely blocked", "tola"), ("R2", "web", "Minor flooding, 2 - 5 people, structure appears stable, vehicles can pass slowly", "bagh"),
        ("R3", "sms", "2 people trapped, all fine", None), ("R4", "sms", "water rising near the depot today", None), ("R5", "web", "water rising near the depot today", None),
    ]
    spark.createDataFrame(rows, "id string, source string, raw_text string, location_resolved string").write.parquet(f"{p}/reports.parquet")
    spark.createDataFrame([(1, "R1", "incident_type", '"drought"', 0.9, '["x"]'), (2, "R2", "incident_type", '"flood"', 0.9, '["x"]')], "id long, report_id string, field_name string, value string, confidence double, evidence string").write.parquet(f"{p}/extractions.parquet")
    spark.createDataFrame([("I1", "R1"), ("I1", "R2"), ("I1", "R3"), ("I2", "R4"), ("I2", "R5"), ("I2", "R5")], "incident_id string, report_id string").write.parquet(f"{p}/incident_reports.parquet")
    return records, p


def test_contradictions_of_every_kind(spark, incident):
    records, p = incident
    got = {(r["kind"], r["value_a"], r["value_b"], r["id"]) for r in records.incident_contradictions(spark, p).collect()}
    assert {k for k, *_ in got} == {"numeric", "severity", "incident_type", "location", "hazard_structural", "hazard_access"}
    assert ("numeric", "2-2", "8-8", "CONTR-I1-R1-R3-NUM-trapped") in got and ("severity", "critical", "minor", "CONTR-I1-R1-R2-SEV") in got
    n = {r["incident_id"]: r["disagreements"] for r in records.distinct_disagreements(spark, p).collect()}
    assert n == {"I1": 6}


def test_confidence_falls_with_disagreement(spark, incident):
    records, p = incident
    a = {r["incident_id"]: r for r in records.assessed(spark, p).collect()}
    assert a["I1"]["disagreements"] == 6 and a["I1"]["sev"] == 100 and (a["I1"]["units"], a["I1"]["channels"]) == (3, 2)
    # two copies on two channels are one unit of one channel; type flood 65
    assert (a["I2"]["units"], a["I2"]["channels"], a["I2"]["sev"]) == (1, 1, 65)
    assert a["I2"]["conf"] == pytest.approx(0.25 * 0.4 + 0.2 * 0.4 + 0.25 + 0.15 * 0.8 + 0.15 * 0.2)


def test_priority(spark):
    d = spark.createDataFrame([(80.0, 0.5), (100.0, 0.29), (100.0, 0.3), (50.0, 0.585625)], "s double, c double")
    got = [r[0] for r in d.select(priority_of(F.col("s"), F.col("c"))).collect()]
    assert got == pytest.approx([56.0, 57.4, 58.0, 37.56875])


def test_vectors():
    v = embed_text("water is rising")
    assert math.isclose(sum(x * x for x in v), 1, rel_tol=1e-5) and embed_text("  ") == embed_text(None) == [0.0] * 64
    assert indel_ratio("abcd", "abd") == pytest.approx(6 / 7) and indel_ratio("", "") == 1 and indel_ratio("a", "") == 0
