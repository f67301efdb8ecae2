import random
import time
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sangam.functions.patterns import RELATED_TYPES
from sangam.operators.geo import _np_haversine
from sangam.operators.pairs import linked_pairs
from sangam.plans import fusion

REPORTS = "id string, place string, lat double, lon double, at timestamp, kind string, v long, e binary"
T0 = datetime(2025, 6, 1)
COLUMNS = ("id", "place", "lat", "lon", "us", "kind", "e")


def score(a, b, vectors):
    (_, pa, ya, xa, ta, ka, va), (_, pb, yb, xb, tb, kb, vb) = a, b
    e, f = vectors.get(va), vectors.get(vb)
    sem = max(0.0, float(np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f))) if e and f else 0.0
    geo = 0.0
    if None not in (ya, xa, yb, xb) and max(abs(ya), abs(yb)) <= 90:
        m = _np_haversine(ya, xa, yb, xb)
        geo = 1.0 if pa and pa == pb else max(0.0, 1 - m / 2000)
    dt = abs((ta - tb).total_seconds()) / 60 if ta and tb else 1e9
    tmp = 1.0 if dt <= 5 else max(0.0, 1 - (dt - 5) / 85)
    ka, kb = (k.strip().lower() if k else k for k in (ka, kb))
    typ = 0.0 if not ka or not kb else 1.0 if ka == kb else 0.5 if any({ka, kb} == set(p) for p in RELATED_TYPES) else 0.0
    return 0.4 * sem + 0.3 * geo + 0.15 * tmp + 0.15 * typ


def test_linked_pairs_against_all_pairs(spark):
    r = random.Random(8)
    vectors = {k: [round(20 * (r.gauss(0, 1) + (k % 3 == i) * 3)) for i in range(4)] for k in range(20)}
    rows = []
    for i in range(260):
        lat, lon = 28.6 + r.uniform(-0.04, 0.04), 78.9 + r.uniform(-0.04, 0.04)
        if r.random() < 0.2:
            lat, lon = r.choice([(None, None), (None, 78.9), (95.0, 78.9), (28.6, 78.9)])
        at = None if r.random() < 0.2 else T0 + timedelta(seconds=r.randrange(50000))
        rows.append((f"R{i:03d}", r.choice([None, "", "tola", "bagh"]), lat, lon, at, r.choice([None, "flood", " Flood", "waterlogging", "power_outage", ""]), r.choice([*range(21), None])))
    coded = [(*x, np.array(vectors.get(x[6]) or [0] * 4, np.int8).tobytes()) for x in rows]
    d = spark.createDataFrame(coded, REPORTS).withColumn("us", F.unix_micros("at")).select(*COLUMNS)
    got = {(x["id_a"], x["id_b"]): x["score"] for x in linked_pairs(d).collect()}
    cut = {(x["id_a"], x["id_b"]): x["score"] for x in linked_pairs(d, block=16, group_rows=100).collect()}  # every meeting place is hot
    assert got == cut and linked_pairs(d.limit(0)).count() == 0
    want = {(a[0], b[0]): s for a, b in combinations(rows, 2) if (s := score(a, b, vectors)) >= 0.6 - 1e-10}
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_crowd_at_one_place_costs_little(spark):
    """20,000 reports at one place, two hours apart and of unlike texts but for every hundredth, which repeats the one before. 200 million
    pairs meet; all factors of every pair took 44 s."""
    began = time.time()
    n = 20_000
    v = np.random.default_rng(3).integers(-3, 4, (n, 64)).astype(np.int8)
    v[99::100] = v[98::100]
    rows = [(f"R{i:05d}", "tola", 28.6, 78.9, i * 7_200_000_000, None, v[i].tobytes()) for i in range(n)]
    d = spark.createDataFrame(rows, "id string, place string, lat double, lon double, us long, kind string, e binary")
    got = {(x["id_a"], x["id_b"]): (x["geo"], x["tmp"], x["score"]) for x in linked_pairs(d, block=6000).collect()}
    assert got == {(f"R{i - 1:05d}", f"R{i:05d}"): (1.0, 0.0, 0.7) for i in range(99, n, 100)}
    assert time.time() - began < 20


@pytest.fixture()
def folder(spark, tmp_path):
    """R1 and R2: one place, three hours apart. R3 and R4: no time stored, no location but GPS. R5 and R6: 5 km, one minute. R7: nothing. All texts are alike."""
    ist = lambda m: f"2025-08-01T10:{m:02d}:00+05:30"
    rows = [
        ("R1", "sms", "tola", 28.6, 78.9, None, None, None, T0), ("R2", "sms", "tola", 28.6, 78.9, None, None, None, T0 + timedelta(hours=3)),
        ("R3", "sms", None, None, None, 28.9, 78.5, ist(1), None), ("R4", "sms", None, None, None, 28.9, 78.5, "01/08/2025 10:02", None),
        ("R5", "sms", None, 28.7, 78.1, None, None, None, T0 + timedelta(days=9)), ("R6", "sms", None, 28.745, 78.1, None, None, None, T0 + timedelta(days=9, minutes=1)),
        ("R7", "sms", None, None, None, None, None, "soon", None),
    ]
    spark.createDataFrame([(*x, "water is rising near the depot") for x in rows], "id string, source string, location_resolved string, location_lat double, location_lon double, gps_lat double, gps_lon double, received_at string, received_at_utc timestamp, raw_text string").write.parquet(f"{tmp_path}/reports.parquet")
    kinds = [(f"E{k}", f"R{k}", "incident_type", '"flood"') for k in (1, 2, 3, 4, 5, 6)]
    spark.createDataFrame(kinds, "id string, report_id string, field_name string, value string").write.parquet(f"{tmp_path}/extractions.parquet")
    return str(tmp_path)


def test_clusters_join_pairs_out_of_reach_on_one_axis(spark, folder):
    founder = {r["id"]: r["founder"] for r in fusion.cluster_reports(spark, folder).collect()}
    assert founder == {"R1": "R1", "R2": "R1", "R3": "R3", "R4": "R3", "R5": "R5", "R6": "R6", "R7": "R7"}
    related = {(r["cluster_a"], r["cluster_b"]): r["score"] for r in fusion.related_clusters(spark, folder).collect()}
    assert related == {("R5", "R6"): pytest.approx(0.7)}
