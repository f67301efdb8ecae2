import random
import time
from datetime import datetime, timedelta
from itertools import combinations


import pytest

from sangam.operators.cluster import cluster, components, greedy, invalid_scores, numbered, related
from sangam.operators.geo import _np_haversine
from sangam.operators.pairs import near_pairs
from sangam.streaming.fusion import assign_new, read_reports, run


def frames(spark, scores):
    ids = sorted({x for p in scores for x in p})
    return spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a string, b string, score double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["founder"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


CASES = [
    ({("A", "B"): 0.85, ("B", "C"): 0.86, ("A", "C"): 0.42}, [["A", "B"], ["C"]]),
    ({("A", "B"): 0.85, ("A", "C"): 0.40, ("A", "D"): 0.30, ("B", "C"): 0.85, ("B", "D"): 0.45, ("C", "D"): 0.90}, [["A", "B"], ["C", "D"]]),
    ({("A", "B"): 0.85, ("B", "C"): 0.88, ("A", "C"): 0.82}, [["A", "B", "C"]]),
    ({("A", "B"): 0.80}, [["A", "B"]]),
    ({("A", "B"): 0.79}, [["A"], ["B"]]),
]


@pytest.mark.parametrize("scores, want", CASES)
def test_known_matrices(spark, scores, want):
    assert groups(cluster(*frames(spark, scores))) == want


def test_random_graphs_match_the_whole_greedy(spark):
    r = random.Random(4)
    ids = [f"R{i:02d}" for i in range(40)]
    scores = {p: round(r.random(), 3) for p in combinations(ids, 2) if r.random() < 0.25}
    want = greedy(ids, scores, 0.8)
    records = spark.createDataFrame([(i,) for i in ids], "id string")
    c = cluster(records, frames(spark, scores)[1])
    assert {x["id"]: x["founder"] for x in c.collect()} == want
    names = {x["founder"]: x["cluster_id"] for x in numbered(c).collect()}
    assert [names[f] for f in sorted(names)] == [f"INC-{k:03d}" for k in range(1, len(names) + 1)]
    best = {}
    for (a, b), s in scores.items():
        if want[a] != want[b]:
            k = tuple(sorted((want[a], want[b])))
            best[k] = max(best.get(k, 0), s)
    assert {(x["cluster_a"], x["cluster_b"]): x["score"] for x in related(c, frames(spark, scores)[1]).collect()} == {k: s for k, s in best.items() if 0.6 <= s < 0.8}


def test_long_chain_of_strong_pairs_costs_little():
    """Only clusters of a record's strong partners are tried; each record tried all of some 10,000 clusters."""
    ids = [f"R{i:05d}" for i in range(20_000)]
    began = time.time()
    founder = greedy(ids, {p: 0.9 for p in zip(ids, ids[1:])}, 0.8)
    assert founder == {r: ids[i - i % 2] for i, r in enumerate(ids)} and time.time() - began < 5


def test_scores_are_checked(spark):
    bad = spark.createDataFrame([("A", "B", x) for x in (-0.01, 1.0001, float("nan"), float("inf"), None)] + [("A", "B", 0.5)], "a string, b string, score double")
    assert invalid_scores(bad).count() == 5
    with pytest.raises(Exception, match="outside"):
        cluster(spark.createDataFrame([("A",)], "id string"), bad).collect()


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(60)] + [("a", "b")], "a string, b string")
    got = components(e).collect()
    assert {r["component"] for r in got} == {"000", "a"} and len(got) == 63


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(5)
    rows = [(f"R{i:03d}", 28.6 + r.uniform(-0.05, 0.05), 78.9 + r.uniform(-0.05, 0.05), datetime(2025, 6, 1) + timedelta(minutes=r.randrange(600))) for i in range(150)]
    rows += [("R900", None, 78.9, datetime(2025, 6, 1)), ("R901", 28.6, 78.9, None)]
    got = {(x["id_a"], x["id_b"]) for x in near_pairs(spark.createDataFrame(rows, "id string, lat double, lon double, at timestamp")).collect()}
    want = {(a[0], b[0]) for a, b in combinations(rows[:150], 2) if _np_haversine(a[1], a[2], b[1], b[2]) <= 2000 and abs((a[3] - b[3]).total_seconds()) <= 5400}
    assert got == want and want


def test_incremental_keeps_clusters_complete(spark):
    state = spark.createDataFrame([("A", "A"), ("B", "A"), ("X", "X")], "id string, founder string")
    pairs = spark.createDataFrame([("A", "C", 0.9), ("B", "C", 0.7), ("A", "D", 0.9), ("B", "D", 0.85), ("C", "D", 0.9), ("D", "X", 0.81)], "a string, b string, score double")
    new = spark.createDataFrame([("C",), ("D",), ("E",)], "id string")
    assert {r["id"]: r["founder"] for r in assign_new(new, state, pairs).collect()} == {"C": "C", "D": "C", "E": "E"}


def test_stream_of_files(spark, tmp_path):
    spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "id string, t string").write.parquet(str(tmp_path / "in"))
    got = []
    run(read_reports(spark, str(tmp_path / "in"), "id string, t string"), str(tmp_path / "cp"), lambda b, n: got.extend(r["id"] for r in b.collect())).awaitTermination(60)
    assert sorted(got) == ["1", "2"]
