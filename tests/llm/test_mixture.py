import random

import pytest

from sangam.llm.mixture import mix, plan


def test_plan():
    assert plan({"a": (0.5, 1, 100), "b": (0.5, 2, 100)}, None, 0.5) == {"a": 1.0, "b": 1.0}
    p = plan({"a": (0.9, 1, 1000), "b": (0.1, 2, 10), "c": (0.1, 5, 0)}, None, 0.5)
    assert p["b"] == 2.0 and abs(p["a"] - (0.5 * 1010 - 20) / 1000) < 1e-9 and "c" not in p
    assert plan({}, None, 0.5) == {}
    assert plan({"a": (0.5, 3, 10), "b": (0.5, 1, 10)}, 1000, 0.5) == {"a": 3.0, "b": 1.0}


def test_shares_and_repeats(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(["water", "road", "पुल", "help"]) for _ in range(r.randrange(5, 60))), r.choice(["a"] * 8 + ["b"] * 3 + ["c"])) for i in range(1500)]
    docs += [(9001, None, "a"), (9002, "  ", "a"), (9003, "text", None), (9004, "text", "unlisted"), (9005, "", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 2), ("c", 0.2, 4), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    for bucket_rows in (100_000, 50):
        m, rep = mix(d, t, bucket_rows=bucket_rows)
        rep = {x["source"]: x for x in rep.collect()}
        for s, share in (("a", 0.4), ("b", 0.4), ("c", 0.2)):
            assert rep[s]["actual_share"] == pytest.approx(share, abs=0.01) and rep[s]["most_repeats"] <= rep[s]["max_repeats"]
        assert rep["gone"]["tokens"] == 0 and rep["gone"]["actual_share"] == 0
        rows = m.collect()
        assert not {x["doc_id"] for x in rows} & {9001, 9002, 9003, 9004, 9005}
        assert {s: sum(x["n_tokens"] * x["copies"] for x in rows if x["source"] == s) for s in "abc"} == {s: rep[s]["tokens"] for s in "abc"}
        assert all(len({x["copies"] for x in rows if x["source"] == s}) <= 2 for s in "abc")


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    m, rep = mix(d, t)
    assert m.count() == 0 and rep.collect()[0]["tokens"] == 0
