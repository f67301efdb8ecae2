import random

import pytest
from pyspark.sql import functions as F

from sangam.llm.mapping import Gazetteer, decode, distance, fold, map_values

ENTRIES = [
    ("pipoganj_tola", ["Pipoganj Tola", "पीपोगंज टोला", "Peepoganj Tola"], ["pipoganj tolaa", "near pipoganj tola", "pipoganj"]),
    ("dateveganj_colony", ["Dateveganj Colony", "दतेवेगंज कॉलोनी", "Dateveganj Colony"], ["dateveganj kalony"]),
    ("dateveganj_chowk", ["Dateveganj Chowk", "दतेवेगंज चौक", "Dateveganj Chowk"], ["dateveganj chawk"]),
    ("ghoghuli_pul", ["Ghoghuli Pul", "घोघुली पुल", "Ghoghulee Pul"], ["ghoghuli pool"]),
    ("mibochital_mohalla", ["Mibochital Mohalla", "मिबोचिताल मोहल्ला", "Mibochitaal Mohalla"], ["mibochital moh."]),
]
CASES = {
    "Pipoganj Tolaa": "pipoganj_tola", "ＰＩＰＯＧＡＮＪ ＴＯＬＡ": "pipoganj_tola", "Tola Peepogunj": "pipoganj_tola", "near piopganj tola,": "pipoganj_tola", "pipoganjtola": "pipoganj_tola",
    "पिपोगंज टोला में": "pipoganj_tola", "पी​पोगंजटोला": "pipoganj_tola", "Ρіpoganj": "pipoganj_tola", "Pipoganj Mandi": "unmatched", "Pipoganj Colony": "unmatched",
    "Dateveganj": "unmatched", "dateveganj chauk": "dateveganj_chowk", "the Dateveganj kalony side": "dateveganj_colony", "opp. Ghoghulee pool": "ghoghuli_pul", "GHOGHLI PUL": "ghoghuli_pul",
    "Mibochitaal Moh. ke paas": "mibochital_mohalla", "Mibochital Mohalla (main road)": "mibochital_mohalla", "unknown": "unmatched", "main road": "unmatched", "?": "unmatched", "Sovodikhera Chowk": "unmatched",
}


@pytest.mark.parametrize("value, want", CASES.items())
def test_values(value, want):
    g = Gazetteer(ENTRIES)
    assert g.match(value) == want and g.match(value) == want


def test_fold_and_decode():
    assert fold("Peepoganj") == fold("pipoganj") and fold("मंडी") == fold("मण्डी")
    assert decode('"a\\u0915"') == "aक" and decode("plain") == "plain" and decode("null") is None and decode(None) is None and decode("12") == "12"


def test_all_names_within_the_limit_are_compared():
    r = random.Random(4)
    for letters in ("bdghjkrsacivyuoh", "बदगजकरसशचिुा्ंण"):
        words = sorted({"".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(300)})
        g = Gazetteer([(f"p{k}", [f"{w} x"], []) for k, w in enumerate(words)])
        hits = 0
        for w in words:
            t = list(w)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], [r.choice(letters)], [t[k], r.choice(letters)]])
                t = t or ["b"]
            q = "".join(t)
            for limit in (0.6, 1.2, 1.65, 2.05):
                want = [(0.0, q)] if q in g.bases else sorted((d, n) for n in g.names if (d := distance(q, n, limit)) <= limit)
                assert g.near(q, limit) == want
                hits += len(want)
        assert hits > 500
    assert g.near("द" * 100_000, 2.05) == []


def test_equally_long_mentions_of_two_places():
    g = Gazetteer([("a", ["Bagha Tola"], []), ("b", ["Digho Tola"], [])])
    assert g.mentions("bagha tola digho tola".split()) == {"a", "b"} and g.mentions("digho tola".split()) == {"b"} and g.mentions(["x"]) is None


def test_column(spark):
    g = spark.createDataFrame([(i, n[0], n[1], n[2], a) for i, n, a in ENTRIES] + [(None, "x", None, None, None)], "location_id string, name_en string, name_hi string, name_hi_latn string, aliases array<string>")
    rows = [(1, '"Pipoganj Tola"', "x"), (2, '"Pipoganj Tolla"', "x"), (3, '"  "', "x"), (4, None, "x"), (5, "null", "x"), (2, '"Pipoganj Tolla"', "x"), (6, '"' + "main road " * 3000 + '"', "x")]
    d = spark.createDataFrame(rows, "id long, value string, entry string")
    m = map_values(d, F.col("value"), g, "location_id", ["name_en", "name_hi", "name_hi_latn"], "aliases")
    got = {r["id"]: (r["entry"], r["is_exact"]) for r in m.collect()}
    assert got == {1: ("pipoganj_tola", True), 2: ("pipoganj_tola", False), 3: (None, False), 4: (None, False), 5: (None, False), 6: ("unmatched", False)}
    none = map_values(d, F.col("value"), g.limit(0), "location_id", ["name_en", "name_hi", "name_hi_latn"], "aliases")
    assert {r["entry"] for r in none.collect()} == {"unmatched", None}
