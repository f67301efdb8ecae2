import random

from sangam.operators.vectors import indel_ratio, ratios
from sangam.plans import fusion


def test_ratios_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randrange(1, 5)))
    names = [(f"L{k}", " ".join(word() for _ in range(r.randrange(1, 4)))) for k in range(80)]
    texts = sorted({" ".join(word() for _ in range(r.randrange(1, 4))) for _ in range(80)})
    got = {(x["t"], x["location_id"]) for x in ratios(spark.createDataFrame([(t,) for t in texts], "t string"), "t", names, 0.75).collect()}
    two = lambda a, b: max(indel_ratio(a, b), indel_ratio(*(" ".join(sorted(s.split())) for s in (a, b))))
    want = {(t, k) for t in texts for k, n in names if two(t, n) >= 0.75}
    assert got == want and len(want) > 50


def test_a_slip_at_the_start_keeps_its_place(spark, tmp_path):
    spark.createDataFrame([("mandi", "Chitabesar Mandi", "x", "y", ["z"]), ("bagh", "Nolekot Bagh", "x", "y", ["z"])], "location_id string, name_en string, name_hi string, name_hi_latn string, aliases array<string>").write.parquet(f"{tmp_path}/rampur.parquet")
    spark.createDataFrame([("E1", "R1", "location_raw", '"chtabesar mndi"'), ("E2", "R2", "location_raw", '"Nolekot Bagh"')], "id string, report_id string, field_name string, value string").write.parquet(f"{tmp_path}/extractions.parquet")
    assert [(r["phrase"], r["location_id"]) for r in fusion.gazetteer_fuzzy(spark, str(tmp_path)).collect()] == [("chtabesar mndi", "mandi")]
