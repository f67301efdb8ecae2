from sangam.llm.pii import common_words


def test_frequent_words_of_all_texts(spark):
    plain = [f"water is rising near the depot in lane {k}" for k in range(12)]
    d = spark.createDataFrame([(t,) for t in [*plain, "Ask for Lapi Boru", None, ""]], "t string")
    common = common_words(d, "t")
    assert {"water", "depot", "lane"} <= common and common.isdisjoint({"lapi", "boru", ""})
