import random
from itertools import combinations

import pytest

from sangam.llm.spans import shared_factors, shared_parts, shared_spans, sharing_pairs, spans_of


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeअक\n 🚒") for _ in range(5))
    passages = ["".join(word() for _ in range(length // 2)) for _ in range(5)]
    footer = "".join(word() for _ in range(3 * length // 20))
    docs = {}
    for i in range(70):
        t = "".join(word() for _ in range(r.randrange(0, length)))
        for p in r.sample(passages, r.randrange(0, 2)):
            n = r.choice([length - 1, length, length + 1, 2 * length])
            a = r.randrange(0, len(p) - n + 1)
            t += p[a : a + n] + word() * 3
        docs[i] = t + (footer if r.random() < 0.5 else "")
    docs[70] = docs[1][:3] + (passages[0] + "x") * 3  # repeats inside one document
    return docs


def brute(docs, n):
    w = {i: {t[j : j + n] for j in range(len(t) - n + 1)} for i, t in docs.items()}
    return {(a, b) for a, b in combinations(sorted(w), 2) if w[a] & w[b]}


@pytest.mark.parametrize("hot", [64, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_cover(spark, hot, seed):
    n = 60
    docs = corpus(seed, n)
    d = spark.createDataFrame([*docs.items(), (900, None), (901, ""), (1, docs[1])], "doc_id long, text string")
    f = shared_factors(d, length=n, hot=hot)
    assert {tuple(r) for r in sharing_pairs(f).collect()} == brute(docs, n)
    for r in f.collect():
        a, b = docs[r["doc_a"]], docs[r["doc_b"]]
        assert r["doc_a"] < r["doc_b"] and r["size"] >= n and a[r["start_a"] : r["start_a"] + r["size"]] == b[r["start_b"] : r["start_b"] + r["size"]]
    parts = {r["doc_id"]: r["shared_chars"] for r in shared_parts(d, shared_spans(d, length=n, hot=hot)).collect()}
    assert parts == {r["doc_id"]: r["shared_chars"] for r in shared_parts(d, spans_of(f)).collect()}
    for i, t in docs.items():
        others = {x[j : j + n] for k, x in docs.items() if k != i for j in range(len(x) - n + 1)}
        cover = [False] * len(t)
        for j in range(len(t) - n + 1):
            if t[j : j + n] in others:
                cover[j : j + n] = [True] * n
        assert parts[i] == sum(cover)
    assert parts[900] == parts[901] == 0


def test_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert sharing_pairs(shared_factors(d)).count() == 0
    assert sharing_pairs(shared_factors(spark.createDataFrame([(1, "a" * 5000), (2, "b" * 100)], "doc_id long, text string"))).count() == 0
    same = spark.createDataFrame([(1, "a" * 5000), (2, "a" * 400)], "doc_id long, text string")
    assert [tuple(r) for r in sharing_pairs(shared_factors(same)).collect()] == [(1, 2)]


def test_a_footer_of_all_documents_stays_linear(spark):
    r = random.Random(3)
    footer = "".join(r.choice("abcdefghij ") for _ in range(70))
    n = 3000
    d = spark.createDataFrame([(i, f"{i * 7919:06d} " * 3 + footer) for i in range(n)], "doc_id long, text string")
    s = shared_spans(d, length=60, hot=64)
    assert s.count() <= n * 40  # not n * n
    assert {x["shared_chars"] >= 70 for x in shared_parts(d, s).collect()} == {True}
