import random

import numpy as np

from sangam.llm.language import temperature, LANGUAGES, fit, label_texts, pieces_of, sentences, train

EN = ["The road near {} is blocked since morning.", "Please send two boats to {} today.", "Water has entered the houses around {}.", "Nobody from the ward office has come to {}."]
HI = ["{} के पास सड़क सुबह से बंद है।", "आज {} में दो नाव भेज दीजिए।", "{} के घरों में पानी घुस आया है।", "वार्ड कार्यालय से {} कोई नहीं आया।"]
RO = ["{} ke paas sadak subah se band hai.", "Aaj {} mein do naav bhej do.", "{} ke gharon mein paani ghus aaya hai.", "Ward se {} koi nahi aaya."]
SETS = dict(zip(LANGUAGES, (EN, HI, RO)))


def sentence(r, lang):
    name = "".join(r.choice(["pi", "bo", "gan", "ra", "mu"]) for _ in range(3)).title() if lang != "hi" else "".join(r.choice(["पी", "बो", "गंज", "रा"]) for _ in range(3))
    return r.choice(SETS[lang]).format(name)


def test_sentences():
    assert len(sentences("Plot No. 5 is here. We left! क्या? हाँ।")) == 4
    assert len(sentences("first line here\nsecond line here")) == 2
    assert [p[2].strip() for p in pieces_of("Fwd: Help us now. (T-0001) a@b.org")] == ["help us now"]


def test_held_out_accuracy(spark):
    r = random.Random(1)
    rows = []
    for i in range(900):
        lang = r.choice(LANGUAGES)
        label = lang if r.random() < 0.8 else r.choice([None, "", "xx", *LANGUAGES])
        rows.append((i, " ".join(sentence(r, lang) for _ in range(3)), label))
    d = spark.createDataFrame(rows, "id long, t string, language string")
    m = fit(d, "id", "t", "language")
    test, want = [], []
    for i in range(200):
        langs = r.sample(LANGUAGES, r.choice([1, 1, 2]))
        test.append((i, " ".join(sentence(r, x) for x in langs for _ in range(2)), "seg"))
        want.append(sorted(langs))
    test += [(900, None, "seg"), (901, "", "seg"), (902, "123 !!", "seg"), (903, (EN[0] + " ") * 4000, "seg")]
    got = {x["id"]: x for x in label_texts(spark.createDataFrame(test, "id long, t string, segments string"), "t", m).collect()}
    right = np.mean([sorted(got[i]["languages"]) == w for i, w in enumerate(want)])
    assert right >= 0.97
    assert got[900]["languages"] == got[901]["languages"] == got[902]["languages"] == [] and got[902]["found_confidence"] is None
    assert got[903]["languages"] == ["en"] and len(got[903]["segments"]) == 4000
    assert all(0 < s["confidence"] <= 1 for i in range(200) for s in got[i]["segments"])


def test_empty_table(spark):
    d = spark.createDataFrame([], "id long, t string, language string")
    assert label_texts(d, "t", fit(d, "id", "t", "language")).count() == 0


def test_training_drops_wrong_labels():
    r = random.Random(3)
    y = [r.randrange(3) for _ in range(600)]
    texts = [f" {sentence(r, LANGUAGES[k]).lower()} " for k in y]
    noisy = np.array([k if r.random() < 0.75 else r.randrange(3) for k in y])
    m = train(texts, noisy, np.ones(1 << 16))
    assert (m.probabilities(texts).argmax(1) == np.array(y)).mean() > 0.97 and m.temperature > 0


def test_temperature_is_reliable_under_wrong_labels():
    """Beliefs that are twice as sure as they should be, labels of which a fifth is wrong: the fitted temperature makes the
    stated confidence equal to how often the model is right, within 5 %."""
    r = np.random.default_rng(9)
    logits = r.normal(0, 1.5, (6000, 3))
    true = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    y = (true.cumsum(1) > r.random((6000, 1))).argmax(1)
    noisy = np.where(r.random(6000) < 0.2, r.integers(0, 3, 6000), y)
    sure = np.exp(2 * logits) / np.exp(2 * logits).sum(1, keepdims=True)
    t = temperature(sure, noisy)
    q = sure ** (1 / t)
    q /= q.sum(1, keepdims=True)
    for low, high in ((0.4, 0.6), (0.6, 0.8), (0.8, 0.95)):
        at = (q.max(1) >= low) & (q.max(1) < high)
        assert abs(q.max(1)[at].mean() - (q.argmax(1) == y)[at].mean()) < 0.05
    assert 1.6 < t < 2.5
