import unicodedata
from timeit import repeat

from sangam.llm.canonical import base_form, canonicalise, repairs, suspicious


def test_base_form():
    assert base_form("Ｒｏａｄ to Café​ x­﻿") == "Road to Café x"
    assert base_form("अाज की अोर") == "आज की ओर"
    assert base_form("फ़") == base_form("फ़")
    assert base_form("a  b\nc!!") == "a  b\nc!!"  # number of blanks, line breaks and punctuation stay
    assert base_form("²") == "²"


def test_scripts_decide():
    assert repairs("hаі", "latin") [0] == "hai"
    assert suspicious("это обычный текст") == []
    assert suspicious("plain text") == []
    assert dict(suspicious("see ре here"))["ре"][0] == "pe"


def test_only_into_words_of_the_corpus(spark):
    rows = [(1, "the road is blocked"), (2, "thе roаd is blocked"), (3, "zzqаx once"), (4, "wоrdz twice"), (5, "wordz tωice"), (6, None), (7, ""), (8, "wοrdz again"), (2, "thе roаd is blocked")]
    d = spark.createDataFrame(rows, "id long, raw string")
    got = {r["id"]: r["canonical"] for r in canonicalise(d, "id", "raw").collect()}
    assert got[1] == got[2] == "the road is blocked"
    assert got[3] == "zzqаx once"  # its repair is no word of the corpus
    assert got[4] == "wordz twice" and got[8] == "wordz again"
    assert got[6] is None and got[7] == ""
    far = {r["id"]: r["canonical"] for r in canonicalise(d, "id", "raw", max_known=0).collect()}
    assert far == got  # the way for vocabularies of any size
    assert canonicalise(d.limit(0), "id", "raw").count() == 0


def test_base_form_of_text_without_anything_to_replace_is_cheap():
    """Less than four times the time of composing the accents alone."""
    text = "वार्ड कार्यालय के पास सड़क सुबह से बंद है। " * 200
    assert base_form(text) == unicodedata.normalize("NFC", text)
    own, least = (min(repeat(f, number=20, repeat=7)) for f in (lambda: base_form(text), lambda: unicodedata.normalize("NFC", text)))
    assert own < 4 * least
