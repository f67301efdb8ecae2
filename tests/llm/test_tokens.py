import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sangam.llm.tokens import PATTERN, StreamDecoder, TOKENIZERS, Transducer, count_tokens, decode_column, encode_column, encoder

PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
E = encoder(PATH)
T = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=E.m.ids, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aehtnsrio =-\n\t'sSll,.é中ि", max_size=200))
def test_same_as_the_public_encoder(text):
    ids = E.encode(text).tolist()
    assert ids == T.encode_ordinary(text)
    d = StreamDecoder(E.m)
    assert d.push(ids) + d.finish() == text


def test_long_pieces_and_special_strings():
    for text in ("a" * 5000, " " * 3000 + "x", "=" * 4000, "the" * 3000, "<|endoftext|> a <|startoftext|>", "ab\x1c\x85 c"):
        assert E.encode(text).tolist() == T.encode_ordinary(text)


def test_tokens_are_emitted_before_the_end_and_little_is_kept():
    t = Transducer(E.m)
    early = t.push(b"thequickbrownfox" * 2000)
    assert early + t.finish() == T.encode_ordinary("thequickbrownfox" * 2000)
    assert len(early) > 5000 and t.m.lookahead <= t.most_kept if t.most_kept else True
    t.push(b"x" * 10_000)
    assert t.most_kept <= 4 * t.m.lookahead


def test_columns(spark):
    rows = [(1, "Pipoganj पुल 🚒"), (2, ""), (3, None), (1, "Pipoganj पुल 🚒")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "ids_text")
    got = encode_column(d, "doc_id", "ids_text")
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == sorted((i, T.encode_ordinary(t or "")) for i, t in rows)
    assert sorted(r["text"] for r in decode_column(got, "doc_id", "ids").collect()) == sorted(t or "" for _, t in rows)
    assert sorted(r["n_tokens"] for r in count_tokens(d, "ids_text").collect()) == sorted(len(T.encode_ordinary(t or "")) for _, t in rows)
    assert encode_column(d.limit(0), "doc_id", "ids_text").count() == 0
