"""Long exact spans shared between documents, by winnowed anchors and extension of matches.

No document is greedily factored against an indexed reference (relative Lempel-Ziv parsing): that needs every document to
meet every reference block. Instead, a span of `length` code points holds `length - gram + 1` grams, so the least hash in
every run of that many grams marks an anchor that both documents choose (winnowing), and only stretches around equal
anchors meet. For anchors with few occurrences the match is grown at the anchor to both sides and kept if it is at least
`length` long: texts decide.

An anchor with very many occurrences (a recurring footer) is split: every window of `length` code points through it
becomes a key of its own, and documents share a span if they share a key. The key is a 128-bit digest of the window; the
texts themselves are not compared again there.

Defined results: null and short texts share nothing; a repetition inside one document is none; rows of one doc_id and
equal text count once (copies add nothing to pairs or cover); texts are used whole, line breaks and blanks included.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from sangam.session import durable

_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 19  # code points hashed at a time; longer texts are chunks of their own


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for every i, in linear time (prefix and suffix minima of blocks)."""
    n = len(x)
    pad = (-n) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    prefix = np.minimum.accumulate(y, axis=1).ravel()
    suffix = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


class Anchors:
    """Anchors of texts: positions and 64-bit hashes of the chosen grams."""

    def __init__(self, length: int, gram: int):
        self.gram, self.window = gram, length - gram + 1
        self.length = length
        self._grow(CHUNK)

    def _grow(self, n: int) -> None:
        self.up = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _P))])
        self.down = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _PI))])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of text, position, hash)."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        keep = np.flatnonzero(sizes >= self.length)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]
        start = 0
        while start < len(keep):
            end, total = start + 1, int(sizes[keep[start]])
            while end < len(keep) and total + sizes[keep[end]] <= CHUNK:
                total += int(sizes[keep[end]])
                end += 1
            out.append(self._chunk([texts[i] for i in keep[start:end]], keep[start:end], sizes[keep[start:end]]))
            start = end
        return tuple(np.concatenate(x) for x in zip(*out))

    def _chunk(self, texts, ids, sizes):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, k = len(codes), self.gram
        if n >= len(self.up):
            self._grow(2 * n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1)) * self.up[:n])])
        grams = _mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
        bits = np.uint64(max(1, n.bit_length()))
        order = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        least = sliding_min(order, self.window)
        starts = np.arange(len(least))
        inside = starts + self.length <= ends[owner[: len(least)]]
        at = (least[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        own = owner[at]
        return ids[own], at - (ends - sizes)[own], grams[at].view(np.int64)


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


FACTOR = StructType([StructField("doc_a", LongType()), StructField("doc_b", LongType()), StructField("start_a", LongType()), StructField("start_b", LongType()), StructField("size", IntegerType())])


def factor_block(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Factors of the stretches of one block against its other stretches: rows (doc, start, at, text, h), at = the anchor's place in text."""
    out = []
    for _, g in pdf.groupby("h", sort=False):
        if len(g) < 2:
            continue
        by: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for doc, start, at, text in zip(g["doc"], g["start"], g["at"], g["text"]):
            by.setdefault((text, at), []).append((doc, start))
        parts = list(by.items())
        halves = [(text[at:], text[:at][::-1]) for (text, at), _ in parts]
        for i, ((text, at), own) in enumerate(parts):
            if len(text) >= length:
                for x in range(len(own)):
                    for y in range(x + 1, len(own)):
                        if own[x][0] != own[y][0]:
                            out.append((own[x][0], own[y][0], own[x][1], own[y][1], len(text)))
            for j in range(i + 1, len(parts)):
                right = _common_prefix(halves[i][0], halves[j][0])
                left = _common_prefix(halves[i][1], halves[j][1])
                if left + right >= length:
                    at2 = parts[j][0][1]
                    for d1, s1 in own:
                        for d2, s2 in parts[j][1]:
                            if d1 != d2:
                                out.append((d1, d2, s1 + at - left, s2 + at2 - left, left + right))
    rows = [(a, b, x, y, n) if a < b else (b, a, y, x, n) for a, b, x, y, n in out]
    return pd.DataFrame(rows, columns=["doc_a", "doc_b", "start_a", "start_b", "size"])


def _meetings(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int | None, hot: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Factors of the anchors with up to `hot` occurrences, and (doc, start, k1, k2): the windows through all other anchors."""
    gram = gram or length // 2
    reach = length - gram
    d = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).filter(F.length("text") >= length)
    marks = StructType([StructField("doc", LongType()), StructField("pos", LongType()), StructField("h", LongType())])

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Anchors(length, gram)
        for b in batches:
            ids, pos, h = a.of(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(ids)), pa.array(pos), pa.array(h)], names=["doc", "pos", "h"])

    found = durable(d.mapInArrow(anchor, marks), "anchors")
    repeated = found.groupBy("h").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.count("*").alias("c")).filter("a < b").select("h", "c")
    hits = found.join(repeated, "h").groupBy("doc").agg(F.collect_list(F.struct("pos", "h", "c")).alias("hits"))
    stretch = StructType([StructField("doc", LongType()), StructField("start", LongType()), StructField("at", IntegerType()), StructField("text", StringType()), StructField("h", LongType()), StructField("c", LongType())])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, text, hits in zip(b["doc"], b["text"], b["hits"]):
                for x in hits:
                    p = x["pos"]
                    s = max(0, p - reach)
                    rows.append((doc, s, p - s, text[s : p + length], x["h"], x["c"]))
            yield pd.DataFrame(rows, columns=stretch.names)

    stretches = durable(d.join(hits, "doc").mapInPandas(cut, stretch), "stretches")
    calm = stretches.filter(F.col("c") <= hot)
    blocks = max(1, calm.count() // block_rows + 1)
    few = calm.groupBy(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block")).applyInPandas(lambda pdf: factor_block(pdf, length), FACTOR)
    window = StructType([StructField("doc", LongType()), StructField("start", LongType()), StructField("k1", LongType()), StructField("k2", LongType())])

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, start, text in zip(b["doc"], b["start"], b["text"]):
                for j in range(len(text) - length + 1):
                    k = blake2b(text[j : j + length].encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    rows.append((doc, start + j, int.from_bytes(k[:8], "big", signed=True), int.from_bytes(k[8:], "big", signed=True)))
            yield pd.DataFrame(rows, columns=window.names)

    return few, stretches.filter(F.col("c") > hot).mapInPandas(windows, window)


def _met(keyed: DataFrame) -> DataFrame:
    """Digests of the windows that two documents have; their smallest and largest document tell it, so a window's documents are
    never gathered."""
    return keyed.groupBy("k1", "k2").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("k1", "k2")


def shared_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240, gram: int | None = None, hot: int = 64, block_rows: int = 20_000, cover: bool = True) -> DataFrame:
    """Factors (doc_a < doc_b, start_a, start_b, size >= length): together they cover every shared span; long spans come in
    overlapping parts. cover False is enough for pairs: a span that recurs in one document is then placed once.

    All pairs of documents are formed that a span joins, as the result has them; for cover alone see shared_spans."""
    few, keyed = _meetings(docs, id_col, text_col, length, gram, hot, block_rows)
    first = keyed.groupBy("k1", "k2", "doc").agg(F.min("start").alias("start"))
    met = _met(first)
    first = first.join(met, ["k1", "k2"])

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = (x.select("k1", "k2", F.col("doc").alias(f"doc_{s}"), F.col("start").alias(f"start_{s}")) for x, s in ((a, "a"), (b, "b")))
        return left.join(right, ["k1", "k2"]).filter("doc_a < doc_b").select("doc_a", "doc_b", "start_a", "start_b", F.lit(length).cast("int").alias("size"))

    if not cover:
        return few.union(meet(first, first))
    every = keyed.join(met, ["k1", "k2"]).distinct()
    return few.union(meet(every, first).union(meet(first, every)).distinct())


def sharing_pairs(factors: DataFrame) -> DataFrame:
    return factors.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b")).distinct()


def spans_of(factors: DataFrame) -> DataFrame:
    """(doc, s, e): both sides of factors."""
    a = factors.select(F.col("doc_a").alias("doc"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("size")).alias("e"))
    return a.union(factors.select(F.col("doc_b").alias("doc"), F.col("start_b").alias("s"), (F.col("start_b") + F.col("size")).alias("e")))


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 240, gram: int | None = None, hot: int = 64, block_rows: int = 20_000) -> DataFrame:
    """(doc, s, e) stretches that together cover what each document shares with others. A window of a recurring span counts for
    each document that has it once two have it, so a footer in n documents costs n rows, not n * n."""
    few, keyed = _meetings(docs, id_col, text_col, length, gram, hot, block_rows)
    keyed = durable(keyed, "windows")
    recurring = keyed.join(_met(keyed), ["k1", "k2"]).select("doc", F.col("start").alias("s"), (F.col("start") + length).alias("e"))
    return spans_of(few).union(recurring)


def shared_parts(docs: DataFrame, stretches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, shared_chars, share) of every document: how much of it lies in the stretches (doc, s, e)."""
    spans = stretches.groupBy("doc", "s").agg(F.max("e").alias("e")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"), F.greatest(acc["to"], x["e"]).alias("to")),
        lambda acc: acc["n"],
    )
    d = docs.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("n_chars")).distinct()
    out = d.join(spans.select(F.col("doc"), covered.alias("n")), F.col(id_col) == F.col("doc"), "left")
    shared = F.coalesce("n", F.lit(0))
    return out.select(id_col, "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, shared / F.col("n_chars")).otherwise(0.0).alias("share"))
