"""Whole-corpus encoding with a public byte-level BPE as a streaming transducer, and its inverse.

For every prefix of a piece the encoding's last token is unique: it is the token ending there that may stand after the
last token of the prefix before it. Two tokens may be neighbours if undoing their merges, latest first, never shows a
merge across their border that would have come earlier. The encoder keeps the last token of each byte position.
Whatever follows, the final encoding passes through one of the last `lookahead` positions, where `lookahead` is the
length of the merge list's longest token: no token reaches further. Tokens that all those positions have as common
ancestors are stable; they are emitted and forgotten, so the state is the unstable tail.

A text is cut into pieces by the tokenizer's published pattern. A piece's ids don't depend on its neighbours, so pieces
are remembered per worker in a bounded table. Strings that look like special tokens are ordinary text.

Defined results: null and empty texts give []; repeated rows give repeated results; a lone surrogate can't occur in a
Spark string. Texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Where the public vocabulary files lie; a parameter of every function that reads them.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
# Fixed value: the tokenizer's published piece pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FINE = regex.compile(PATTERN)
#: Coarse pieces: one blank and what follows up to the next white space, or a run of white space. PATTERN never joins two of them.
_COARSE = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Pieces longer than this many bytes aren't remembered but streamed.
LONG_PIECE = 256
REMEMBERED = 300_000


class Merges:
    """A merge list read as ranks: ids of byte strings, the two tokens each was merged from, and the neighbour test."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.lookahead = max(map(len, self.ids))
        self._made_from: dict[int, tuple[int, int] | None] = {}
        self._neighbours: dict[tuple[int, int], bool] = {}

    def made_from(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the token's last merge, None for a single byte."""
        if token in self._made_from:
            return self._made_from[token]
        b = self.bytes[token]
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: self.ids.get(parts[i] + parts[i + 1], 1 << 60))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self._made_from[token] = out = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return out

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens, encoded, give these two tokens."""
        known = self._neighbours.get((left, right))
        if known is not None:
            return known
        a, b, bound, ok = left, right, 1 << 60, None
        while ok is None:
            across = self.ids.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < bound and self.made_from(across) == (a, b):
                ok = False
                break
            # undo the merge that came last on either side; at equal rank the left one was taken first
            undo_left, undo_right = self.made_from(a), self.made_from(b)
            if undo_left is None and undo_right is None:
                ok = True
            elif undo_right is None or (undo_left is not None and a > b):
                bound, a = a, undo_left[1]
            else:
                bound, b = b + 1, undo_right[0]
        if len(self._neighbours) > 1_000_000:
            self._neighbours.clear()
        self._neighbours[left, right] = ok
        return ok


class Transducer:
    """Bytes of one piece in, stable token ids out; push() any number of times, then finish()."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.reset()

    def reset(self) -> None:
        self.tail = bytearray()
        self.last = [-1]  # last[i]: the last token of the encoding of tail[:i]; position 0 is the end of what was emitted
        self.before = -1  # the last emitted token
        self.most_kept = 0

    def push(self, data: bytes) -> list[int]:
        ids, size_of, ahead = self.m.ids, self.m.bytes, self.m.lookahead
        out: list[int] = []
        for byte in data:
            self.tail.append(byte)
            n = len(self.tail)
            for size in range(min(n, ahead), 0, -1):
                token = ids.get(bytes(self.tail[n - size : n]))
                if token is None:
                    continue
                prev = self.last[n - size] if n > size else self.before
                if prev < 0 or self.m.neighbours(prev, token):
                    self.last.append(token)
                    break
            self.most_kept = max(self.most_kept, n)
            if n >= 2 * ahead:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        """Emit what all live positions (the last `lookahead` ones) have in common."""
        n = len(self.tail)
        live = set(range(n - self.m.lookahead + 1, n + 1))
        while len(live) > 1 and max(live) > 0:
            p = max(live)
            live.remove(p)
            live.add(p - len(self.m.bytes[self.last[p]]))
        return self._emit(live.pop())

    def _emit(self, end: int) -> list[int]:
        out, p = [], end
        while p > 0:
            out.append(self.last[p])
            p -= len(self.m.bytes[self.last[p]])
        out.reverse()
        if end:
            self.before = out[-1]
            del self.tail[:end]
            self.last = [-1, *self.last[end + 1 :]]
        return out

    def finish(self) -> list[int]:
        out = self._emit(len(self.tail))
        self.reset()
        return out


class Encoder:
    """Texts to ids."""

    def __init__(self, path: str):
        self.m = Merges(path)
        self.t = Transducer(self.m)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fine: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        got = self.fine.get(piece)
        if got is None:
            data = piece.encode()
            one = self.m.ids.get(data)
            got = (one,) if one is not None else tuple(self.t.push(data) + self.t.finish())
            if len(data) <= LONG_PIECE:
                if len(self.fine) >= REMEMBERED:
                    self.fine.clear()
                self.fine[piece] = got
        return got

    def _coarse(self, chunk: str) -> tuple[int, ...]:
        got = tuple(i for piece in _FINE.findall(chunk) for i in self._piece(piece))
        if len(chunk) <= LONG_PIECE:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = got
        return got

    def encode(self, text: str | None, out: array | None = None) -> array:
        out = array("i") if out is None else out
        if text:
            known, miss = self.known.get, self._coarse
            for chunk in _COARSE.findall(text):
                ids = known(chunk)
                out.extend(miss(chunk) if ids is None else ids)
        return out


class StreamDecoder:
    """Ids in, text out as soon as its bytes form whole characters; incomplete bytes wait, impossible ones become U+FFFD."""

    def __init__(self, merges: Merges):
        import codecs

        self.bytes, self.state = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.bytes[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def encode_column(df: DataFrame, id_col: str, text_col: str, tokenizer_dir: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id, ids array<int>), one row per row of df."""
    path = f"{tokenizer_dir}/{vocabulary}"
    d = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([d.schema["id"], StructField("ids", ArrayType(IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            flat, ends = array("i"), [0]
            for t in b.column("text").to_pylist():
                e.encode(t, flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("id"), ids], names=["id", "ids"])

    return d.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, text_col: str, out_col: str = "n_tokens", tokenizer_dir: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """`df` plus the number of tokens of each text (0 for null and empty)."""
    path = f"{tokenizer_dir}/{vocabulary}"
    rest = [c for c in df.columns if c != text_col]
    schema = StructType([*[df.schema[c] for c in rest], StructField(out_col, LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = pa.array([len(e.encode(t)) for t in b.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], n], names=[*rest, out_col])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def decode_column(df: DataFrame, id_col: str, ids_col: str, out_col: str = "text", tokenizer_dir: str = TOKENIZERS, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """(id, text): the texts of id lists; null ids give null."""
    path = f"{tokenizer_dir}/{vocabulary}"

    @F.pandas_udf("string")
    def text_of(ids):
        import pandas as pd

        m = encoder(path).m

        def one(x):
            if x is None:
                return None
            s = StreamDecoder(m)
            return s.push(map(int, x)) + s.finish()

        return pd.Series([one(x) for x in ids])

    return df.select(F.col(id_col), text_of(F.col(ids_col)).alias(out_col))
