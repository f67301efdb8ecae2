"""Text vectors and text ratios that need Python: an offline embedder and the normalised indel ratio."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType

DIMENSIONS = 64


def embed_text(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    """Signed hashed character trigrams, unit length; blank texts give the zero vector. Stands in for a sentence model."""
    import numpy as np
    import xxhash

    v = np.zeros(dimensions)
    t = f" {(text or '').strip().lower()} "
    if t.strip():
        for i in range(len(t) - 2):
            h = xxhash.xxh64_intdigest(t[i : i + 3])
            v[h % dimensions] += 1 if h >> 63 else -1
        n = float(np.linalg.norm(v))
        v = v / n if n else v
    return v.astype("float32").tolist()


@F.pandas_udf(ArrayType(FloatType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(embed_text)


@F.pandas_udf(BinaryType())
def _binned(hashes: pd.Series) -> pd.Series:
    import numpy as np

    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
    h = np.concatenate(hashes.to_list()).astype(np.int64) if sizes.sum() else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    x = np.bincount(row * DIMENSIONS + h % DIMENSIONS, 1 - 2 * (h // DIMENSIONS % 2), minlength=len(sizes) * DIMENSIONS)
    x = np.clip(x, -127, 127).astype(np.int8).reshape(len(sizes), DIMENSIONS)
    return pd.Series([r.tobytes() for r in x], index=hashes.index)


def word_vectors(text: Column) -> Column:
    """Signed hashed counts of a text's distinct words of four characters or more: 64 bytes, each a signed number. Words are hashed
    in the JVM, only numbers reach Python, whole batches at a time. Stands in for a sentence model; a text without such words
    has the zero vector, which is like nothing."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]{4,})"), F.lit(1)))
    return _binned(F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int")))


def indel_ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        if x is None or y is None:
            return None
        return max(indel_ratio(x, y), indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))))

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """The larger of the ratio of two phrases and that of their words in order."""
    return _ratio(a, b)


def ratios(df: DataFrame, text: str, names: list[tuple[str, str]], least: float) -> DataFrame:
    """(text, location_id, score) of all texts and (location_id, name) whose ratio() is at least `least`. A pair is passed over
    only where its lengths or its letters in common, which no common subsequence can exceed, rule the ratio out."""
    from collections import Counter

    import numpy as np

    shared = df.sparkSession.sparkContext.broadcast(names)

    def work(batches):
        names = shared.value
        place = {c: k for k, c in enumerate(sorted({c for _, n in names for c in n}))}
        letters = np.zeros((len(names), len(place)), np.int16)
        for i, (_, n) in enumerate(names):
            for c, k in Counter(n).items():
                letters[i, place[c]] = k
        size = np.array([len(n) for _, n in names])
        ordered = [" ".join(sorted(n.split())) for _, n in names]
        for batch in batches:
            out = []
            for x in batch[text]:
                counts = Counter(c for c in x if c in place)
                at = [place[c] for c in counts]
                common = np.minimum(letters[:, at], np.array(list(counts.values()), np.int16)).sum(1)
                y = " ".join(sorted(x.split()))
                for i in np.flatnonzero(2 * common >= (least - 1e-9) * (size + len(x))):
                    s = max(indel_ratio(x, names[i][1]), indel_ratio(y, ordered[i]))
                    if s >= least:
                        out.append((x, names[i][0], s))
            yield pd.DataFrame(out, columns=[text, "location_id", "score"])

    return df.select(text).mapInPandas(work, f"{text} string, location_id string, score double")
