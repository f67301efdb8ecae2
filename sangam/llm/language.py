"""Language of texts and of their sentences, with confidences.

Sentences are scored by a multinomial logistic regression on hashed TF-IDF character n-grams, trained by follow-the-
regularised-leader with elastic-net penalties on a bounded sample of labelled texts, then cleaned once (sentences whose
label the first model contradicts are left out, since labels are wrong for many texts) and calibrated by a temperature
on held-out sentences. Document frequencies are counted over all texts.

A sentence's language is that of its frame: words in another script than its first word (a place phrase) are left out; a
sentence that ends in a danda is Devanagari.
Names and places occur in all languages alike, so the weights learned for them stay near zero. Ticket and forwarding
marks are removed. A sentence with fewer than `min_words` words or a confidence under `min_confidence` doesn't speak for
a language of its own unless it is all there is.

Defined results: null, empty and wordless texts get no segments, no languages and null confidence. Repeated rows give
repeated results. Texts of any length are used whole. Columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from sangam.llm.canonical import TO_LATIN, base_form
from sangam.llm.sample import bounded_sample

LANGUAGES = ("en", "hi", "hi-Latn")
DIM = 1 << 16
ORDERS = (2, 3, 4)
# Abbreviations whose full stop ends no sentence.
ABBREVIATED = {"no", "opp", "moh", "col", "mr", "mrs", "ms", "dr", "st", "rd", "nr", "ph", "apt", "smt", "shri", "h.no", "h", "nos", "tel", "mob", "sec", "ext", "approx"}
# Forwarding and ticket marks; addresses of mail are no words either.
MARKS = re.compile(
    r"\(?\bT[-‐‑–]\d+\)?|#\d+|^\s*(?:(?:fw?d{1,2}|fw|forwarded)\b\s*[:\-–]*\s*)+|\(?forwarded as received\)?|>>+|\b(?:pls|please) share\b[.!]*|\bplease forward\b[.!]*|\baage bhej(?: do|ein)\b[.!]*|आगे भेजें\s*[।.!]*|^\s*-\s*shared from .{1,40}$|[-–]\s*shared from ward group\b",
    re.I | re.M,
)
_MAIL = re.compile(r"[^\s@]+@\S+|\S+\s?[\[(]at[\])]\s?\S+")
#: What every mark holds, to pass by texts without any.
_MARKED = re.compile("T[-‐‑–][0-9]|#[0-9]|>>|[Ff][Ww]|[Ff][Oo][Rr][Ww]|[Ss][Hh][Aa][Rr][Ee]|[Bb][Hh][Ee][Jj]|आगे भेजें|t[-‐‑–][0-9]")
_BREAK = re.compile(r"[.।!?]+(?=\s|$)")
_SOFT_BREAK = re.compile(r"[\r\n]+| {2,}")
_WORDS = re.compile(r"[^\W\d_][^\W\d_ऺ-ॏँ-ः़‍‌]*(?:[ऺ-ॏँ-ः़]+[^\W\d_]*)*")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text whose marks are blanked out."""
    cuts = []
    for m in _BREAK.finditer(text):
        if m.group() == "." and text[: m.start()].rsplit(None, 1)[-1:] and text[: m.start()].rsplit(None, 1)[-1].lower().lstrip("(,") in ABBREVIATED:
            continue
        cuts.append(m.end())
    if not cuts or (len(cuts) == 1 and not text[cuts[0] :].strip()):
        soft = [m.end() for m in _SOFT_BREAK.finditer(text)]
        if soft and len(text.split()) / (len(soft) + 1) >= 3:
            cuts = sorted({*cuts, *soft})
    out, start = [], 0
    for c in [*cuts, len(text)]:
        if text[start:c].strip():
            out.append((start, c))
        start = c
    return out


def _words_of(sentence: str) -> list[str]:
    return _WORDS.findall(sentence)


def _deva(w: str) -> bool:
    return "ऀ" <= w[0] <= "ॿ"


def pieces_of(text: str | None) -> list[tuple[int, int, str, int]]:
    """(start, end, frame text in lower case, number of words) of each sentence with words. Positions are those of `text`."""
    if not text:
        return []
    plain = text
    if "@" in text or "at]" in text or "at)" in text:
        plain = _MAIL.sub(lambda m: " " * len(m.group()), plain)
    if _MARKED.search(plain):
        plain = MARKS.sub(lambda m: " " * len(m.group()), plain)
    out = []
    for a, b in sentences(plain):
        s = base_form(plain[a:b])
        words = _words_of(s)
        if not words:
            continue
        frame = _deva(words[0]) or s.rstrip().endswith("।") and any(map(_deva, words))
        kept = words if s.isascii() else [w for w in words if _deva(w) == frame]
        joined = " ".join(kept).lower()
        if not joined.isascii() and not frame:
            joined = "".join(TO_LATIN.get(c, c) for c in joined)
        out.append((a, b, f" {joined} ", len(kept)))
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts in order, start of each text's stretch). Every text has at least one n-gram."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if texts else np.empty(0, np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    starts = ends - sizes
    per, n = [], len(codes)
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    h = codes.copy()
    for k in range(2, max(ORDERS) + 1):
        h = h[: max(0, n - k + 1)] * np.uint64(0x100000001B3) + codes[k - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        if k in ORDERS:
            at = np.flatnonzero(owner[: len(h)] == owner[k - 1 :]) if len(h) else np.empty(0, int)
            at = at[codes[at + k - 1] != 10]
            per.append((at, ((h[at] + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)))
    where = np.concatenate([a for a, _ in per]) if per else np.empty(0, int)
    feats = np.concatenate([f for _, f in per]) if per else np.empty(0, np.int64)
    own = owner[where]
    order = np.argsort(own, kind="stable")
    first = np.searchsorted(own[order], np.arange(len(texts)))
    return feats[order], first


@dataclass
class Model:
    """logits = sum(idf * weight) / sqrt(sum(idf^2)) / temperature + bias / temperature"""

    table: np.ndarray  # [DIM, classes + 1]: idf * weight, idf^2
    bias: np.ndarray
    temperature: float
    languages: tuple[str, ...] = LANGUAGES

    def probabilities(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(self.languages)))
        f, first = features(texts)
        sums = np.add.reduceat(self.table[f], first, axis=0) if len(f) else np.zeros((len(texts), self.table.shape[1]))
        logits = (sums[:, :-1] / np.sqrt(np.maximum(sums[:, -1:], 1e-9)) + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


class Ftrl:
    """FTRL-proximal for multinomial logistic regression with L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self) -> np.ndarray:
        shrunk = np.sign(self.z) * np.maximum(np.abs(self.z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2)

    def step(self, f: np.ndarray, v: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        w = self.weights()
        logits = np.add.reduceat(w[f] * v[:, None], first, axis=0) + w[DIM]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = p
        d[np.arange(len(y)), y] -= 1
        row = np.repeat(np.arange(len(y)), np.diff(np.append(first, len(f))))
        g = np.empty_like(self.z)
        for c in range(g.shape[1]):
            g[:DIM, c] = np.bincount(f, v * d[row, c], minlength=DIM)
        g[DIM] = d.sum(0)
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        self.z += g - sigma * w
        self.n += g * g


def temperature(p: np.ndarray, labels: np.ndarray) -> float:
    """The temperature under which held-out labels are most likely, when a share of them is wrong at random.

    Sentences that the model contradicts stay in: a label is drawn from the model's (tempered) belief or, with the share e,
    evenly from all languages. e and the temperature are fitted together, so wrong labels don't make a sure model look unsure,
    and right ones don't make it look infallible."""
    best = (np.inf, 1.0)
    logp = np.log(np.maximum(p, 1e-300))
    for t in np.geomspace(0.2, 5, 40) if len(p) else ():
        q = logp / t
        q = np.exp(q - q.max(1, keepdims=True))
        own = (q / q.sum(1, keepdims=True))[np.arange(len(q)), labels]
        for e in np.linspace(0.01, 0.6, 60):
            best = min(best, (-np.log((1 - e) * own + e / p.shape[1]).mean(), t))
    return float(best[1])


def train(texts: list[str], labels: np.ndarray, idf: np.ndarray, groups: np.ndarray | None = None, epochs: int = 3, batch: int = 128, seed: int = 5) -> Model:
    """Two rounds: on the labels given, then without the sentences whose label the first model contradicts; every tenth
    group (text) is held out for the temperature, whatever the model says of its labels."""
    classes = len(LANGUAGES)
    f, first = features(texts)
    ends = np.append(first[1:], len(f))
    norm = np.sqrt(np.maximum(np.add.reduceat(idf[f] ** 2, first), 1e-9)) if len(f) else np.ones(len(texts))
    held = (np.arange(len(texts)) if groups is None else groups) % 10 == 0
    keep = ~held
    model = None
    for _ in range(2):
        learner, rng = Ftrl(classes), np.random.default_rng(seed)
        rows = np.flatnonzero(keep)
        for _ in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), batch):
                r = rows[i : i + batch]
                part = np.concatenate([np.arange(first[k], ends[k]) for k in r])
                size = ends[r] - first[r]
                learner.step(f[part], idf[f[part]] / np.repeat(norm[r], size), np.cumsum(size) - size, labels[r])
        w = learner.weights()
        model = Model(np.column_stack([w[:DIM] * idf[:, None], idf**2]).astype(np.float32), w[DIM], 1.0)
        p = model.probabilities(texts)
        keep = ~held & (p.argmax(1) == labels)
    model.temperature = temperature(p[held], labels[held])
    return model


def inverse_frequencies(df: DataFrame, text_col: str) -> np.ndarray:
    """idf of every hashed n-gram over all texts: DIM counters a task, summed."""
    schema = StructType([StructField("f", LongType()), StructField("n", LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(DIM, np.int64), 0
        seen = np.zeros((32, DIM), np.uint8)
        for b in batches:
            texts = [" ".join(_WORDS.findall(base_form(t).lower())) for t in b["t"] if t]
            texts = [f" {t} " for t in texts if t]
            rows += len(texts)
            for i in range(0, len(texts), 32):
                f, first = features(texts[i : i + 32])
                size = np.diff(np.append(first, len(f)))
                seen[:] = 0
                seen.ravel()[np.repeat(np.arange(len(size)), size) * DIM + f] = 1
                total += seen.sum(0, dtype=np.uint8)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"f": np.append(hit, -1), "n": np.append(total[hit], rows)})

    got = df.select(F.col(text_col).alias("t")).mapInPandas(count, schema).groupBy("f").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIM)
    rows = int(got.loc[got["f"] < 0, "n"].sum())
    got = got[got["f"] >= 0]
    n[got["f"].to_numpy(int)] = got["n"].to_numpy(float)
    return np.log((1 + rows) / (1 + n)) + 1


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int = 6000) -> Model:
    """A model from about sample_rows labelled texts (bounded_sample) and idf over all texts."""
    labelled = df.filter(F.col(label_col).isin(*LANGUAGES) & F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("t"), F.col(label_col).alias("y"))
    sample = bounded_sample(labelled, id_col, sample_rows).toPandas().sort_values([id_col, "t"])
    texts, labels, groups = [], [], []
    for k, (t, y) in enumerate(zip(sample["t"], sample["y"])):
        for _, _, s, n in pieces_of(t):
            if n >= 3:
                texts.append(s)
                labels.append(LANGUAGES.index(y))
                groups.append(k)
    idf = inverse_frequencies(df, text_col)
    if not texts:
        return Model(np.zeros((DIM, len(LANGUAGES) + 1), np.float32), np.zeros(len(LANGUAGES)), 1.0)
    return train(texts, np.array(labels), idf, np.array(groups))


SEGMENTS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("language", StringType()), StructField("confidence", DoubleType())]))
RESULT = StructType([StructField("segments", SEGMENTS), StructField("languages", ArrayType(StringType())), StructField("language", StringType()), StructField("confidence", DoubleType())])


def label_texts(df: DataFrame, text_col: str, model: Model, min_words: int = 2, min_confidence: float = 0.8, with_segments: bool = True) -> DataFrame:
    """`df` plus segments (left empty unless with_segments), languages (sorted, of whole sentences), language (of most words)
    and its confidence."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def label(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        pieces = [pieces_of(t) for t in texts]
        flat = [p for ps in pieces for p in ps]
        prob = np.concatenate([m.probabilities([p[2] for p in flat[i : i + 4000]]) for i in range(0, len(flat), 4000)]) if flat else np.empty((0, len(LANGUAGES)))
        best, conf = prob.argmax(1), prob.max(1) if len(prob) else np.empty(0)
        rows, k = [], 0
        for ps in pieces:
            segs, sure, mass = [], set(), np.zeros(len(LANGUAGES))
            for a, b, _, n in ps:
                if with_segments:
                    segs.append({"start": a, "end": b, "language": LANGUAGES[best[k]], "confidence": float(conf[k])})
                mass += n * prob[k]
                if n >= min_words and conf[k] >= min_confidence:
                    sure.add(LANGUAGES[best[k]])
                k += 1
            main = LANGUAGES[int(mass.argmax())] if ps else None
            rows.append((segs, sorted(sure) or ([main] if main else []), main, float(mass.max() / mass.sum()) if ps else None))
        return pd.DataFrame(rows, columns=RESULT.names)

    d = df.withColumn("_l", label(F.col(text_col)))
    results = ("segments", "languages", "found_language", "found_confidence")
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in results], "_l.segments", "_l.languages", F.col("_l.language").alias("found_language"), F.col("_l.confidence").alias("found_confidence"))
