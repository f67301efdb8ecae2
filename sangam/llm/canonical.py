"""Visually identical text -> one form.

Width variants, ligatures, kinds of blank, composed and decomposed accents and invisible characters are settled per
text. Look-alike letters are settled by script: a token that mixes scripts (or consists only of look-alikes of a script
the rest of the text doesn't use) is rewritten into its dominant script, else into the other one, but only where the
result is a word of the corpus: a token that stands unmixed in some text, or one that different corrupted tokens of
at least two records lead to.

Letter case, punctuation, line breaks and the number of blanks are kept. Defined results: null stays null, empty stays
empty; texts without letters are unchanged apart from blanks and widths; a token whose repair isn't in the vocabulary
stays as it is. Repeated rows of one id count once for support; other columns are kept.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangam.session import broadcast_if_small, durable

# Cyrillic and Greek letters that look like Latin ones.
CYRILLIC = {"А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
            "Ү": "Y", "Ԍ": "G", "а": "a", "е": "e", "о": "o", "с": "c", "р": "p", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q",
            "ԝ": "w", "ү": "y", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b"}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
         "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "υ": "u", "α": "a", "ϲ": "c", "ϳ": "j", "κ": "k", "τ": "t", "γ": "y", "χ": "x", "η": "n"}
LATIN_OTHER = {"ı": "i", "ɑ": "a", "ɡ": "g", "ʀ": "r", "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m"}
# Characters that take no room, and hyphens that look alike.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF, *range(0xFE00, 0xFE10)]
HYPHENS = [0x2010, 0x2011]

# Devanagari sequences that look like one letter or sign.
SEQUENCES = {"अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ"}

TO_LATIN = CYRILLIC | GREEK | LATIN_OTHER
TO_CYRILLIC = {v: k for k, v in reversed(list(CYRILLIC.items()))}
TO_GREEK = {v: k for k, v in reversed(list(GREEK.items()))}


def _table() -> dict[int, str | None]:
    """One translation for widths, ligatures, blanks and invisible characters, by rule from the Unicode database."""
    t: dict[int, str | None] = dict.fromkeys(INVISIBLE)
    t |= {h: "-" for h in HYPHENS}
    for cp in [*range(0x00A0, 0x3001), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF)]:
        ch = chr(cp)
        if unicodedata.category(ch) == "Zs":
            t[cp] = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp < 0xFB07:
            t[cp] = unicodedata.normalize("NFKC", ch)
    return t


_PLAIN = {chr(c): x or "" for c, x in _table().items()}
_PLAINABLE = re.compile("[" + "".join(map(re.escape, _PLAIN)) + "]")
_SEQUENCE = re.compile("|".join(SEQUENCES))
TOKEN = re.compile(r"\w[\ẁ-ͯऺ-ॏ]*")
_FOREIGN = re.compile("[Ͱ-ϿЀ-ԯᲀ-᲏" + "".join(LATIN_OTHER) + "]")


def base_form(text: str) -> str:
    """Everything but look-alike letters."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFC", _PLAINABLE.sub(lambda m: _PLAIN[m.group()], text))
    return _SEQUENCE.sub(lambda m: SEQUENCES[m.group()], t) if _SEQUENCE.search(t) else t


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or ch in LATIN_OTHER:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90:
        return "cyrillic"
    return "other"


_INTO = {"latin": TO_LATIN, "cyrillic": TO_CYRILLIC, "greek": TO_GREEK}


def repairs(token: str, text_script: str) -> list[str]:
    """The token in its dominant script, then in the others it can be written in; [] if it needs none.

    Letters that look alike in two scripts can't tell a token's script, so text_script, that of the text's unmistakable
    tokens, comes first, then the script of most of the token's letters."""
    letters = [c for c in token if c.isalpha()]
    counts: dict[str, int] = {}
    for c in letters:
        counts[_script(c)] = counts.get(_script(c), 0) + 1
    odd = any(c in LATIN_OTHER for c in letters)
    if len(counts) < 2 and not odd and (not counts or text_script in counts or text_script == "other"):
        return []
    order = sorted({*counts, text_script} - {"other"}, key=lambda s: (s != text_script, -counts.get(s, 0), s))
    out = []
    for script in order:
        into = _INTO[script]
        new = "".join(c if not c.isalpha() or (_script(c) == script and c not in LATIN_OTHER) else into.get(c, "\0") for c in token)
        if "\0" not in new and new != token:
            out.append(new)
    return out


def suspicious(text: str) -> list[tuple[str, list[str]]]:
    """(token, possible repairs) of each distinct token that mixes scripts."""
    if not _FOREIGN.search(text):
        return []
    own: dict[str, int] = {}
    tokens = dict.fromkeys(TOKEN.findall(text))
    for t in tokens:
        kinds = {_script(c) for c in t if c.isalpha()}
        if len(kinds) == 1 and not all(c in TO_LATIN for c in t if c.isalpha()):
            k = kinds.pop()
            own[k] = own.get(k, 0) + 1
    main = max(own, key=own.get) if own else "latin"
    out = []
    for t in tokens:
        if _FOREIGN.search(t) and (r := repairs(t, main)):
            out.append((t, r))
    return out


def apply_repairs(text: str, known: set[str]) -> str:
    """Rewrite each suspicious token by its first repair that is a known word (in lower case)."""
    found = {t: next((r for r in rs if r.lower() in known), None) for t, rs in suspicious(text)}
    found = {t: r for t, r in found.items() if r}
    return TOKEN.sub(lambda m: found.get(m.group(), m.group()), text) if found else text


def canonicalise(df: DataFrame, id_col: str, text_col: str, out_col: str = "canonical", max_known: int = 200_000) -> DataFrame:
    """`df` plus out_col. The accepted repairs are found first; up to max_known of them travel with the tasks and the texts
    take one map without moving, beyond that only texts with suspicious tokens are joined with theirs."""

    @F.pandas_udf("array<string>")
    def doubtful(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else sorted({r.lower() for _, rs in suspicious(base_form(t)) for r in rs}) or None for t in texts])

    foreign = F.col(text_col).rlike(_FOREIGN.pattern)
    wanted = df.filter(foreign).select(F.col(id_col).alias("_id"), doubtful(F.col(text_col)).alias("w")).select("_id", F.explode("w").alias("word"))
    wanted = durable(wanted.distinct(), "doubtful")
    support = wanted.groupBy("word").agg(F.count("*").alias("n"))
    candidates = broadcast_if_small(support.select("word"), max_known)
    tokens = df.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{M}\p{N}_]+")).alias("word"))
    accepted = tokens.join(candidates, "word").select("word").union(support.filter("n >= 2").select("word")).distinct()
    few = accepted.limit(max_known + 1).collect()
    if len(few) <= max_known:
        shared = df.sparkSession.sparkContext.broadcast({r["word"] for r in few})

        @F.pandas_udf("string")
        def canonical(texts: pd.Series) -> pd.Series:
            known = shared.value
            return pd.Series([None if t is None else apply_repairs(base_form(t), known) for t in texts])

        return df.withColumn(out_col, canonical(F.col(text_col)))

    @F.pandas_udf("string")
    def repaired(texts: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else base_form(t) if k is None else apply_repairs(base_form(t), set(k)) for t, k in zip(texts, known)])

    own = wanted.join(accepted, "word").groupBy("_id").agg(F.collect_set("word").alias("_known"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    clean = df.filter(~F.coalesce(foreign, F.lit(False))).select(*kept, repaired(F.col(text_col), F.lit(None).cast("array<string>")).alias(out_col))
    mixed = df.filter(foreign).join(own, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")), "left")
    return clean.union(mixed.select(*kept, repaired(F.col(text_col), F.col("_known")).alias(out_col)))
