"""Freely entered values -> entries of a reference list of named places.

A value is brought to its canonical form and folded (letter case, long vowels, doubled letters, common spelling
variants, in Latin and Devanagari). An Aho-Corasick automaton over the folded names and aliases finds embedded mentions;
the longest non-overlapping one that names one place, kind included, wins. What remains goes to token-set similarity:
the words around the place are set aside, the rest is read as name + kind in either order, joined or apart, and the
token set is compared with the entries' by weighted edit distance. Only entries whose consonants are within the edits that
the distance allows are compared, found in an index of deletions; that bound is exact, so every entry within the limit and
every rival is seen. Each distinct value is matched once. The reference list travels with the tasks.

Names are `proper part + kind` (a mill is not a bridge): an entry of the same name and another kind is another place,
and a value without a kind counts only if one entry bears the name. The kinds and their spellings are read from the list.

Defined results: null and blank values give null; a value that names no entry, or several equally well, gives
`unmatched`. Repeated rows give repeated results; columns named like a result are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from itertools import combinations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.llm.canonical import TO_LATIN, base_form
from sangam.session import broadcast_if_small, durable

UNMATCHED = "unmatched"
MAX_ENTRIES = 100_000
# Words around a place that are no part of its name.
AROUND = set("""
at near in around behind opp opposite the side area ward office main road wale wala wali pe par me mein ke paas pas ki taraf of by to from close next lane
ilaka ilaake location jagah saamne samne peeche piche
में मे पर पे के की का पास इलाका इलाके सामने पीछे ओर तरफ वाली वाले वाला गली रोड सड़क निकट
""".split())
_LATIN_FOLD = [("chh", "ch"), ("aa", "a"), ("ee", "i"), ("oo", "u"), ("w", "v"), ("z", "j"), ("q", "k"), ("ii", "i"), ("uu", "u")]
_DEVA_FOLD = str.maketrans({"ी": "ि", "ू": "ु", "ई": "इ", "ऊ": "उ", "ँ": "ं", "ॉ": "ो", "ौ": "ो", "ै": "े", "़": None, "ः": None, "ॅ": "े", "औ": "ओ", "ऐ": "ए"})


def is_devanagari(s: str) -> bool:
    return any("ऀ" <= c <= "ॿ" for c in s)


def fold(word: str, doubles: bool = False) -> str:
    """Folded spelling of one word; doubled letters stay if `doubles`."""
    if is_devanagari(word):
        w = unicodedata.normalize("NFD", word).translate(_DEVA_FOLD)
        w = re.sub("(ङ्|ञ्|ण्|न्|म्)(?=[क-ह])", "ं", w)
        return re.sub(r"(.)्\1", r"\1", w)
    w = unicodedata.normalize("NFD", word.lower())
    w = "".join(c for c in w if c.isalnum())
    for a, b in _LATIN_FOLD[: -2 * doubles or None]:
        w = w.replace(a, b)
    return w if doubles else re.sub(r"(.)\1+", r"\1", w)


def clean(value: str) -> str:
    """Canonical form of a value; look-alike letters become Latin wherever a word has a Latin letter or nothing else."""
    t = base_form(value).replace("_", " ")
    return "".join(TO_LATIN.get(c, c) for c in t)


def words_of(value: str) -> list[str]:
    return [w for w in re.split(r"[^\w.ऀ-ॣ़-्]+", clean(value).lower()) if w.strip(".")]


_NEAR = {frozenset(p): c for p, c in [("dr", 0.5), ("au", 0.5), ("ao", 0.75), ("ie", 0.5), ("uo", 0.5), ("cs", 0.75), ("gj", 0.75), ("bv", 0.75), ("iy", 0.25), ("ck", 0.25), ("शस", 0.4), ("षस", 0.4), ("शष", 0.2), ("डर", 0.5), ("णन", 0.3), ("िे", 0.6), ("ुो", 0.6), ("बव", 0.6)]}
_SOFT = {"h": 0.4, "a": 0.6, "्": 0.5, "ं": 0.6, "ा": 0.6, "ि": 0.7, "ु": 0.7}


def distance(a: str, b: str, limit: float) -> float:
    """Weighted edit distance with transpositions; values above `limit` are only known to be above it."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) * 0.4 > limit:
        return limit + 1
    before: list[float] = []
    row = [0.0]
    for c in b:
        row.append(row[-1] + _SOFT.get(c, 1.0))
    for i, x in enumerate(a):
        new = [row[0] + _SOFT.get(x, 1.0)]
        for j, y in enumerate(b):
            if x == y:
                d = row[j]
            else:
                d = min(row[j] + _NEAR.get(frozenset((x, y)), 1.0), row[j + 1] + _SOFT.get(x, 1.0), new[j] + _SOFT.get(y, 1.0))
                if i and j and x == b[j - 1] and a[i - 1] == y:
                    d = min(d, before[j - 1] + 0.9)
            new.append(d)
        if min(new) > limit:
            return limit + 1
        before, row = row, new
    return row[-1]


def _letter_classes() -> dict[str, str]:
    """Letter -> the letter that stands for all those it can become at less than a whole edit; "" for letters (and those they
    can become) that can be lost at less than a whole edit."""
    group: dict[str, set[str]] = {}
    for p in _NEAR:
        whole = set().union(*(group.get(c, {c}) for c in p))
        group.update(dict.fromkeys(whole, whole))
    out = {c: min(g) for c, g in group.items()}
    for c in _SOFT:
        out.update(dict.fromkeys(group.get(c, {c}), ""))
    return out


_CLASS = _letter_classes()
_CHEAPEST = 0.9  # a change of the skeleton costs at least this much (two letters swapped)


def skeleton(s: str) -> str:
    """The letters whose loss or change costs a whole edit, one for each class."""
    return "".join(_CLASS.get(c, c) for c in s)


def deletions(s: str, most: int) -> set[str]:
    """`s` without any up to `most` of its letters. Strings within `most` edits (swaps included) have one in common."""
    return {"".join(c for i, c in enumerate(s) if i not in gone) for k in range(min(most, len(s)) + 1) for gone in combinations(range(len(s)), k)}


class Gazetteer:
    """The reference list, ready for matching. Entries: (id, names in any script, aliases)."""

    def __init__(self, entries: list[tuple[str, list[str], list[str]]]):
        self.exact = {s for _, names, aliases in entries for s in [*names, *aliases]}
        self.kind_words: dict[str, str] = {}
        self.bases: dict[str, set[tuple[str, str]]] = {}  # folded proper part -> (id, kind)
        self.by_kind: dict[tuple[str, str], set[str]] = {}
        full: dict[str, set[str]] = {}
        kind_of = {}
        for pid, names, _ in entries:
            kind_of[pid] = fold(words_of(names[0])[-1]) if words_of(names[0]) else ""
        for pid, names, aliases in entries:
            kind = kind_of[pid]
            proper: set[str] = set()
            for n in names:
                w = words_of(n)
                if len(w) > 1:
                    proper.add(" ".join(map(fold, w[:-1])))
                    self.kind_words[fold(w[-1])] = kind
                elif w:
                    proper.add(fold(w[0]))
            for n in [*names, *aliases]:
                w = [x for x in words_of(n) if x not in AROUND]
                f = [fold(x) for x in w]
                if len(f) > 1 and " ".join(f[:-1]) in proper:
                    self.kind_words.setdefault(f[-1], kind)
                if len(f) > 1:
                    full.setdefault(" ".join(f), set()).add(pid)
            for b in proper:
                self.bases.setdefault(b, set()).add((pid, kind))
        for b, own in self.bases.items():
            for pid, kind in own:
                self.by_kind.setdefault((b, kind), set()).add(pid)
                for w, k in self.kind_words.items():
                    if k == kind and is_devanagari(w) == is_devanagari(b):
                        full.setdefault(f"{b} {w}", set()).add(pid)
                        full.setdefault(f"{w} {b}", set()).add(pid)
        self.automaton = ahocorasick.Automaton()
        for form, ids in full.items():
            self.automaton.add_word(f" {form} ", (len(form), frozenset(ids)))
        if full:
            self.automaton.make_automaton()
        self.has_forms = bool(full)
        self.names = list(self.bases)
        self.sizes = (min(map(len, self.names)), max(map(len, self.names))) if self.names else None
        self.index: dict[str, list[int]] = {}
        for i, b in enumerate(self.names):
            for key in deletions(skeleton(b), self.EDITS):
                self.index.setdefault(key, []).append(i)

    #: edits of the skeleton that the largest limit of match() leaves room for
    EDITS = 2

    def near(self, text: str, limit: float) -> list[tuple[float, str]]:
        """(distance, proper part) of all proper parts within `limit`, nearest first."""
        if text in self.bases:
            return [(0.0, text)]
        if not self.sizes or not self.sizes[0] <= len(text) + limit / 0.4 or not len(text) - limit / 0.4 <= self.sizes[1]:
            return []  # a letter more or less costs 0.4 at least, so no name is near in length
        edits = int(limit / _CHEAPEST)
        if edits > self.EDITS:
            raise ValueError(f"the index holds for limits under {(self.EDITS + 1) * _CHEAPEST}")
        at = {i for key in deletions(skeleton(text), edits) for i in self.index.get(key, ())}
        out = [(distance(text, self.names[i], limit), self.names[i]) for i in at]
        return sorted(x for x in out if x[0] <= limit)

    def kind(self, word: str) -> tuple[float, str] | None:
        """(distance, kind) of a word that spells a kind."""
        if word in self.kind_words:
            return 0.0, self.kind_words[word]
        if len(word) < 4:
            return None
        best = min(((distance(word, k, 1.0), v) for k, v in self.kind_words.items() if len(k) > 3 and is_devanagari(k) == is_devanagari(word)), default=(9.0, ""))
        return best if best[0] <= 1.0 else None

    def mentions(self, folded: list[str]) -> set[str] | None:
        """Places of the longest of the non-overlapping mentions (of all of them if several are equally long), None if there is none."""
        text = f" {' '.join(folded)} "
        hits = sorted(((n, end, ids) for end, (n, ids) in self.automaton.iter(text)), key=lambda x: (-x[0], x[1])) if self.has_forms else []
        taken: list[tuple[int, int]] = []
        places: set[str] = set()
        for n, end, ids in hits:
            if n < hits[0][0]:
                break
            # a form is found with the blanks around it, which neighbours share
            if all(end - n <= a or end >= b + n for a, b in taken):
                taken.append((end - n, end))
                places |= ids
        return places or None

    def readings(self, folded: list[str]) -> list[tuple[float, str, str | None]]:
        """(penalty, proper part, kind) ways to read the words that are left."""
        out: list[tuple[float, str, str | None]] = []
        n = len(folded)
        for i in range(n):
            if (k := self.kind(folded[i])) and n > 1:
                rest = folded[:i] + folded[i + 1 :]
                out.append((k[0], " ".join(rest), k[1]))
                if n > 2:
                    out += [(k[0] + 0.3, r, k[1]) for r in (folded[i - 1] if i else "", folded[i + 1] if i + 1 < n else "") if r]
        joined = "".join(folded)
        for w, k in self.kind_words.items():
            if len(joined) - len(w) >= 4:
                if joined.endswith(w):
                    out.append((0.1 + 0.02 / len(w), joined[: -len(w)], k))
                if joined.startswith(w):
                    out.append((0.1 + 0.02 / len(w), joined[len(w) :], k))
        out.append((0.0, " ".join(folded), None))
        if n > 1:
            out.append((0.1, joined, None))
        return out

    def match(self, value: str) -> str:
        words = words_of(value)
        folded_all = [fold(w) for w in words]
        folded = [fold(w) for w in words if w.strip(".") not in AROUND]
        folded = [f for f in folded if f]
        if not folded:
            return UNMATCHED
        for f in (folded, folded_all):
            ids = self.mentions(f)
            if ids is not None and len(ids) == 1:
                return ids.pop()
        found: list[tuple[float, int, str, str | None]] = []
        spelled = [fold(w, True) for w in words if w.strip(".") not in AROUND]
        readings = self.readings(folded)
        if spelled != folded:  # a letter lost between two equal ones leaves a double that folding would hide
            readings += [(p + 0.05, x, k) for p, x, k in self.readings([w for w in spelled if w])]
        for penalty, proper, kind in readings:
            limit = min(1.2, 0.3 * len(proper)) if is_devanagari(proper) else 0.6 if len(proper) < 5 else 1.65 if len(proper) < 7 else 2.05
            for d, name in self.near(proper, limit):
                found.append((d + penalty, kind is None, name, kind))
        if not found:
            return UNMATCHED
        # a reading with a kind is preferred to one that has to leave the kind's letters over
        best = min(found, key=lambda x: (x[0] + 0.25 * x[1], x[1]))
        with_kind = [x for x in found if x[3] is not None]
        if best[3] is None and with_kind and min(x[0] for x in with_kind) <= best[0] + 0.6:
            best = min(with_kind)
        score, _, name, kind = best
        rivals = {x[2] for x in found if x[2] != name and x[3] == kind and x[0] < score + 0.5}
        own = set(self.by_kind.get((name, kind), ())) if kind else {pid for pid, _ in self.bases[name]}
        if kind is not None and not own:
            return UNMATCHED
        for r in rivals:
            own = own | (self.by_kind.get((r, kind), set()) if kind else {pid for pid, _ in self.bases[r]})
        return min(own) if len(own) == 1 else UNMATCHED


def decode(value: str | None) -> str | None:
    """JSON string, else the text as it stands; JSON null gives null."""
    if value is None:
        return None
    try:
        d = json.loads(value)
    except ValueError:
        return value
    return d if isinstance(d, str) or d is None else value


def load_entries(gazetteer: DataFrame, id_col: str, name_cols: list[str], alias_col: str) -> list[tuple[str, list[str], list[str]]]:
    """The list on the driver; an error beyond MAX_ENTRIES. Entries without an id or any name are left out."""
    rows = gazetteer.select(id_col, *name_cols, alias_col).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    out = [(r[0], [n for n in r[1:-1] if n and n.strip()], [a for a in (r[-1] or []) if a and a.strip()]) for r in sorted(rows, key=lambda r: str(r[0]))]
    return [e for e in out if e[0] is not None and e[1]]


def map_values(df: DataFrame, value: Column, gazetteer: DataFrame, id_col: str, name_cols: list[str], alias_col: str, out_col: str = "entry", exact_col: str = "is_exact", max_broadcast_rows: int = 200_000) -> DataFrame:
    """`df` plus out_col (an entry's id, `unmatched`, or null) and exact_col (the decoded value equals a stored name)."""
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, load_entries(gazetteer, id_col, name_cols, alias_col)))

    @F.pandas_udf("struct<entry:string,is_exact:boolean>")
    def entry(values: pd.Series) -> pd.DataFrame:
        g = _gazetteer(shared)
        ids, exact = [], []
        for v in map(decode, values):
            blank = v is None or not base_form(v).strip()
            ids.append(None if blank else g.match(v))
            exact.append(not blank and v in g.exact)
        return pd.DataFrame({"entry": ids, "is_exact": exact})

    # each distinct value once; the values are spread evenly, however often they occur
    d = df.withColumn("_v", value)
    spread = df.sparkSession.sparkContext.defaultParallelism
    distinct = d.select("_v").filter("_v is not null").distinct().repartition(4 * spread, "_v")
    found = durable(distinct.select(F.col("_v").alias("_value"), entry("_v").alias("_e")), "values")
    d = d.join(broadcast_if_small(found, max_broadcast_rows), F.col("_v") == F.col("_value"), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out_col, exact_col)]
    return d.select(*kept, F.col("_e.entry").alias(out_col), F.coalesce("_e.is_exact", F.lit(False)).alias(exact_col))


_LOADED: dict[str, Gazetteer] = {}


def _gazetteer(shared) -> Gazetteer:
    """One automaton per worker and list (its name is its key)."""
    name, entries = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Gazetteer(entries)
    return _LOADED[name]
