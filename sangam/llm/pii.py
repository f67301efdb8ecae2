"""Personal information in free text: found by a character BiLSTM with a CRF, replaced by typed placeholders.

Texts are read as characters in one form (look-alikes, widths, digits of any script, case); invisible characters are
skipped. Letters of words that are rare in the corpus are read as three rare marks, so windows of different texts become
equal: each worker decodes equal windows once. Rarity is only how a word is read; it decides nothing, and names of
frequent words are learned as such.

A window is a sentence, or an overlapping part of a long one; scores of overlapping windows are averaged and the whole
sentence is decoded by one Viterbi pass over the CRF, so no seam cuts a mention. The network is trained in numpy on
labelled spans: generated sentences with exact spans and a bounded sample of texts (pii_labels). Its gates are piecewise
linear, which numpy computes far faster than tanh. The decoded path alone says where a mention starts and ends and of
what kind it is; bounds are widened to whole words, and `fits` rejects what can't be of the kind (a phone of four digits).

Defined results: null and empty texts have no mentions; text outside mentions is returned byte for byte; repeated rows
give repeated results; texts are read whole; columns named like a result are replaced.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from sangam.llm.canonical import INVISIBLE, TO_LATIN
from sangam.llm.sample import bounded_sample

KINDS = ("email", "phone", "id_number", "address", "person")
#: O, then begin and inside of each kind
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, STRIDE = 96, 48
_SKIP = set(map(chr, [*INVISIBLE, *range(0x300, 0x370), 0x93C]))  # invisible characters, accents and nuktas written apart


def _plain_char(c: str) -> str:
    if c.isdigit() and (d := unicodedata.digit(c, None)) is not None:
        c = str(d)
    elif "！" <= c <= "～":
        c = chr(ord(c) - 0xFEE0)
    elif unicodedata.category(c) == "Zs":
        c = " "
    elif c in TO_LATIN or c in "‐‑":
        c = TO_LATIN.get(c, "-")
    elif c < "ɐ" or "क़" <= c <= "य़":
        c = unicodedata.normalize("NFD", c)[0]
    low = c.lower()
    return low if len(low) == 1 else c


class _Plain(dict):
    def __missing__(self, key: int) -> str:
        self[key] = value = _plain_char(chr(key))
        return value


_PLAIN = _Plain()


def one_form(text: str) -> str:
    """Same length as `text`: each character in lower case, plain width, without accent or nukta, Latin for look-alikes, ASCII digits, one kind of blank."""
    return text.lower() if text.isascii() else text.translate(_PLAIN)


_UNSEEN = re.compile("[" + "".join(map(re.escape, sorted(_SKIP))) + "]| (?= )")


def visible(t: str) -> tuple[str, list[int] | None]:
    """The text without characters that can't be seen and with single blanks, and where each character stood (None: all stayed)."""
    if not _UNSEEN.search(t):
        return t, None
    kept, at = [], 0
    for m in _UNSEEN.finditer(t):
        kept.extend(range(at, m.start()))
        at = m.end()
    kept.extend(range(at, len(t)))
    return _UNSEEN.sub("", t), kept


# ---- characters as the network sees them

_NAME = r"[^\W\d_][^\W\d_ऀ-ः़-ॏ]*(?:[ऀ-ः़-ॏ]+[^\W\d_]*)*"
_CHARS = "abcdefghijklmnopqrstuvwxyz .,:;!?()[]/+-@#&'\"\n_%" + "".join(map(chr, range(0x900, 0x980)))
_ID = {c: i + 5 for i, c in enumerate(_CHARS)}
OTHER, DIGIT, RARE, RARE_HI, CODE = range(5)
_RARE_WORD, _BLANK = bytes([RARE] * 3), bytes([_ID[" "]])
VOCABULARY = 5 + len(_CHARS)
_TOKEN = re.compile(r"[^\W_](?:[^\W_]+|[ऀ-ॣ\u0300-\u036f\xad\u200b-\u200f\u2060\ufeff]+)*+|\s+|.", re.S)
_ASCII_TOKEN = re.compile(r"[A-Za-z0-9]+|\s+|.", re.S)
# a token, or a word with the single blank behind it
_PIECE, _ASCII_PIECE = (re.compile(x.pattern.replace(r"|\s+", r"(?: (?!\s))?|\s+"), re.S) for x in (_TOKEN, _ASCII_TOKEN))


def tokens(t: str) -> list[str]:
    return (_ASCII_TOKEN if t.isascii() else _TOKEN).findall(t)


_ENDS = re.compile(r"[.।!?]+(?=\s)|\n")
# Abbreviations whose full stop ends no sentence.
_NO_END = {"no", "h.no", "h", "mr", "mrs", "ms", "dr", "smt", "opp", "moh", "col", "st", "plot", "flat"}
_NO_END_LAST = {w[-1] for w in _NO_END}


class _Kept(dict):
    """Values of a function, kept as they are met."""

    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        self[key] = value = self.f(key)
        return value


class Reader:
    """Texts to network characters, one byte each."""

    def __init__(self, common: set[str]):
        self.common = common
        self.words, self.parts, self.whole = _Kept(self._word), _Kept(self._piece), _Kept(self._read)

    def _word(self, w: str) -> tuple[list[int], list[int]]:
        """Ids of one token and their places in it."""
        first = w[0]
        if first.isspace():
            return [_ID["\n"] if "\n" in w else _ID[" "]], [0]
        if len(w) == 1 and not first.isalnum():
            return ([], []) if first in _SKIP else ([_ID.get(first, OTHER)], [0])
        if w.isdigit():
            return [DIGIT] * len(w), list(range(len(w)))
        if w.isascii() and w.isalpha() and w not in self.common:
            return [RARE] * 3, [0, 0, len(w) - 1]
        kept = [i for i, c in enumerate(w) if c not in _SKIP]
        plain = "".join(w[i] for i in kept)
        if plain in self.common:
            return [_ID.get(c, OTHER) for c in plain], kept
        if any(c.isdigit() for c in plain):
            return [DIGIT if c.isdigit() else CODE for c in plain], kept
        if not kept:
            return [], []
        mark = RARE_HI if "ऀ" <= plain[0] <= "ॿ" else RARE
        return [mark] * 3, [kept[0], kept[0], kept[-1]]

    def _piece(self, w: str) -> bytes:
        blank = w[-1] == " " and not w[0].isspace()
        word = w[:-1] if blank else w
        if word.isascii() and word.isalpha() and word not in self.common:
            ids = _RARE_WORD
        else:
            ids = bytes(self._word(word)[0])
        return ids + _BLANK if blank else ids

    def _read(self, t: str) -> bytes:
        if len(self.parts) > 300_000:
            self.parts.clear()
        return b"".join(map(self.parts.__getitem__, (_ASCII_PIECE if t.isascii() else _PIECE).findall(t)))

    def read(self, t: str) -> bytes:
        if len(t) > 4 * WINDOW:  # long ones aren't kept
            return self._read(t)
        if len(self.whole) > 100_000:
            self.whole.clear()
        return self.whole[t]

    def places(self, t: str) -> tuple[list[int], list[int], list[int]]:
        """For each character of read(t): its place in t, and the start and end of its token."""
        pos, starts, ends, at = [], [], [], 0
        if len(self.words) > 100_000:
            self.words.clear()
        for w in tokens(t):
            own = self.words[w][1]
            pos += [at + i for i in own]
            starts += [at + own[0]] * len(own) if own else []
            ends += [at + own[-1] + 1] * len(own) if own else []
            at += len(w)
        return pos, starts, ends


_CLAUSE = re.compile(rf",\s+(?=({_NAME})(?!\s*\d))")


def split_sentences(t: str, common: set[str] = frozenset()) -> list[tuple[int, int]]:
    """(start, end) of sentences, and of their clauses: a comma before a common word ends one (a comma before a name or a
    number may stand inside an address)."""
    cuts = []
    for m in _ENDS.finditer(t):
        x, y = m.span()
        if x and t[x:y] == "." and t[x - 1] in _NO_END_LAST:
            before = t[max(0, x - 8) : x].rsplit(None, 1)
            if before and before[-1].lstrip("(,") in _NO_END:
                continue
        cuts.append(y)
    if common:
        cuts += [m.start() + 1 for m in _CLAUSE.finditer(t) if m.group(1) in common]
        cuts.sort()
    out, start = [], 0
    for c in [*cuts, len(t)]:
        if c > start:
            out.append((start, c))
            start = c
    return out


# ---- network

class Tagger:
    """Character embeddings -> LSTM in both directions -> scores of tags -> linear-chain CRF. All in numpy."""

    def __init__(self, embed: int = 16, hidden: int = 24, seed: int = 7):
        r = np.random.default_rng(seed)
        k, e, h = len(TAGS), embed, hidden
        self.h = h
        self.p = {"emb": r.normal(0, 0.3, (VOCABULARY + 1, e)), "out": r.normal(0, 0.2, (2 * h, k)), "ob": np.zeros(k), "trans": np.zeros((k, k)), "start": np.zeros(k)}
        for d in "fb":
            self.p[f"wx{d}"] = r.normal(0, 1 / np.sqrt(e), (e, 4 * h))
            self.p[f"wh{d}"] = r.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            b = np.zeros(4 * h)
            b[h : 2 * h] = 1.0
            self.p[f"b{d}"] = b
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}
        ok = np.ones((k, k), bool)
        for j, t in enumerate(TAGS):
            if t[0] == "I":
                ok[:, j] = False
                ok[j, j] = ok[j - 1, j] = True
        self.allowed = ok
        self.first_ok = np.array([t[0] != "I" for t in TAGS])

    def _line(self):
        """Slope, offset and lower bound of the gates in, forget, new, out: z / 4 + 1 / 2 cut to [0, 1]; new: z cut to [-1, 1]."""
        h = self.h
        slope, offset, low = np.full(4 * h, 0.25, np.float32), np.full(4 * h, 0.5, np.float32), np.zeros(4 * h, np.float32)
        new = slice(2 * h, 3 * h)
        slope[new], offset[new], low[new] = 1, 0, -1
        return slope, offset, low

    def _scaled(self, d):
        """Input table and recurrent weights with the gates' line folded in."""
        slope, offset, low = self._line()
        return (self.p["emb"] @ self.p[f"wx{d}"] + self.p[f"b{d}"]) * slope + offset, self.p[f"wh{d}"] * slope, low

    def _lstm(self, x, mask):
        """x: [T, 2, B] ids, each direction in its reading order; hidden and cell states [T + 1, 2, B, H], gates, and where they are on their line."""
        h = self.h
        (tf, wf, low), (tb, wb, _) = self._scaled("f"), self._scaled("b")
        wh = np.stack([wf, wb])
        n, _, b = x.shape
        z = np.concatenate([tf, tb])[x + np.array([[0], [len(tf)]])]
        hs, cs = np.zeros((n + 1, 2, b, h), z.dtype), np.zeros((n + 1, 2, b, h), z.dtype)
        m = mask[..., None].astype(z.dtype)
        gates, high = np.empty_like(z), np.ones(4 * h, z.dtype)
        for t in range(n):
            z[t] += hs[t] @ wh
            s = np.maximum(z[t], low, out=gates[t])
            np.minimum(s, high, out=s)
            c = s[..., h : 2 * h] * cs[t]
            c += s[..., :h] * s[..., 2 * h : 3 * h]
            c *= m[t]
            cs[t + 1] = c
            np.multiply(s[..., 3 * h :] * m[t], np.clip(c, -1, 1), out=hs[t + 1])
        return hs, cs, gates, gates == z

    def _by_gate(self, d):
        """Input table [4, ids, H] and recurrent weights [4, H, H] of _scaled, in the order in, forget, out, new: each gate lies in one piece."""
        return [np.ascontiguousarray(x.reshape(len(x), 4, self.h)[:, [0, 1, 3, 2]].transpose(1, 0, 2)) for x in self._scaled(d)[:2]]

    def _hidden(self, ids, wanted, scaled):
        """Hidden states of the prefixes of ids [T, B], for use without gradients: of columns `wanted` [T, B], each the first that begins
        so. Columns are in order, so those with one prefix are neighbours. Returns all states and the state's number at each place."""
        table, wh = scaled
        place = np.cumsum(wanted, axis=1) - 1
        states = []
        hidden = cell = None
        for t in range(len(ids)):
            at = np.flatnonzero(wanted[t])
            z = np.take(table, ids[t, at], axis=1)
            if t:
                before = place[t - 1, at]
                z += np.matmul(np.take(hidden, before, axis=0), wh)
                cell = np.take(cell, before, axis=0)
            else:
                cell = np.zeros((len(at), self.h), np.float32)
            np.clip(z[:3], 0, 1, out=z[:3])
            tmp = np.clip(z[3], -1, 1, out=z[3])
            cell *= z[1]
            tmp *= z[0]
            cell += tmp
            np.clip(cell, -1, 1, out=tmp)
            hidden = z[2] * tmp
            states.append(hidden)
        place += (np.cumsum([len(x) for x in states]) - list(map(len, states)))[:, None]
        return np.concatenate(states), place

    def infer(self, flat, first, size, batch: int = 2048):
        """Tag scores [sum(size), K] of the windows flat[first : first + size], one after the other. In either direction, windows
        that begin alike share their states."""
        at, steps = np.cumsum(size) - size, np.arange(size.max())
        total = np.float32(0)
        for k, (d, way) in enumerate((("f", 1), ("b", -1))):
            scaled, weight = self._by_gate(d), self.p["out"][k * self.h : (k + 1) * self.h]
            begin = first if way > 0 else first + size - 1
            grid = np.where(steps < size[:, None], flat[np.clip(begin[:, None] + way * steps, 0, len(flat) - 1)], VOCABULARY).astype(np.uint8)
            order = np.argsort(grid.view(f"S{len(steps)}").ravel(), kind="stable")
            found, number, n = [], np.empty(size.sum(), np.intp), 0
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                ids = np.ascontiguousarray(grid[own, : size[own].max()].T)
                live = ids != VOCABULARY
                wanted = live.copy()
                wanted[:, 1:] &= ~np.logical_and.accumulate(ids[:, 1:] == ids[:, :-1], axis=0)
                states, place = self._hidden(ids, wanted, scaled)
                row = at[own] + steps[: len(ids), None] if way > 0 else (at + size - 1)[own] - steps[: len(ids), None]
                number[row[live]] = place[live] + n
                found.append(states @ weight)
                n += len(states)
            total = total + np.take(np.concatenate(found), number, axis=0)
        total += self.p["ob"]
        return total

    def scores(self, ids, mask):
        """Tag scores [T, B, K]; padding is at the end of each column and resets the backward state."""
        x, m = np.stack([ids, ids[::-1]], 1), np.stack([mask, mask[::-1]], 1)
        states = self._lstm(x, m)
        both = np.concatenate([states[0][1:, 0], states[0][1:, 1][::-1]], axis=2)
        return both @ self.p["out"] + self.p["ob"], (x, m, states, both)

    def _trans(self):
        return np.where(self.allowed, self.p["trans"], -1e4).astype(np.float32), np.where(self.first_ok, self.p["start"], -1e4).astype(np.float32)

    def gradients(self, ids, mask, tags):
        """Negative log-likelihood of the tag paths per character and its gradients."""
        s, (x, m, (hs, cs, gates, on), both) = self.scores(ids, mask)
        trans, start = self._trans()
        n, bs, k = s.shape
        # forward and backward sums as products of matrices, each step scaled to sum to one
        high = s.max(2)
        e = np.exp(s - high[:, :, None], dtype=np.float64)
        step = np.exp(trans.astype(np.float64))
        live = mask > 0
        alpha, scale = np.empty((n, bs, k)), np.ones((n, bs))
        alpha[0] = np.exp(start.astype(np.float64)) * e[0]
        for t in range(n):
            if t:
                alpha[t] = np.where(live[t][:, None], (alpha[t - 1] @ step) * e[t], alpha[t - 1])
                scale[t] = np.where(live[t], alpha[t].sum(1), 1.0)
            else:
                scale[0] = alpha[0].sum(1)
            alpha[t] /= scale[t][:, None]
        logz = (np.log(scale) + high * live).sum(0)
        beta = np.ones((bs, k))
        g = {name: np.zeros_like(x) for name, x in self.p.items()}
        ds = np.empty_like(s)
        pairs = np.zeros((k, k))
        for t in range(n - 1, -1, -1):
            p = alpha[t] * beta
            ds[t] = p * live[t][:, None]
            if t:
                ahead = e[t] * beta * (live[t] / scale[t])[:, None]
                pairs += alpha[t - 1].T @ ahead
                beta = np.where(live[t][:, None], ahead @ step.T, beta)
        rows = np.arange(bs)
        ds[np.arange(n)[:, None], rows[None], tags] -= mask
        seen = live[1:]
        g["trans"] += pairs * step - np.bincount(tags[:-1][seen] * k + tags[1:][seen], minlength=k * k).reshape(k, k)
        g["start"] += ds[0].sum(0)
        g["trans"][~self.allowed] = 0
        g["start"][~self.first_ok] = 0
        flat = ds.reshape(-1, k)
        g["out"] = both.reshape(-1, both.shape[2]).T @ flat
        g["ob"] = flat.sum(0)
        dh = ds @ self.p["out"].T
        h = self.h
        dout = np.stack([dh[:, :, :h], dh[::-1, :, h:]], 1) * m[..., None]
        slope = self._line()[0]
        tc = np.clip(cs[1:], -1, 1)
        out = gates[..., 3 * h :]
        by_cell = np.concatenate([gates[..., 2 * h : 3 * h], cs[:-1], gates[..., :h]], axis=3) * (slope[: 3 * h] * on[..., : 3 * h])
        by_cell = by_cell.reshape(*by_cell.shape[:3], 3, h)
        by_hidden = tc * (slope[3 * h :] * on[..., 3 * h :])
        to_cell = out * (tc == cs[1:])
        forget = gates[..., h : 2 * h] * m[..., None]
        back = np.stack([self.p["whf"].T, self.p["whb"].T])
        dz_all = np.empty(gates.shape, np.float32)
        dhn = dcn = np.zeros((2, bs, h), np.float32)
        for t in range(n - 1, -1, -1):
            dht = dout[t] + dhn * m[t][..., None]
            dc = dht * to_cell[t]
            dc += dcn
            dz = dz_all[t]
            np.multiply(dc[:, :, None, :], by_cell[t], out=dz[..., : 3 * h].reshape(2, bs, 3, h))
            np.multiply(dht, by_hidden[t], out=dz[..., 3 * h :])
            dhn, dcn = dz @ back, dc * forget[t]
            if t:
                dcn = dcn * m[t - 1][..., None]
        for k2, d in enumerate("fb"):
            zf = dz_all[:, k2].reshape(-1, 4 * h)
            g[f"wh{d}"] = hs[:-1, k2].reshape(-1, h).T @ zf
            g[f"b{d}"] = zf.sum(0)
            one = np.zeros((VOCABULARY + 1, 4 * h))
            at = x[:, k2].ravel()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            one[at[order][first]] = np.add.reduceat(zf[order], first, axis=0)
            g[f"wx{d}"] = self.p["emb"].T @ one
            g["emb"] += (one @ self.p[f"wx{d}"].T).astype(g["emb"].dtype)
        gold = s[:, rows, :][np.arange(n)[:, None], rows[None], tags] * (mask > 0)
        path = gold.sum(0) + start[tags[0]] + (trans[tags[:-1], tags[1:]] * (mask[1:] > 0)).sum(0)
        return float((logz - path).sum() / mask.sum()), {name: x.astype(np.float32) / max(1.0, bs) for name, x in g.items()}

    def train(self, epochs: list[list[tuple[list[int], list[int]]]], batch: int = 32, rate: float = 0.01, seed: int = 3) -> float:
        """Adam on the windows of each epoch in groups of like length; returns the last mean loss."""
        r = np.random.default_rng(seed)
        m = {n: np.zeros_like(x) for n, x in self.p.items()}
        v = {n: np.zeros_like(x) for n, x in self.p.items()}
        step, loss, total = 0, 0.0, sum(-(-len(data) // batch) for data in epochs)
        for data in epochs:
            order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
            groups = [order[i : i + batch] for i in range(0, len(order), batch)]
            loss = 0.0
            for gi in r.permutation(len(groups)):
                ids, mask, tags = pad([data[i] for i in groups[gi]])
                one, g = self.gradients(ids, mask, tags)
                loss += one / len(groups)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                scale = min(1.0, 5.0 / (norm + 1e-9))
                lr = rate * (1 - 0.9 * step / total)
                for name, x in g.items():
                    x = x * scale
                    m[name] = 0.9 * m[name] + 0.1 * x
                    v[name] = 0.99 * v[name] + 0.01 * x * x
                    self.p[name] -= lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)
        return loss

    def undecided(self, scores: np.ndarray, first: np.ndarray, size: np.ndarray, margin: float = 0.05) -> np.ndarray:
        """Numbers of the sentences scores[first : first + size], shortest first, whose best path may have a mention. In all others every
        stretch read as a mention scores less than O by more than `margin` (rounding is far below), even with the best ways in and out."""
        trans, start = self._trans()
        into, plain = trans.max(0), trans[0, 0]
        begin, inside = np.arange(1, len(TAGS), 2), np.arange(2, len(TAGS), 2)
        leave = np.maximum(0, np.maximum(trans[begin, 0], trans[inside, 0]) - plain)
        begins = scores[:, 1::2] - scores[:, :1] + (np.maximum(into[begin] - plain, start[begin] - start[0]) + leave)
        goes_on = scores[:, 2::2] - scores[:, :1] + (into[inside] - plain)
        best = np.full((len(first), len(KINDS)), -np.inf, np.float32)
        here = best.copy()
        for t in range(size[-1]):
            n = np.searchsorted(size, t, "right")
            at, now = first[n:] + t, here[n:]
            now += np.take(goes_on, at, axis=0)
            np.maximum(now, np.take(begins, at, axis=0), out=now)
            np.maximum(best[n:], now, out=best[n:])
        return np.flatnonzero(best.max(1) >= -margin)

    def viterbi(self, s: np.ndarray, size: np.ndarray) -> dict[int, np.ndarray]:
        """Best tag paths of scores [T, B, K] with `size` steps in each column; columns whose best path has no mention are left out."""
        trans, start = self._trans()
        n, b, k = s.shape
        s = np.ascontiguousarray(s.transpose(0, 2, 1))
        # O and B (odd tags) follow any tag, I (even tags) its B or itself
        anywhere, inside = np.flatnonzero(self.first_ok), np.flatnonzero(~self.first_ok)
        into = np.ascontiguousarray(trans[:, anywhere].T)[:, :, None]
        from_b, from_i = trans[inside - 1, inside][:, None], trans[inside, inside][:, None]
        best = np.empty((n, k, b), np.float32)
        best[0] = start[:, None] + s[0]
        plain = best[0, 0].copy()
        short = size.min()
        for t in range(1, n):
            old, new = best[t - 1], best[t]
            new[0::2][1:] = old[1::2] + from_b
            np.maximum(new[0::2][1:], old[0::2][1:] + from_i, out=new[0::2][1:])
            ways = into + old
            new[1::2] = ways[1:].max(1)
            new[0] = ways[0].max(0)
            new += s[t]
            # in the same order as above, so that it is equal where no tag but O is better
            step = into[0, 0] + plain + s[t, 0]
            if t >= short:
                over = t >= size
                new[:, over] = old[:, over]
                step = np.where(over, plain, step)
            plain = step
        rows = np.flatnonzero(best[-1].max(0) > plain)
        if not len(rows):
            return {}
        best = np.ascontiguousarray(best[:, :, rows].transpose(0, 2, 1))
        at, ends = best[-1].argmax(1), size[rows]
        path = np.empty((n, len(rows)), np.int8)
        for t in range(n - 1, -1, -1):
            path[t] = at
            if t:
                before = (best[t - 1] + trans.T[at]).argmax(1)
                at = np.where(t < ends, before, at)
        return {int(j): path[: size[j], i] for i, j in enumerate(rows)}


def pad(items):
    n, b = max(len(x) for x, _ in items), len(items)
    ids, mask, tags = np.full((n, b), VOCABULARY), np.zeros((n, b), np.float32), np.zeros((n, b), int)
    for j, (x, y) in enumerate(items):
        ids[: len(x), j], mask[: len(x), j] = x, 1
        if y is not None:
            tags[: len(y), j] = y
    return ids, mask, tags


def fits(text: str, kind: str) -> bool:
    """Whether a found stretch can be of its kind at all: how many digits and letters it has, and the signs of an address of mail."""
    digits, letters = sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    if kind == "email":
        return letters > 2 and ("@" in text or "at" in text) and ("." in text or "dot" in text)
    if kind == "phone":
        return letters == 0 and (digits == 10 or digits in (11, 12, 14) and "".join(c for c in text if c.isdigit()).startswith(("0", "91")))
    if kind == "id_number":
        return digits >= 4 and 10 <= digits + letters <= 12
    if kind == "address":
        return digits > 0 and letters > 2
    return digits == 0 and letters > 1


class Finder:
    """A trained tagger with its reader; decodes equal sentences once."""

    def __init__(self, tagger: Tagger, common: set[str], remembered: int = 200_000):
        self.tagger, self.reader, self.limit, self.common = tagger, Reader(common), remembered, common
        self.known: dict[bytes, list[tuple[int, int, str]] | tuple[()]] = {}

    def _decode(self, sentences: list[bytes]) -> None:
        """Tag paths of unseen sentences: overlapping windows in batches by length, averaged, then one Viterbi pass each."""
        lengths = np.array([len(s) for s in sentences])
        starts = np.cumsum(lengths) - lengths
        windows = []
        for k in np.argsort(lengths, kind="stable").tolist():
            n = int(lengths[k])
            for a in range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n > WINDOW else (0,):
                windows.append((k, a, min(n, a + WINDOW)))
        k, a, b = np.array(windows).T
        scores = self.tagger.infer(np.frombuffer(b"".join(sentences), np.uint8), starts[k] + a, b - a)
        at = np.cumsum(b - a) - (b - a)

        self.known.update(dict.fromkeys(sentences, ()))

        def paths(part: np.ndarray, found: np.ndarray, first: np.ndarray, batch: int) -> None:
            some = self.tagger.undecided(found, first, lengths[part])
            for i in range(0, len(some), batch):
                own = some[i : i + batch]
                size = lengths[part[own]]
                steps = np.minimum(np.arange(size[-1])[:, None], size - 1)
                self._remember([sentences[k] for k in part[own]], np.take(found, first[own] + steps, axis=0), size)

        # windows are in order of their sentences' lengths: first those of whole sentences
        whole = int(np.searchsorted(lengths[k], WINDOW, "right"))
        if whole:
            paths(k[:whole], scores, at[:whole], 512)
        long = list(dict.fromkeys(k[whole:].tolist()))
        if not long:
            return
        place = dict(zip(long, (np.cumsum(lengths[long]) - lengths[long]).tolist()))
        total, times = np.zeros((lengths[long].sum(), len(TAGS)), np.float32), np.zeros((lengths[long].sum(), 1), np.float32)
        for i in range(whole, len(windows)):
            n, x, y = windows[i]
            total[place[n] + x : place[n] + y] += scores[at[i] : at[i] + y - x]
            times[place[n] + x : place[n] + y] += 1
        total /= times
        paths(np.array(long), total, np.array([place[n] for n in long]), 128)

    def _remember(self, keys: list[bytes], s: np.ndarray, size: np.ndarray) -> None:
        for j, path in self.tagger.viterbi(s, size).items():
            spans: list[tuple[int, int, str]] = []
            for t in np.flatnonzero(path):
                y = int(path[t])
                if TAGS[y][0] == "B":
                    spans.append((int(t), int(t) + 1, TAGS[y][2:]))
                elif spans:
                    spans[-1] = (spans[-1][0], int(t) + 1, spans[-1][2])
            self.known[keys[j]] = spans

    def find(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of each text's mentions, in order."""
        if len(self.known) >= self.limit:
            self.known.clear()
        plans, unseen = [], {}
        for text in texts:
            plan: list[tuple[bytes, int, int]] = []
            t, stood = visible(one_form(text)) if text else ("", None)
            for a, b in split_sentences(t, self.common):
                if key := self.reader.read(t[a:b]):
                    plan.append((key, a, b))
                    if key not in self.known:
                        unseen[key] = None
            plans.append((t, plan, stood))
        todo = sorted(unseen)  # sentences that begin alike in one go
        for i in range(0, len(todo), 8192):
            self._decode(todo[i : i + 8192])
        out = []
        for t, plan, stood in plans:
            found: list[tuple[int, int, str]] = []
            for key, a, b in plan:
                if spans := self.known[key]:
                    _, starts, ends = self.reader.places(t[a:b])
                    for x, y, kind in spans:
                        s, e = a + starts[x], a + ends[y - 1]
                        if fits(t[s:e], kind) and (not found or s >= found[-1][1]):
                            found.append((s, e, kind))
            out.append(found if stood is None else [(stood[a], stood[b - 1] + 1, k) for a, b, k in found])
        return out


# ---- Spark

def common_words(df: DataFrame, text_col: str, least_share: float = 0.0006, least: int = 4, most: int = 50_000) -> set[str]:
    """Words of at least `least_share` as many occurrences as there are texts, counted over all of them. Their number is bounded
    by words per text / least_share, and an error is raised beyond `most`."""
    n = df.count()
    words = df.select(F.explode(F.split(F.lower(text_col), r"[^\p{L}\p{M}]+")).alias("w")).filter("w <> ''")
    rows = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= max(least, least_share * n)).select("w").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words: raise least_share")
    return {"".join(c for c in one_form(r["w"]) if c not in _SKIP) for r in rows}


def training_windows(labelled: list[tuple[str, list[tuple[int, int, str]]]], reader: Reader) -> list[tuple[list[int], list[int]]]:
    """Distinct windows of labelled texts: characters and tags."""
    out: dict[tuple, None] = {}
    for text, spans in labelled:
        t = one_form(text)
        for a, b in split_sentences(t, reader.common):
            ids, pos = reader.read(t[a:b]), reader.places(t[a:b])[0]
            tags = [0] * len(ids)
            for s, e, kind in spans:
                inside = [i for i, p in enumerate(pos) if s <= a + p < e]
                for n, i in enumerate(inside):
                    tags[i] = 1 + 2 * KINDS.index(kind) + (n > 0)
            for i in range(0, max(1, len(ids) - WINDOW + STRIDE), STRIDE) if len(ids) > WINDOW else (0,):
                x, y = ids[i : i + WINDOW], tags[i : i + WINDOW]
                if x:
                    if TAGS[y[0]][0] == "I":
                        y = [y[0] - 1, *y[1:]]
                    out[x, tuple(y)] = None
    return [(list(x), list(y)) for x, y in out]


def frequent_names(labelled: list[tuple[str, list[tuple[int, int, str]]]], names: dict[bool, list[str]], share: float = 0.3, seed: int = 23) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled texts in which some names of people are replaced by `names` (by script; words the reader shows as they are)
    or cut to one word: what stands around a name must tell it, not how rare it is."""
    r = np.random.default_rng(seed)
    out = []
    for text, spans in labelled:
        new, moved, at = "", [], 0
        for s, e, kind in spans:
            mention = text[s:e]
            if kind == "person" and r.random() < share:
                parts = mention.split()
                own = names["ऀ" <= mention[0] <= "ॿ"]
                parts = parts[:1] if r.random() < 0.3 else parts
                mention = " ".join(str(r.choice(own)) if r.random() < 0.7 else w for w in parts)
            new += text[at:s]
            moved.append((len(new), len(new) + len(mention), kind))
            new, at = new + mention, e
        out.append((new + text[at:], moved))
    return out


def train_on(labelled: list[tuple[str, list[tuple[int, int, str]]]], common: set[str], windows: int = 6000, repeat: int = 3, epochs: int = 5) -> Finder:
    """A finder trained on at most `windows` windows with mentions (each `repeat` times an epoch) and, in each epoch, as many others
    without."""
    from sangam.llm.pii_labels import invented

    names = {deva: invented(400, deva) for deva in (False, True)}
    data = training_windows(frequent_names(labelled, names), Reader(common.union(*names.values())))
    full, empty = [d for d in data if any(d[1])], [d for d in data if not any(d[1])]
    r = np.random.default_rng(11)
    r.shuffle(full)
    r.shuffle(empty)
    tagger = Tagger()
    if full:
        # every epoch sees all windows with mentions and others of those without
        tagger.train([[*full[:windows] * repeat, *(empty[k * windows : (k + 1) * windows] or empty[:windows])] for k in range(epochs)])
    return Finder(tagger, common)


def fit(df: DataFrame, id_col: str, text_col: str, label: Callable[[str], list[tuple[int, int, str]]] | None = None, sample_rows: int = 6000, generated: int = 2500, windows: int = 6000, repeat: int = 3, epochs: int = 5) -> Finder:
    """A finder trained on `generated` made sentences and about sample_rows texts (bounded_sample) with the spans that `label`
    gives (by wordings if None)."""
    from sangam.llm.pii_labels import generate, weak_spans

    common = common_words(df, text_col)
    sample = sorted(r[0] for r in bounded_sample(df.filter(F.col(text_col).isNotNull()).select(id_col, text_col), id_col, sample_rows).select(text_col).collect())
    return train_on([*generate(generated), *((t, (label or weak_spans)(t)) for t in sample)], common, windows, repeat, epochs)


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())]))


def find_mentions(df: DataFrame, text_col: str, finder: Finder) -> DataFrame:
    """`df` plus mentions and redacted (the text with each mention replaced by [KIND])."""
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, finder.tagger, finder.common))
    out = StructType([StructField("mentions", SPANS), StructField("redacted", StringType())])

    @F.pandas_udf(out)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = _finder(shared)
        for texts in batches:
            found = f.find(list(texts))
            rows = []
            for t, spans in zip(texts, found):
                parts, at = [], 0
                for a, b, k in spans:
                    parts += [t[at:a], f"[{k.upper()}]"]
                    at = b
                rows.append(([{"start": a, "end": b, "kind": k} for a, b, k in spans], None if t is None else "".join([*parts, t[at:]])))
            yield pd.DataFrame(rows, columns=out.names)

    d = df.withColumn("_m", run(F.col(text_col)))
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("mentions", "redacted")], "_m.mentions", "_m.redacted")


_LOADED: dict[str, Finder] = {}


def _finder(shared) -> Finder:
    """One finder per worker and broadcast (its name is its key), with what it remembers."""
    name, tagger, common = shared.value
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Finder(tagger, common)
    return _LOADED[name]
