"""Report pairs: exact blocking in space and time or by the least score, and the factors of a pair's score.

near_pairs: a report lies in one cell of a grid over (x, y, z, time); the other side of a pair is copied into every cell its ball of
`reach_m` metres and `reach_min` minutes touches (two per axis at most, as cells are twice as wide). So each pair within
reach meets exactly once, in an equi-join; no pair beyond the neighbouring cells is ever formed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sangam.functions.patterns import RELATED_TYPES
from sangam.operators.geo import EARTH_M, haversine_m, valid_position
from sangam.session import durable

# Weights of the score.
WEIGHTS = {"semantic": 0.40, "geographic": 0.30, "temporal": 0.15, "incident_type": 0.15}
REACH_M, NEAR_MIN, FAR_MIN = 2000.0, 5.0, 90.0


def geo_score(distance: Column, same_place: Column) -> Column:
    return F.when(F.coalesce(same_place, F.lit(False)), 1.0).when(distance.isNull() | (distance > REACH_M), 0.0).otherwise(1 - distance / REACH_M)


def temporal_score(minutes: Column) -> Column:
    return F.when(minutes.isNull() | (minutes > FAR_MIN), 0.0).when(minutes <= NEAR_MIN, 1.0).otherwise(1 - (minutes - NEAR_MIN) / (FAR_MIN - NEAR_MIN))


def type_score(a: Column, b: Column) -> Column:
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    related = F.concat_ws("|", F.least(a, b), F.greatest(a, b)).isin(*["|".join(sorted(p)) for p in RELATED_TYPES])
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).when(related, 0.5).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays clamped to [0, 1]; 0 for null, empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / n))).otherwise(0.0)


def match_score(semantic: Column, geographic: Column, temporal: Column, kind: Column) -> Column:
    w = WEIGHTS
    return semantic * w["semantic"] + geographic * w["geographic"] + temporal * w["temporal"] + kind * w["incident_type"]


def near_pairs(reports: DataFrame, reach_m: float = REACH_M, reach_min: float = FAR_MIN) -> DataFrame:
    """Pairs of rows (id, lat, lon, at timestamp, ...) within reach of each other in space and time: all columns with _a and
    _b, distance_m, minutes; id_a < id_b. Rows without a valid position or time take no part."""
    la, lo = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(la) * F.cos(lo) * EARTH_M, "y": F.cos(la) * F.sin(lo) * EARTH_M, "z": F.sin(la) * EARTH_M, "t": F.unix_micros("at") / 6e7}
    reach = dict.fromkeys("xyz", reach_m) | {"t": reach_min}
    d = reports.filter(valid_position(F.col("lat"), F.col("lon")) & F.col("at").isNotNull())
    cell = lambda v, k: F.floor(v / (2 * reach[k])).cast("bigint")
    a, b = d, d
    for k, v in axes.items():
        a = a.withColumn(f"c{k}", cell(v, k))
        b = b.withColumn(f"c{k}", F.explode(F.sequence(cell(v - reach[k] * 1.000001 - 1e-6, k), cell(v + reach[k] * 1.000001 + 1e-6, k))))
    cells = [f"c{k}" for k in axes]
    a = a.select(*cells, *[F.col(f"`{c}`").alias(f"{c}_a") for c in reports.columns])
    b = b.select(*cells, *[F.col(f"`{c}`").alias(f"{c}_b") for c in reports.columns])
    p = a.join(b, cells).filter("id_a < id_b").drop(*cells)
    p = p.withColumn("distance_m", haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))).withColumn("minutes", F.abs(F.unix_micros("at_a") - F.unix_micros("at_b")) / 6e7)
    return p.filter((F.col("distance_m") <= reach_m) & (F.col("minutes") <= reach_min))


SCORED = "id_a string, id_b string, sem double, geo double, tmp double, typ double, score double"
PAYLOAD = ["id", "place", "lat", "lon", "us", "kind", "e"]
#: What brings two rows together: likeness alone, likeness with a type, or a moment (with a cell, a place or a type).
ALIKE, TYPED, SOON = 0, 1, 2
DAY_S, FAR_S = 86_400, int(FAR_MIN * 60)
_MUL, _MUL2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(*parts) -> np.ndarray:
    """One 64-bit hash of whole numbers, elementwise. Clashes only bring more rows together."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = (h ^ np.atleast_1d(np.asarray(p, np.int64)).view(np.uint64)) * _MUL
        h = (h ^ (h >> np.uint64(32))) * _MUL2
        h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _doubles(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return c.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _codes(c: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
    """(code of each string, -1 for null; the strings)"""
    d = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _touched(axes: list[np.ndarray], reach: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, cell) of the cells that each row's ball touches, at most two an axis as cells are a little wider than balls; the rows' own
    cells come first."""
    low, high, own = ([np.floor((x + s * (reach * 1.000001 + 1e-6)) / (2.001 * reach)).astype(np.int64) for x in axes] for s in (-1, 1, 0))
    pack = lambda c: ((c[0] + (1 << 19) << 20) + c[1] + (1 << 19) << 20) + c[2] + (1 << 19)
    rows = np.arange(len(axes[0]))
    out = [(rows, pack(own))]
    for step in np.ndindex(2, 2, 2):
        at = [np.where(s, h, lo) for s, h, lo in zip(step, high, low)]
        once = np.all([(not s) | (h > lo) for s, h, lo in zip(step, high, low)], axis=0)
        c = pack(at)
        once &= c != out[0][1]
        out.append((rows[once], c[once]))
    return out


def _meeting_places(b: pa.RecordBatch, least: float) -> tuple[np.ndarray, ...]:
    """(row, mode, key, own, second) of rows (place, lat, lon, us, kind). Two rows meet under a key at which one at least is `own`:
    a row visits the cells before its own that it touches, so each pair meets there once. Seconds count from the key's day."""
    w = WEIGHTS
    rest = lambda *f: least - sum(w[x] for x in f)
    lat, lon, us = (_doubles(b.column(c)) for c in ("lat", "lon", "us"))
    placed, timed = np.flatnonzero(~np.isnan(lat) & ~np.isnan(lon)), ~np.isnan(us)
    la, lo = np.radians(lat[placed]), np.radians(lon[placed])
    axes = [EARTH_M * x for x in (np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la))]
    reach = lambda geo: max(50.0, REACH_M * (1 - max(0.0, geo) / w["geographic"]))
    place, places = _codes(b.column("place"))
    spot = np.array([_number(x) for x in places] or [0], np.int64)
    kind, kinds = _codes(b.column("kind"))
    links = [[_number(k), *(_number("|".join(sorted(p))) for p in RELATED_TYPES if k in p)] for k in kinds]
    typed = np.flatnonzero(kind >= 0)
    many = np.array([len(x) for x in links] or [0])[kind[typed]]
    link_row = np.repeat(typed, many)
    link = np.array([x for k in kind[typed] for x in links[k]], np.int64)
    first = np.searchsorted(link_row, np.arange(b.num_rows))
    per_row = np.bincount(link_row, minlength=b.num_rows)
    out = []

    def add(row, mode, own, second, *key):
        out.append((row, np.full(len(row), mode), np.broadcast_to(_mix(mode, *key), len(row)), np.broadcast_to(own, len(row)), np.broadcast_to(second, len(row))))

    def with_links(row, *more):
        """Rows once for each of their types' links."""
        i = np.repeat(np.arange(len(row)), per_row[row])
        at = first[row][i] + np.arange(len(i)) - np.repeat(np.cumsum(per_row[row]) - per_row[row], per_row[row])
        return row[i], link[at], *(x[i] for x in more)

    def days(row):
        """(index into row, day, whether it is the row's own) of each row's day, and of the day before where FAR_MIN reaches it."""
        day = np.floor(us[row] / (DAY_S * 1e6)).astype(np.int64)
        before = np.flatnonzero(us[row] - day * (DAY_S * 1e6) <= FAR_S * 1e6)
        return [(np.arange(len(row)), day, True), (before, day[before] - 1, False)]

    seconds = lambda row, day: np.floor(us[row] / 1e6).astype(np.int64) - day * DAY_S
    named = placed[place[placed] >= 0]
    # times apart, no common type: likeness and space alone
    if rest("geographic") <= w["semantic"]:
        cells = _touched(axes, reach(rest("semantic")))
        for i, c in cells:
            own = cells[0][1][i]
            go = c <= own
            add(placed[i[go]], ALIKE, c[go] == own[go], 0, 1, c[go])
        add(named, ALIKE, True, 0, 2, spot[place[named]])
    # times apart, types that go together
    if rest("geographic", "incident_type") <= w["semantic"]:
        cells = _touched(axes, reach(rest("semantic", "incident_type")))
        for i, c in cells:
            own = cells[0][1][i]
            go = c <= own
            row, of, c, own = with_links(placed[i[go]], c[go], own[go])
            add(row, TYPED, c == own, 0, 3, of, c)
        row, of = with_links(named)
        add(row, TYPED, True, 0, 4, of, spot[place[row]])
    # times that are near
    soon = timed[placed]
    cells = _touched(axes, REACH_M)
    for i, c in cells:
        own = cells[0][1][i]
        i, c, own = i[soon[i]], c[soon[i]], own[soon[i]]
        for k, day, same in days(placed[i]):
            go = c[k] <= own[k] if same else slice(None)
            k, day = k[go], day[go]
            row = placed[i[k]]
            add(row, SOON, (c[k] == own[k]) & same, seconds(row, day), 5, day, c[k])
    row = named[timed[named]]
    for k, day, same in days(row):
        add(row[k], SOON, same, seconds(row[k], day), 6, day, spot[place[row[k]]])
    row = typed[timed[typed]]
    for k, day, same in days(row):
        r, of, day = with_links(row[k], day)
        add(r, SOON, same, seconds(r, day), 7, day, of)
    return tuple(np.concatenate(x) for x in zip(*out))


def _couples(last: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each i and all j in i + 1 .. last[i] - 1, in pieces."""
    partners = np.maximum(last - np.arange(len(last)) - 1, 0)
    a = np.flatnonzero(partners)
    partners = partners[a]
    upto, done = np.cumsum(partners), 0
    while done < len(a):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + step, "right")))
        p = partners[done:to]
        i = np.repeat(a[done:to], p)
        yield i, i + 1 + np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        done = to


def _alike(u: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float, later: bool, height: int = 512, width: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row and a column (with `later`, at a later position) whose unit vectors' product is at least `least`, from tiles of a matrix."""
    right = np.ascontiguousarray(u[cols])
    for r in range(0, len(rows), height):
        left = u[rows[r : r + height]]
        for c in range(r if later else 0, len(cols), width):
            s = left @ right[c : c + width].T
            i, j = np.divmod(np.flatnonzero(s >= least), s.shape[1])
            keep = c + j > r + i if later else slice(None)
            if len(i):
                yield rows[r + i[keep]], cols[c + j[keep]]


def _score(t: pa.Table, least: float, few: int = 64) -> pa.Table:
    """The pairs of whole meetings that score at least `least`. Only rows near in time, or of vectors as like as the rest of the score
    demands, are compared in every factor."""
    w = WEIGHTS
    n = t.num_rows
    raw = np.frombuffer(b"".join(t.column("e").to_pylist()), np.int8).reshape(n, -1)
    e = raw.astype(np.float32 if raw.shape[1] <= 1024 else np.float64)  # products are whole numbers, exact in either
    norm = np.sqrt(np.einsum("ij,ij->i", e, e, dtype=np.float64))
    u = np.divide(e, norm[:, None], out=np.zeros_like(e, np.float32), where=norm[:, None] > 0, casting="unsafe")
    la, lo, us = np.radians(_doubles(t.column("lat"))), np.radians(_doubles(t.column("lon"))), _doubles(t.column("us"))
    place, _ = _codes(t.column("place"))
    kind, kinds = _codes(t.column("kind"))
    names = sorted({*kinds, *(k for p in RELATED_TYPES for k in p)})
    number = {k: i for i, k in enumerate(names)}
    table = np.zeros((len(names) + 1, len(names) + 1))  # the last is for null
    table[range(len(names)), range(len(names))] = 1
    for x, y in RELATED_TYPES:
        table[number[x], number[y]] = table[number[y], number[x]] = 0.5
    kind = np.array([*(number[k] for k in kinds), len(names)])[kind]
    _, g = np.unique(t.column("g").to_numpy(), return_inverse=True)
    mode, own, side, second = (t.column(c).to_numpy() for c in ("mode", "own", "side", "second"))
    found = []

    def test(i: np.ndarray, j: np.ndarray) -> None:
        ok = (own[i] | own[j]) & ((side[i] == 2) | (side[i] != side[j]))
        i, j = i[ok], j[ok]
        product = norm[i] * norm[j]
        sem = np.clip(np.divide(np.einsum("ij,ij->i", e[i], e[j]), product, out=np.zeros(len(i)), where=product > 0), 0, 1)
        dt = np.abs(us[i] - us[j]) / 6e7
        tmp = np.where(dt <= NEAR_MIN, 1.0, np.where(dt <= FAR_MIN, 1 - (dt - NEAR_MIN) / (FAR_MIN - NEAR_MIN), 0.0))
        typ = table[kind[i], kind[j]]
        ok = sem * w["semantic"] + w["geographic"] + tmp * w["temporal"] + typ * w["incident_type"] >= least - 1e-6
        i, j, sem, tmp, typ = (x[ok] for x in (i, j, sem, tmp, typ))
        h = np.sin((la[j] - la[i]) / 2) ** 2 + np.cos(la[i]) * np.cos(la[j]) * np.sin((lo[j] - lo[i]) / 2) ** 2
        m = 2 * EARTH_M * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0, 1 - h)))
        known = ~np.isnan(m)
        geo = np.where(known & (place[i] == place[j]) & (place[i] >= 0), 1.0, np.where(known & (m <= REACH_M), 1 - m / REACH_M, 0.0))
        score = np.round(sem * w["semantic"] + geo * w["geographic"] + tmp * w["temporal"] + typ * w["incident_type"], 9)
        ok = score >= least
        found.append([x[ok] for x in (i, j, sem, geo, tmp, typ, score)])

    at = np.flatnonzero(mode == SOON)
    at = at[np.lexsort((second[at], g[at]))]
    moment = g[at].astype(np.int64) * (DAY_S + 4 * FAR_S) + second[at]
    for i, j in _couples(np.searchsorted(moment, moment + FAR_S, "right")):
        test(at[i], at[j])
    for likeness, least_sem in ((ALIKE, (least - w["geographic"]) / w["semantic"]), (TYPED, (least - w["geographic"] - w["incident_type"]) / w["semantic"])):
        at = np.flatnonzero(mode == likeness)
        at = at[np.lexsort((~own[at], g[at]))]
        start = np.flatnonzero(np.append(True, g[at][1:] != g[at][:-1])) if len(at) else np.empty(0, int)
        size = np.diff(np.append(start, len(at)))
        last = np.repeat(np.where(size <= few, start + size, 0), size)
        for i, j in _couples(last):
            test(at[i], at[j])
        for s, k in zip(start[size > few], size[size > few]):
            x = at[s : s + k]
            if side[x[0]] == 2:
                parts = [(x[own[x]], x, True)]
            else:
                a, b = x[side[x] == 0], x[side[x] == 1]
                parts = [(a[own[a]], b, False), (a[~own[a]], b[own[b]], False)]
            for rows, cols, later in parts:
                for i, j in _alike(u, rows, cols, least_sem - 1e-5, later):
                    test(i, j)
    i, j, *factors = (np.concatenate(x) for x in zip(*found)) if found else [np.empty(0, int)] * 2 + [np.empty(0)] * 5
    ids = t.column("id").combine_chunks()
    a, b = (ids.take(pa.array(x)).to_numpy(zero_copy_only=False).astype(object) for x in (i, j))
    ok, swap = a != b, a > b
    a, b = np.where(swap, b, a)[ok], np.where(swap, a, b)[ok]
    names = [c.split()[0] for c in SCORED.split(", ")]
    return pa.table([pa.array(a, pa.string()), pa.array(b, pa.string()), *(pa.array(x[ok], pa.float64()) for x in factors)], names=names)


def linked_pairs(reports: DataFrame, least: float = 0.6, block: int = 1 << 15, group_rows: int = 20_000) -> DataFrame:
    """All pairs id_a < id_b of reports (id, place, lat, lon, us, kind, e: vector of signed bytes) whose score is at least `least`, with sem,
    geo, tmp, typ and score. A missing factor scores 0 and removes no report.

    Pairs meet by what their other factors leave to be reached: with times apart and no common type, in a cell as wide as the
    score then allows (or at their common place), where only vectors that are like enough are compared further; with types that go
    together the same under both; with near times by the time within a cell, a place or a type. Meeting places of more than
    `block` rows are cut into blocks, each two of which meet in a task of their own: no group is unbounded."""
    w = WEIGHTS
    if not w["semantic"] + max(w["temporal"], w["incident_type"]) < least <= 1:
        raise ValueError("the meeting places hold for least in (0.55, 1] only")
    ok = valid_position(F.col("lat"), F.col("lon"))
    kind = F.nullif(F.lower(F.trim("kind")), F.lit(""))
    d = durable(reports.select("id", F.nullif(F.col("place"), F.lit("")).alias("place"), F.when(ok, F.col("lat")).alias("lat"), F.when(ok, F.col("lon")).alias("lon"), "us", kind.alias("kind"), "e", F.xxhash64("id").alias("h")), "scored")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_meeting_places(b, least)[2])], names=["key"])

    size = d.select("place", "lat", "lon", "us", "kind").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / block)
    rows, hot = size.agg(F.sum(F.col("n") * parts), F.collect_list(F.when(F.col("n") > block, F.struct("key", parts.alias("k"))))).first()
    n = (rows or 0) // group_rows + 1
    hot = dict(sorted((x["key"], x["k"]) for x in hot))
    hot_keys, hot_parts = np.array([*hot, np.iinfo(np.int64).max], np.int64), np.array([*hot.values(), 1], np.int64)

    def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, mode, key, own, second = _meeting_places(b, least)
            i = np.minimum(np.searchsorted(hot_keys, key), len(hot) - (len(hot) > 0))
            k = np.where(hot_keys[i] == key, hot_parts[i], 1)
            x = np.repeat(np.arange(len(row)), k)
            theirs = np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
            k, key = k[x], key[x]
            mine = (_mix(b.column("h").to_numpy())[row[x]] >> 8) % k
            g = np.where(k > 1, _mix(key, np.minimum(mine, theirs), np.maximum(mine, theirs)), key)
            side = np.where(mine == theirs, 2, mine > theirs)
            made = {"bucket": _mix(g) % n, "g": g, "mode": mode[x].astype(np.int32), "own": own[x], "side": side.astype(np.int32), "second": second[x].astype(np.int64)}
            for s in range(0, len(x), 20_000):
                at = slice(s, s + 20_000)
                taken = b.select(PAYLOAD).take(pa.array(row[x[at]]))
                yield pa.RecordBatch.from_arrays([*(pa.array(v[at]) for v in made.values()), *taken.columns], names=[*made, *PAYLOAD])

    kinds = ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in PAYLOAD)
    met = d.mapInArrow(meetings, f"bucket long, g long, mode int, own boolean, side int, second long, {kinds}")
    return met.repartition(n, "bucket").groupBy("bucket").applyInArrow(lambda t: _score(t, least), SCORED).dropDuplicates(["id_a", "id_b"])
