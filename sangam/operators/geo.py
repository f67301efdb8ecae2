"""Points near other points, points in circles, points in polygons.

Positions become unit vectors; a great-circle distance is then a chord. Space is split by a k-d tree over the vectors
(split values come from a bounded sample and affect only balance). A target is copied into every cell its ball touches
(halo copies); a point is looked up in its own cell only, in a local k-d tree over the cell's targets.

Where the targets are proven to be few, their cells and trees are broadcast and points never move. Otherwise points and
halo copies are shuffled by (cell, salt): a hot cell's points are spread over salts and its targets repeated on each.

Defined results: a position with a null, NaN, infinite or out-of-range coordinate matches nothing; 0/0 is a position.
Repeated rows match each on its own. A null or negative radius matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EARTH_M = 6_371_000.0


def valid_position(lat: Column, lon: Column) -> Column:
    """Both coordinates finite and in range."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(ok, F.lit(False))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (atan2 form) as a JVM expression."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def _np_haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(0.0, 1 - a)))


def chord(radius_m: np.ndarray) -> np.ndarray:
    """Chord of a great-circle distance, with slack so that it never excludes a true match."""
    return 2 * np.sin(np.minimum(np.asarray(radius_m, float) / (2 * EARTH_M), math.pi / 2)) * (1 + 1e-9) + 1e-9


class Splits:
    """The global k-d split: a complete binary tree of (axis, value), leaf number = cell."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, 2**depth - 1), int)
        self.value = np.zeros(max(1, 2**depth - 1))
        part = {0: sample}
        for i in range(2**depth - 1):
            s = part.pop(i, np.empty((0, 3)))
            if len(s):
                self.axis[i] = int(np.argmax(s.max(0) - s.min(0)))
                self.value[i] = float(np.median(s[:, self.axis[i]]))
            right = s[:, self.axis[i]] >= self.value[i] if len(s) else np.zeros(0, bool)
            part[2 * i + 1], part[2 * i + 2] = s[~right], s[right]

    def cell(self, v: np.ndarray) -> np.ndarray:
        at = np.zeros(len(v), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (v[np.arange(len(v)), self.axis[at]] >= self.value[at])
        return at - (2**self.depth - 1)

    def cells_touched(self, v: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, cell) of each ball's halo copies."""
        idx, at = np.arange(len(v)), np.zeros(len(v), int)
        for _ in range(self.depth):
            x, s = v[idx, self.axis[at]], self.value[at]
            low, high = x - r[idx] <= s, x + r[idx] >= s
            idx, at = np.concatenate([idx[low], idx[high]]), np.concatenate([2 * at[low] + 1, 2 * at[high] + 2])
        return idx, at - (2**self.depth - 1)


class BallTree:
    """Local k-d tree over balls (centre, chord radius): which balls hold each query point? Queries run in batches of points."""

    LEAF = 16

    def __init__(self, v: np.ndarray, r: np.ndarray):
        self.v, self.r = v, r
        self.root = self._build(np.arange(len(v))) if len(v) else None

    def _build(self, ids: np.ndarray):
        low = (self.v[ids] - self.r[ids, None]).min(0)
        high = (self.v[ids] + self.r[ids, None]).max(0)
        if len(ids) <= self.LEAF:
            return low, high, ids, None, None
        axis = int(np.argmax(np.ptp(self.v[ids], axis=0)))
        order = ids[np.argsort(self.v[ids, axis], kind="stable")]
        mid = len(order) // 2
        return low, high, None, self._build(order[:mid]), self._build(order[mid:])

    def query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got_q, got_t = [], []
        stack = [(self.root, np.arange(len(q)))] if self.root is not None else []
        while stack:
            (low, high, ids, left, right), at = stack.pop()
            at = at[((q[at] >= low) & (q[at] <= high)).all(1)]
            if not len(at):
                continue
            if ids is None:
                stack += [(left, at), (right, at)]
                continue
            d2 = ((q[at][:, None, :] - self.v[ids][None, :, :]) ** 2).sum(2)
            a, b = np.nonzero(d2 <= self.r[ids] ** 2)
            got_q.append(at[a])
            got_t.append(ids[b])
        if not got_q:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(got_q), np.concatenate(got_t)


def _match(plat, plon, tlat, tlon, trad, q_tree: BallTree) -> tuple[np.ndarray, np.ndarray]:
    """Candidates by chord from the tree, then the exact great-circle test."""
    a, b = q_tree.query(unit(plat, plon))
    keep = _np_haversine(plat[a], plon[a], tlat[b], tlon[b]) <= trad[b]
    return a[keep], b[keep]


def within_distance(
    points: DataFrame,
    targets: DataFrame,
    point_id: str,
    target_id: str,
    point_lat: str = "lat",
    point_lon: str = "lon",
    target_lat: str = "lat",
    target_lon: str = "lon",
    radius_m: str = "radius_m",
    depth: int = 6,
    sample_rows: int = 20_000,
    max_broadcast_targets: int = 100_000,
    salt_rows: int = 200_000,
) -> DataFrame:
    """(point_id, target_id) for every point within the target's radius. sample_rows bounds the sample that places the k-d splits."""
    spark = points.sparkSession
    p = points.select(F.col(point_id).alias("pid"), F.col(point_lat).cast("double").alias("plat"), F.col(point_lon).cast("double").alias("plon")).filter(valid_position(F.col("plat"), F.col("plon")))
    t = targets.select(F.col(target_id).alias("tid"), F.col(target_lat).cast("double").alias("tlat"), F.col(target_lon).cast("double").alias("tlon"), F.col(radius_m).cast("double").alias("trad"))
    t = t.filter(valid_position(F.col("tlat"), F.col("tlon")) & (F.col("trad") >= 0) & ~F.isnan("trad"))
    out = StructType([p.schema["pid"], t.schema["tid"]])
    few = t.limit(max_broadcast_targets + 1).toPandas()
    if len(few) <= max_broadcast_targets:
        v, r = unit(few["tlat"].to_numpy(float), few["tlon"].to_numpy(float)), chord(few["trad"].to_numpy(float))
        splits = Splits(v[:: max(1, len(v) // sample_rows)], depth if len(v) else 0)
        idx, cell = splits.cells_touched(v, r)
        ids, tlat, tlon, trad = few["tid"].to_numpy(), few["tlat"].to_numpy(float), few["tlon"].to_numpy(float), few["trad"].to_numpy(float)
        cells = {int(c): idx[cell == c] for c in np.unique(cell)}
        shared = spark.sparkContext.broadcast((splits, cells, v, r, ids, tlat, tlon, trad))

        def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            splits, cells, v, r, ids, tlat, tlon, trad = shared.value
            trees = {c: BallTree(v[i], r[i]) for c, i in cells.items()}
            for b in batches:
                la, lo = b["plat"].to_numpy(float), b["plon"].to_numpy(float)
                at = splits.cell(unit(la, lo))
                order = np.argsort(at, kind="stable")
                found_p, found_t = [], []
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    c = int(at[part[0]]) if len(part) else -1
                    if c in trees:
                        i = cells[c]
                        x, y = _match(la[part], lo[part], tlat[i], tlon[i], trad[i], trees[c])
                        found_p.append(part[x])
                        found_t.append(i[y])
                if found_p:
                    x, y = np.concatenate(found_p), np.concatenate(found_t)
                    yield pd.DataFrame({"pid": b["pid"].to_numpy()[x], "tid": ids[y]})

        got = p.mapInPandas(local, out)
    else:
        sample = t.orderBy(F.xxhash64("tid", "tlat", "tlon")).limit(sample_rows).toPandas()
        splits = Splits(unit(sample["tlat"].to_numpy(float), sample["tlon"].to_numpy(float)), depth)
        shared = spark.sparkContext.broadcast(splits)

        @F.pandas_udf("int")
        def cell_of(la: pd.Series, lo: pd.Series) -> pd.Series:
            return pd.Series(shared.value.cell(unit(la.to_numpy(float), lo.to_numpy(float))))

        @F.pandas_udf("array<int>")
        def halo(la: pd.Series, lo: pd.Series, rad: pd.Series) -> pd.Series:
            i, c = shared.value.cells_touched(unit(la.to_numpy(float), lo.to_numpy(float)), chord(rad.to_numpy(float)))
            order = np.argsort(i, kind="stable")
            return pd.Series(np.split(c[order], np.searchsorted(i[order], np.arange(1, len(la)))))

        pc = p.withColumn("cell", cell_of("plat", "plon"))
        salts = pc.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")).hint("broadcast")
        pc = pc.join(salts, "cell").withColumn("salt", F.pmod(F.xxhash64("pid", "plat", "plon", F.monotonically_increasing_id()), F.col("salts")).cast("int")).drop("salts")
        tc = t.withColumn("cell", F.explode(halo("tlat", "tlon", "trad"))).join(salts, "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

        def one(l: pd.DataFrame, rgt: pd.DataFrame) -> pd.DataFrame:
            if not len(l) or not len(rgt):
                return pd.DataFrame({"pid": l["pid"][:0], "tid": rgt["tid"][:0]})
            tla, tlo, tr = (rgt[c].to_numpy(float) for c in ("tlat", "tlon", "trad"))
            x, y = _match(l["plat"].to_numpy(float), l["plon"].to_numpy(float), tla, tlo, tr, BallTree(unit(tla, tlo), chord(tr)))
            return pd.DataFrame({"pid": l["pid"].to_numpy()[x], "tid": rgt["tid"].to_numpy()[y]})

        got = pc.groupBy("cell", "salt").cogroup(tc.groupBy("cell", "salt")).applyInPandas(one, out)
    return got.select(F.col("pid").alias(point_id), F.col("tid").alias(target_id if target_id != point_id else f"{target_id}_near"))


def sweep_contains(px: np.ndarray, py: np.ndarray, rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(point, polygon) by one plane sweep over x: edges enter at their left end and leave at their right end; at a point
    the active edges below it are counted per polygon, and an odd count means inside. Even-odd rule; an edge owns its
    left end, so points on shared borders fall into one side only. Rings may be open or closed."""
    edges = []
    for k, ring in enumerate(rings):
        a = np.asarray(ring, float)
        b = np.roll(a, -1, axis=0)
        for (x1, y1), (x2, y2) in zip(a, b):
            if x1 != x2:
                edges.append((x1, y1, x2, y2, k) if x1 < x2 else (x2, y2, x1, y1, k))
    events = sorted([(e[0], 0, i) for i, e in enumerate(edges)] + [(e[2], -1, i) for i, e in enumerate(edges)] + [(x, 1, i) for i, x in enumerate(px)])
    active: dict[int, tuple] = {}
    got_p, got_k = [], []
    for x, kind, i in events:
        if kind == 0:
            active[i] = edges[i]
        elif kind == -1:
            active.pop(i, None)
        else:
            below: dict[int, int] = {}
            for x1, y1, x2, y2, k in active.values():
                if y1 + (y2 - y1) * (x - x1) / (x2 - x1) < py[i]:
                    below[k] = below.get(k, 0) + 1
            for k, n in below.items():
                if n % 2:
                    got_p.append(i)
                    got_k.append(k)
    return np.array(got_p, int), np.array(got_k, int)


def in_polygons(points: DataFrame, polygons: dict[str, list[tuple[float, float]]], point_id: str, lat: str, lon: str, region: str = "region_id", max_polygons: int = 10_000) -> DataFrame:
    """(point_id, region) for every polygon of (lat, lon) corners that holds the point, by a plane sweep per batch of points.

    The polygons travel with the tasks, so their number is bounded by max_polygons (an error beyond it)."""
    if len(polygons) > max_polygons:
        raise ValueError(f"{len(polygons)} polygons; at most {max_polygons} can travel with each task")
    names, rings = list(polygons), [np.array([(b, a) for a, b in ring], float) for ring in polygons.values()]
    shared = points.sparkSession.sparkContext.broadcast((names, rings))
    p = points.select(F.col(point_id).alias("pid"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).filter(valid_position(F.col("la"), F.col("lo")))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rings = shared.value
        for b in batches:
            x, k = sweep_contains(b["lo"].to_numpy(float), b["la"].to_numpy(float), rings)
            if len(x):
                yield pd.DataFrame({"pid": b["pid"].to_numpy()[x], "rid": np.array(names, object)[k]})

    schema = p.select("pid").schema.add("rid", "string")
    return p.mapInPandas(local, schema).select(F.col("pid").alias(point_id), F.col("rid").alias(region))
