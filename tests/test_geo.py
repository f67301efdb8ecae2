import numpy as np
import pandas as pd

from sangam.operators.geo import _np_haversine, in_polygons, sweep_contains, within_distance


def brute(p, t):
    out = set()
    for i, la, lo in p.itertuples(index=False):
        if la is None or lo is None or not (np.isfinite(la) and np.isfinite(lo) and abs(la) <= 90 and abs(lo) <= 180):
            continue
        for j, a, o, r in t.itertuples(index=False):
            if _np_haversine(la, lo, a, o) <= r:
                out.add((i, j))
    return out


def make(seed, n, m, spread):
    g = np.random.default_rng(seed)
    p = pd.DataFrame({"id": range(n), "lat": g.uniform(-spread, spread, n), "lon": g.uniform(-2 * spread, 2 * spread, n)})
    p.loc[: n // 3, ["lat", "lon"]] = [0.1, 0.1]  # a third of all points in one place
    p.loc[n - 5 :, "lat"] = [np.nan, np.inf, 95.0, -91.0, 0.0]
    t = pd.DataFrame({"tid": range(m), "lat": g.uniform(-spread, spread, m), "lon": g.uniform(-2 * spread, 2 * spread, m), "radius_m": g.uniform(0, 400_000, m)})
    return p, t


def test_within_distance_by_broadcast_and_by_shuffle(spark):
    p, t = make(1, 400, 90, 80)
    want = brute(p, t)
    for limit in (1000, 10):
        got = within_distance(spark.createDataFrame(p), spark.createDataFrame(t), "id", "tid", max_broadcast_targets=limit, salt_rows=50)
        got = [tuple(r) for r in got.collect()]
        assert set(got) == want and len(got) == len(want)


def test_near_the_poles_and_the_date_line(spark):
    p = pd.DataFrame({"id": [1, 2, 3], "lat": [89.9, 0.0, -89.9], "lon": [179.0, -179.99, 10.0]})
    t = pd.DataFrame({"tid": [1, 2, 3], "lat": [89.9, 0.0, -90.0], "lon": [-1.0, 179.99, 0.0], "radius_m": [30_000.0, 3_000.0, 12_000.0]})
    got = {tuple(r) for r in within_distance(spark.createDataFrame(p), spark.createDataFrame(t), "id", "tid").collect()}
    assert got == brute(p, t) == {(1, 1), (2, 2), (3, 3)}


def test_empty_tables(spark):
    p, t = make(2, 20, 5, 10)
    none = spark.createDataFrame([], "tid long, lat double, lon double, radius_m double")
    assert within_distance(spark.createDataFrame(p), none, "id", "tid").count() == 0
    assert within_distance(spark.createDataFrame(p).limit(0), spark.createDataFrame(t), "id", "tid").count() == 0


def inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0)):
        if (x1 <= x < x2 or x2 <= x < x1) and y1 + (y2 - y1) * (x - x1) / (x2 - x1) < y:
            odd = not odd
    return odd


def test_plane_sweep(spark):
    g = np.random.default_rng(3)
    rings = []
    for _ in range(12):
        c, n = g.uniform(-5, 5, 2), g.integers(3, 9)
        a = np.sort(g.uniform(0, 2 * np.pi, n))
        rings.append(np.stack([c[0] + g.uniform(1, 4) * np.cos(a), c[1] + g.uniform(1, 4) * np.sin(a)], axis=1))
    x, y = g.uniform(-8, 8, 300), g.uniform(-8, 8, 300)
    got = set(zip(*map(list, sweep_contains(x, y, rings))))
    assert got == {(i, k) for i in range(300) for k, r in enumerate(rings) if inside(x[i], y[i], r)}
    d = spark.createDataFrame(pd.DataFrame({"id": range(300), "lat": y, "lon": x}))
    polys = {str(k): [(b, a) for a, b in r] for k, r in enumerate(rings)}
    assert {(r["id"], int(r["region_id"])) for r in in_polygons(d, polys, "id", "lat", "lon").collect()} == got
