"""Floods in tiles against a plain priority flood."""

import heapq

import numpy as np
import pandas as pd
import pytest

from lexiscape.operators import terrain


def plain_flood(height, neighbours, peaks, floor):
    """Pops the highest reached cell (ties: the smaller id); a cell belongs to who reaches it first."""
    label, heap = dict(peaks), [(-height[i], i) for i in dict(peaks)]
    heapq.heapify(heap)
    while heap:
        _, i = heapq.heappop(heap)
        for j in neighbours(i):
            if j not in label and height[j] > floor:
                label[j] = label[i]
                heapq.heappush(heap, (-height[j], j))
    return label


def hills(w, h, seed, peaks=40, rough=0.02):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    v = sum(a * np.exp(-(((x - cx) ** 2 + (y - cy) ** 2) / (2 * s * s))) for a, cx, cy, s in zip(rng.uniform(0.2, 1, peaks), rng.uniform(0, w, peaks), rng.uniform(0, h, peaks), rng.uniform(w / 40, w / 10, peaks)))
    return v + rng.uniform(0, rough, v.shape)  # many summits that are no marked peaks


def sides(w, h):
    def near(i):
        y, x = divmod(i, 1 << 31)
        return [(y + b) * (1 << 31) + x + a for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + a < w and 0 <= y + b < h]

    return near


def compare(spark, v, radius=5):
    h, w = v.shape
    pdf = pd.DataFrame({"ix": np.tile(np.arange(w), h), "iy": np.repeat(np.arange(h), w), "v": v.ravel()})
    field = spark.createDataFrame(pdf)
    peaks = terrain.box_peaks(field, radius, 0.2).toPandas()
    got = terrain.watershed(field, spark.createDataFrame(peaks), 0.05).toPandas().sort_values(["iy", "ix"])
    key = lambda x, y: int(y) * (1 << 31) + int(x)
    height = {key(x, y): z for x, y, z in zip(pdf.ix, pdf.iy, pdf.v)}
    want = plain_flood(height, sides(w, h), [(key(x, y), r) for x, y, r in zip(peaks.ix, peaks.iy, peaks.region)], 0.05 * v.max())
    assert got.region.tolist() == [want.get(key(x, y), 0) for y in range(h) for x in range(w)]
    return len(peaks), got.region.nunique()


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tiles(spark, monkeypatch, seed):
    monkeypatch.setattr(terrain, "TILE", 64)  # 8 by 8 cells
    peaks, regions = compare(spark, np.round(hills(40, 30, seed, 8), 2 if seed == 2 else 9), 4)  # with plateaus, and without
    assert peaks > 3 and regions > 3


def test_full_raster(spark):
    peaks, regions = compare(spark, hills(640, 640, 3), 12)
    assert regions > 10


def test_full_sphere(spark):
    n, sigma = 150_000, 0.15
    grid, rng = terrain.nodes(n), np.random.default_rng(4)
    top = terrain.nodes(60)
    v = np.zeros(n)
    for t, a in zip(top, rng.uniform(0.2, 1, 60)):
        v += a * np.exp(-(np.arccos(np.clip(grid @ t, -1, 1)) ** 2) / (2 * 0.12**2))
    v = v * rng.uniform(0.9, 1, n)
    got = terrain.sphere_regions(spark.createDataFrame(pd.DataFrame({"node": np.arange(n), "v": v})), n, sigma).toPandas().sort_values("node")
    near = terrain.sphere_neighbours(spark, n).toPandas().sort_values(["i", "j"]).j.to_numpy().reshape(n, 8)
    ref = np.quantile(v, 0.99)
    able = np.flatnonzero((v >= v[near].max(axis=1)) & (v >= 0.03 * ref))
    peaks = [i for i in able[np.lexsort((able, -v[able]))] if v[i] >= v[grid @ grid[i] >= np.cos(sigma)].max()]
    rows = near.tolist()
    want = plain_flood(dict(enumerate(v.tolist())), lambda i: rows[i], [(int(i), r + 1) for r, i in enumerate(peaks)], 0.005 * ref)
    assert got.region.tolist() == [want.get(i, 0) for i in range(n)] and len(peaks) > 30
