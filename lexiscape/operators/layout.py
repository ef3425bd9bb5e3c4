"""Layouts and drawing helpers: a neighbour-graph layout, tours, jitter, labels by zoom."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscape.session import Scratch

#: Largest multiplier-and-modulus generator step that stays exact in 64 bits.
_MODULUS = 2_147_483_647


def graph_layout(edges: DataFrame, rounds: int = 12, axes: int = 2) -> DataFrame:
    """id, c0, c1[, c2]: smooth coordinates over an undirected neighbour graph (src, dst).

    Power iteration of the lazy random walk from hashed starts: each round averages a node with its neighbours
    and takes out the constant and the earlier axes (sums over all nodes, weighted by degree), so that the axes
    go to the slowest modes of the graph. Ends are scaled to unit weighted variance. Places meet edges by sorted joins, so that
    no round sends them through the driver.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.table(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    degree = e.groupBy("src").agg(F.count("*").cast("double").alias("deg")).withColumnRenamed("src", "id")
    names = [f"c{i}" for i in range(axes)]
    now = scratch.table(degree.select("id", "deg", *(F.expr(f"(pmod(xxhash64(id, {i}), 2000003) / 1000001.5) - 1.0").alias(c) for i, c in enumerate(names))))
    for _ in range(rounds):
        near = e.join(now.select(F.col("id").alias("dst"), *names).hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(*(F.avg(c).alias(f"n_{c}") for c in names))
        step = scratch.table(now.hint("merge").join(near, "id").select("id", "deg", *(((F.col(c) + F.col(f"n_{c}")) / 2).alias(c) for c in names)))
        scratch.drop(now)
        now = _orthogonal(step, names, scratch)
        scratch.drop(step)
    return now.select("id", *names)


def _orthogonal(rows: DataFrame, names: list[str], scratch: Scratch) -> DataFrame:
    """Axes without their mean, at right angles and of unit variance, weights by degree: one row of sums."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    w = F.col("deg")
    s = rows.agg(F.sum(w).alias("w"), *(F.sum(w * F.col(c)).alias(f"m_{c}") for c in names), *(F.sum(w * F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs)).first()
    total = s["w"] or 1.0
    mean = np.array([(s[f"m_{c}"] or 0.0) / total for c in names])
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = (s[f"p_{i}_{j}"] or 0.0) / total - mean[i] * mean[j]
    try:
        turn = np.linalg.inv(np.linalg.cholesky(cov + 1e-12 * np.eye(len(names))))
    except np.linalg.LinAlgError:
        turn = np.eye(len(names))
    centred = [F.col(c) - float(m) for c, m in zip(names, mean)]
    return scratch.table(rows.select("id", "deg", *(sum((float(turn[i, j]) * centred[j] for j in range(i + 1)), F.lit(0.0)).alias(names[i]) for i in range(len(names)))))


def shortest_tour(cost: np.ndarray) -> list[int]:
    """The shortest closed tour over a few places (by subsets, for up to 15), from 0; of equal ones the smaller by number."""
    n = len(cost)
    if n > 15:
        raise ValueError("at most 15 places")
    if n < 3:
        return list(range(n))
    best = {(1 << i, i): (cost[0][i + 1], (i + 1,)) for i in range(n - 1)}
    for _ in range(n - 2):
        more: dict[tuple[int, int], tuple[float, tuple[int, ...]]] = {}
        for (seen, at), (c, path) in best.items():
            for k in range(n - 1):
                if not seen >> k & 1:
                    key, new = (seen | 1 << k, k), (c + cost[at + 1][k + 1], (*path, k + 1))
                    if key not in more or new < more[key]:
                        more[key] = new
        best = more
    return [0, *min((c + cost[at + 1][0], path) for (_, at), (c, path) in best.items())[1]]


def layout_name(**how) -> str:
    """Parameters as a file name's stem: `a1_b0.5`, in order of name; dots stay, signs and spaces go."""
    return "_".join(f"{k}{how[k]}".replace(" ", "").replace("/", "-") for k in sorted(how))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) of an integer key: two steps of a multiplicative generator, the same in any SQL."""
    a = F.pmod(key * F.lit(48_271) + F.lit(seed), F.lit(_MODULUS))
    return (F.pmod(a * F.lit(69_621), F.lit(_MODULUS)) + 1) / F.lit(float(_MODULUS + 1))


#: The same in SQL: key, seed.
SQL_UNIFORM = "((((({0})*48271+{1})%2147483647)*69621)%2147483647+1)/2147483648.0::DOUBLE"


def jitter(key: Column, sigma: float = 0.002, most: float = 0.005) -> Column:
    """A factor around 1: normal by the key (from two uniform numbers), clipped."""
    z = F.sqrt(-2 * F.log(uniform(key, 11))) * F.cos(2 * math.pi * uniform(key, 23))
    return 1 + F.greatest(F.least(z * sigma, F.lit(most)), F.lit(-most))


def nearest_pixel(rows: DataFrame, key: str, x: str, y: str, at: tuple[float, float]) -> DataFrame:
    """id, d: the point nearest to a place on the screen; ties: the smaller id."""
    d = F.sqrt(F.pow(F.col(x) - at[0], F.lit(2)) + F.pow(F.col(y) - at[1], F.lit(2)))
    return rows.select(F.col(key).alias("id"), d.alias("d")).orderBy("d", "id").limit(1)


def labels_at(places: list[tuple[str, float, float, int, int]], zoom: float, width: float = 0.08, height: float = 0.03, steps: tuple[float, ...] = (1.5, 3.0)) -> list[str]:
    """Labels to draw at a zoom, of (name, x, y, level, size): the levels that the zoom has reached, the largest first, none over another."""
    level, taken, out = sum(zoom >= s for s in steps), [], []
    for name, x, y, own, size in sorted(places, key=lambda p: (-p[4], p[0])):
        if own <= level and all(abs(x - a) * zoom >= width or abs(y - b) * zoom >= height for a, b in taken):
            taken.append((x, y))
            out.append(name)
    return out


def labels_shown(places: DataFrame, zooms: list[float], **how) -> DataFrame:
    """zoom, name: the labels that each zoom shows (`labels_at`). places: name, x, y, level, size; a zoom is a task's group, so pass the places of one map."""
    import pandas as pd

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shown = labels_at(list(pdf[["name", "x", "y", "level", "size"]].itertuples(index=False, name=None)), key[0], **how)
        return pd.DataFrame({"zoom": key[0], "name": shown})

    each = F.explode(F.array(*(F.lit(float(z)) for z in zooms))).alias("zoom")
    return places.select("name", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "level", "size", each).groupBy("zoom").applyInPandas(one, "zoom double, name string")


def label_tour(cents: DataFrame, label: str = "label") -> DataFrame:
    """label, place: the order of labels (15 at most) on the shortest closed tour over 1 - cosine of their centroids (cent)."""
    rows = cents.select(label, "cent").orderBy(label).limit(16).collect()  # a row a label
    x = np.array([r["cent"] for r in rows], float)
    tour = shortest_tour(1 - x @ x.T if len(x) else np.zeros((0, 0)))
    return cents.sparkSession.createDataFrame([(rows[i][label], place) for place, i in enumerate(tour)], f"{label} {dict(cents.dtypes)[label]}, place int")
