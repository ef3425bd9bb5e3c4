"""Density fields on a grid, their peaks, floods and regions; the same on a sphere."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiscape.operators.graph import followed
from lexiscape.operators.layout import uniform
from lexiscape.operators.mapserve import dense_id
from lexiscape.operators.ranks import quantile_values
from lexiscape.session import Scratch


def cell(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of x; the last bin holds its right edge."""
    return F.greatest(F.lit(0), F.least(F.floor((x - lo) / (hi - lo) * n), F.lit(n - 1))).cast("int")


def histogram2d(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], nx: int, ny: int, *by: str) -> DataFrame:
    """[by,] ix, iy, v: points a cell, inside the box."""
    x0, x1, y0, y1 = box
    inside = points.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(*by, cell(F.col(x), x0, x1, nx).alias("ix"), cell(F.col(y), y0, y1, ny).alias("iy")).agg(F.count("*").cast("double").alias("v"))


def extent(points: DataFrame, x: str, y: str, margin: float = 0.5, nx: int = 640) -> tuple[tuple[float, float, float, float], int, int]:
    x0, x1, y0, y1 = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    box = (x0 - margin, x1 + margin, y0 - margin, y1 + margin)
    return box, nx, max(1, round(nx * (box[3] - box[2]) / (box[1] - box[0])))


def gaussian(sigma: float, truncate: float = 4.0) -> list[float]:
    """Weights at offsets -r .. r."""
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _reflected(i: Column, n: int) -> Column:
    """Index reflected at the borders, the border cell repeated."""
    p = F.pmod(i, F.lit(2 * n))
    return F.when(p >= n, 2 * n - 1 - p).otherwise(p)


def smooth(field: DataFrame, sigma_x: float, sigma_y: float, nx: int, ny: int, *by: str) -> DataFrame:
    """Separable Gaussian smoothing: every cell gives to its neighbours along x, then along y.

    A reflecting border receives what its mirror images give, so sums are kept.
    """
    for axis, sigma, n in (("ix", sigma_x, nx), ("iy", sigma_y, ny)):
        w = gaussian(sigma)
        r = len(w) // 2
        offsets = F.explode(F.array(*(F.struct(F.lit(i - r).alias("d"), F.lit(x).alias("w")) for i, x in enumerate(w))))
        spread = field.withColumn("o", offsets).withColumn(axis, _reflected(F.col(axis) + F.col("o.d"), n).cast("int")).withColumn("v", F.col("v") * F.col("o.w"))
        field = spread.groupBy(*by, "ix", "iy").agg(F.sum("v").alias("v"))
    return field


def shares(points: DataFrame, group: str, field: DataFrame) -> DataFrame:
    """A field of counts as shares of each group's total."""
    n = points.groupBy(group).agg(F.count("*").alias("_n"))
    return field.join(n, group).withColumn("v", F.col("v") / F.col("_n")).drop("_n")


def half_split_noise(points: DataFrame, key: str, field, splits: int = 4) -> DataFrame:
    """ix, iy, sd = sqrt(mean((a - b)^2) / 4) over `splits` halvings by a number of the (integer) key. field: points -> ix, iy, v (shares)."""
    out = None
    for i in range(splits):
        half = uniform(F.col(key), i) < 0.5
        a, b = field(points.where(half)).withColumnRenamed("v", "a"), field(points.where(~half)).withColumnRenamed("v", "b")
        d = a.join(b, ["ix", "iy"], "full").select("ix", "iy", F.pow(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), F.lit(2)).alias("d"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("ix", "iy").agg(F.sqrt(F.sum("d") / splits / 4).alias("sd"))


def contrast(target: DataFrame, rest: DataFrame, noise_target: DataFrame | None = None, noise_rest: DataFrame | None = None) -> DataFrame:
    """ix, iy, diff[, significant]: difference of two share fields, marked where it exceeds twice its noise."""
    out = target.withColumnRenamed("v", "a").join(rest.withColumnRenamed("v", "b"), ["ix", "iy"], "full").select("ix", "iy", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    out = out.withColumn("diff", F.col("a") - F.col("b"))
    if noise_target is None:
        return out
    out = out.join(noise_target.withColumnRenamed("sd", "sa"), ["ix", "iy"], "left").join(noise_rest.withColumnRenamed("sd", "sb"), ["ix", "iy"], "left")
    sd = F.sqrt(F.pow(F.coalesce("sa", F.lit(0.0)), F.lit(2)) + F.pow(F.coalesce("sb", F.lit(0.0)), F.lit(2)))
    return out.select("ix", "iy", "a", "b", "diff", (F.abs("diff") > 2 * sd).alias("significant"))


def total_variation(fields: DataFrame) -> DataFrame:
    """tv of two fields a, b."""
    return fields.agg((0.5 * F.sum(F.abs(F.col("a") - F.col("b"))) / F.sum("b")).alias("tv"))


def anomaly(fields: DataFrame, year: str = "year") -> DataFrame:
    """year, ix, iy, diff: share minus its mean over years (absent cells count as zero)."""
    years = fields.select(year).distinct().count()
    mean = fields.groupBy("ix", "iy").agg((F.sum("v") / years).alias("m"))
    grid = mean.withColumn(year, F.explode(F.array(*(F.lit(r[year]) for r in fields.select(year).distinct().collect()))))  # a row a year
    return grid.join(fields, [year, "ix", "iy"], "left").select(year, "ix", "iy", (F.coalesce("v", F.lit(0.0)) - F.col("m")).alias("diff"))


def change(fields: DataFrame, early: tuple[int, int], late: tuple[int, int], year: str = "year") -> DataFrame:
    """ix, iy, diff: mean of late years minus mean of early ones."""
    mean = lambda y: F.sum(F.when(F.col(year).between(*y), F.col("v")).otherwise(0.0)) / float(y[1] - y[0] + 1)
    return fields.groupBy("ix", "iy").agg((mean(late) - mean(early)).alias("diff"))


def blended(fields: DataFrame, hold: int = 5, blend: int = 12, year: str = "year") -> DataFrame:
    """frame, year, next, ix, iy, v: each year stands for `hold` frames, then goes over to the next one in `blend` even steps."""
    years = sorted(r[year] for r in fields.select(year).distinct().collect())  # a row a year
    frames, at = [], 0
    for i, y in enumerate(years):
        frames += [(at + j, y, None, 0.0) for j in range(hold)]
        at += hold
        if i + 1 < len(years):
            frames += [(at + j, y, years[i + 1], (j + 1) / (blend + 1)) for j in range(blend)]
            at += blend
    kind = fields.schema[year].dataType.simpleString()
    plan = F.broadcast(fields.sparkSession.createDataFrame(frames, f"frame int, year {kind}, next {kind}, t double"))
    own = fields.select(F.col(year).alias("y"), "ix", "iy", "v")
    one = own.join(plan, F.col("y") == F.col("year")).select("frame", "year", "next", "ix", "iy", (F.col("v") * (1 - F.col("t"))).alias("v"))
    two = own.join(plan, F.col("y") == F.col("next")).select("frame", "year", "next", "ix", "iy", (F.col("v") * F.col("t")).alias("v"))
    return one.unionByName(two).groupBy("frame", "year", "next", "ix", "iy").agg(F.sum("v").alias("v"))


def masked_anomaly(fields: DataFrame, noise: DataFrame, base: str = "mean", sigmas: float = 2.0, year: str = "year") -> DataFrame:
    """year, ix, iy, diff, significant: share less its mean over years (or less the first year's), against `sigmas` standard
    deviations of both. noise: year, ix, iy, var; the variance of a mean over n years is the sum of theirs over n * n.
    """
    years = sorted(r[year] for r in fields.select(year).distinct().collect())  # a row a year
    both = fields.join(noise, [year, "ix", "iy"], "full").select(year, "ix", "iy", F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("var", F.lit(0.0)).alias("var"))
    of = F.lit(True) if base == "mean" else F.col(year) == years[0]
    n = float(len(years)) if base == "mean" else 1.0
    low = both.groupBy("ix", "iy").agg((F.sum(F.when(of, F.col("v")).otherwise(0.0)) / n).alias("m"), (F.sum(F.when(of, F.col("var")).otherwise(0.0)) / (n * n)).alias("mv"))
    grid = low.withColumn(year, F.explode(F.array(*map(F.lit, years))))
    out = grid.join(both, [year, "ix", "iy"], "left")
    diff, var = F.coalesce("v", F.lit(0.0)) - F.col("m"), F.coalesce("var", F.lit(0.0)) + F.col("mv")
    return out.select(year, "ix", "iy", diff.alias("diff"), (F.abs(diff) > sigmas * F.sqrt(var)).alias("significant"))


def box_peaks(field: DataFrame, radius: int, share: float = 0.0, n: int | None = None) -> DataFrame:
    """region, ix, iy, height: positive cells that are the largest of their box (ties: first by iy, ix)."""
    best = F.struct("v", (-F.col("iy")).alias("a"), (-F.col("ix")).alias("b"))
    top = field.agg(F.max("v")).first()[0] or 0.0
    cand = field.where((F.col("v") > 0) & (F.col("v") >= share * top)).withColumn("s", best)
    span = F.sequence(F.lit(-radius), F.lit(radius))
    row = cand.withColumn("d", F.explode(span)).groupBy((F.col("ix") + F.col("d")).alias("ix"), "iy").agg(F.max("s").alias("m"))
    full = row.withColumn("d", F.explode(span)).groupBy("ix", (F.col("iy") + F.col("d")).alias("iy")).agg(F.max("m").alias("m"))
    out = cand.join(full, ["ix", "iy"]).where("s = m").select("ix", "iy", F.col("v").alias("height"))
    out = out.withColumn("region", F.row_number().over(Window.orderBy(F.desc("height"), "iy", "ix")))  # peaks only
    return (out.where(F.col("region") <= n) if n else out).select("region", "ix", "iy", "height")


#: Cells of a tile that a task floods at once (aimed at).
TILE = 1 << 14


def _rise(key: tuple, cells: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Floods a tile from its own marked cells and from what has reached its border: id, b, moved."""
    cells = cells.sort_values("id")
    ids, rank, level = cells.id.to_numpy(), cells["rank"].to_numpy(), cells.b.to_numpy().copy()
    before, heap = level.copy(), []
    to = np.searchsorted(ids, edges.j.to_numpy())
    inside = (edges.tile_i == key[0]).to_numpy()
    come = np.minimum(rank[to[~inside]], edges.bi.to_numpy()[~inside])
    np.maximum.at(level, to[~inside], come)
    start = (level > before) | (cells.fresh.to_numpy() & (level >= 0))
    frm, dst = np.searchsorted(ids, edges.i.to_numpy()[inside]), to[inside]
    order = np.argsort(frm, kind="stable")
    frm, dst = frm[order], dst[order]
    first = np.searchsorted(frm, np.arange(len(ids) + 1))
    reach, tops, near = level.tolist(), rank.tolist(), dst.tolist()
    heap = [(-reach[i], i) for i in np.flatnonzero(start).tolist()]
    heapq.heapify(heap)
    first = first.tolist()
    while heap:
        b, i = heapq.heappop(heap)
        if -b < reach[i]:
            continue
        for j in near[first[i] : first[i + 1]]:
            c = min(tops[j], -b)
            if c > reach[j]:
                reach[j] = c
                heapq.heappush(heap, (-c, j))
    level = np.array(reach, np.int64)
    return pd.DataFrame({"id": ids, "b": level, "moved": level > before})


def flooded(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """id, region (0: not reached): a priority flood from marked cells, highest first (equal heights: the smaller id), in tiles.

    cells: id, height, region (of a marked cell, else null), tile; edges: i, j, where the flood may go from i to j.
    First the level at which the flood reaches each cell: the lowest cell of the best way from a marked one. A task floods a tile from
    what has reached its border, and rounds go on until no border rises; no task holds more than a tile. Then each cell points to where its flood
    came from (its neighbour that was reached first, or, behind a pass, the pass), and pointers are followed to their marked cells.
    """
    scratch = Scratch(cells.sparkSession)
    c = scratch.table(dense_id(cells.withColumn("k", F.struct("height", (-F.col("id")).alias("m"))), "k", "rank").select("id", "rank", "region", "tile"))
    ends = lambda p: c.select(F.col("id").alias(p), F.col("tile").alias(f"tile_{p}"))
    e = scratch.table(edges.select("i", "j").join(ends("i"), "i").join(ends("j"), "j"))
    crossed = e.where("tile_i <> tile_j").limit(1).count()
    now = scratch.table(c.select("id", "rank", "tile", F.when(F.col("region").isNotNull(), F.col("rank")).otherwise(-1).alias("b"), F.lit(True).alias("fresh")))
    while True:
        border = e.where("tile_i <> tile_j").join(now.where("b >= 0").select(F.col("id").alias("i"), F.col("b").alias("bi")), "i").select("i", "j", "tile_i", "tile_j", "bi")
        own = e.where("tile_i = tile_j").select("i", "j", "tile_i", "tile_j", F.lit(-1).cast("long").alias("bi"))
        got = now.groupBy("tile").cogroup(border.unionByName(own).groupBy("tile_j")).applyInPandas(_rise, "id long, b long, moved boolean")
        after = scratch.table(got.join(c.select("id", "rank", "tile"), "id").select("id", "rank", "tile", "b", F.lit(False).alias("fresh"), "moved"))
        scratch.drop(now)
        now = after.drop("moved")
        now._scratch = after._scratch
        if not crossed or not after.where("moved").limit(1).count():
            break
    first = e.join(now.where("b >= 0").select(F.col("id").alias("i"), "b"), "i").groupBy(F.col("j").alias("id")).agg(F.max(F.struct("b", "i")).alias("x"))
    at = now.where("b >= 0").join(c.where("region is not null").select("id", "region"), "id", "left")
    marked = at.where("region is not null").select(F.col("id").alias("c"), F.col("id").alias("o"))
    shore = at.where("region is null and b = rank").join(first, "id").select(F.col("id").alias("c"), F.col("x.i").alias("o"))
    behind = at.where("region is null and b < rank").select(F.col("id").alias("c"), "b").join(c.select(F.col("rank").alias("b"), F.col("id").alias("o")), "b").select("c", "o")
    root = followed(marked.unionByName(shore).unionByName(behind), scratch)
    named = root.join(c.where("region is not null").select(F.col("id").alias("root"), "region"), "root")
    return c.select("id").join(named.select(F.col("c").alias("id"), "region"), "id", "left").select("id", F.coalesce("region", F.lit(0)).alias("region"))


def watershed(field: DataFrame, peaks: DataFrame, mask: float = 0.005) -> DataFrame:
    """ix, iy, region (0: sea): cells over the mask (a share of the highest) by the peak whose flood, over the four sides of cells, reaches them first."""
    scratch, side = Scratch(field.sparkSession), int(TILE**0.5)
    top = field.agg(F.max("v")).first()[0] or 0.0
    wide = F.col("iy").cast("long") * F.lit(1 << 31) + F.col("ix")
    tops = peaks.select("ix", "iy", "region")
    cells = scratch.table(field.select("ix", "iy", "v").join(tops, ["ix", "iy"], "left").where((F.col("v") > mask * top) | F.col("region").isNotNull()).select(wide.alias("id"), F.col("v").alias("height"), "region", F.xxhash64(F.floor(F.col("ix") / side), F.floor(F.col("iy") / side)).alias("tile")))
    edges = cells.select(F.col("id").alias("i"), F.explode(F.array(*(F.col("id") + s for s in (1, -1, 1 << 31, -(1 << 31))))).alias("j"))
    label = flooded(cells, edges)
    return field.select("ix", "iy", wide.alias("id")).join(label, "id", "left").select(F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), F.coalesce("region", F.lit(0)).cast("int").alias("region"))


def assigned(points: DataFrame, regions: DataFrame, field: DataFrame, peaks: DataFrame, key: str = "id") -> DataFrame:
    """id, region, wt: density at the point over that at its own peak (the sea: over 1)."""
    out = points.join(regions, ["ix", "iy"], "left").join(field, ["ix", "iy"], "left").join(peaks.select("region", "height"), "region", "left")
    return out.select(key, F.coalesce("region", F.lit(0)).alias("region"), (F.coalesce("v", F.lit(0.0)) / F.coalesce("height", F.lit(1.0))).alias("wt"))


def local_density(edges: DataFrame, k: int, dimension: int, arc: bool = False) -> DataFrame:
    """id, density = 1 / r_k ** dimension; arc: distances are chords of the unit sphere, and r is the angle over the k-th."""
    r = 2 * F.asin(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("dist") / 2))) if arc else F.col("dist")
    return edges.where((F.col("rank") == k) & (F.col("dist") > 0)).select(F.col("src").alias("id"), (1 / F.pow(r, F.lit(float(dimension)))).alias("density"))


def entropy(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Entropy of a histogram on [0, 1]."""
    h = rows.groupBy(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy())
    return h.select(p.alias("p")).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


# --- sphere -----------------------------------------------------------------------------------


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """node, x, y, z: nodes spread evenly over the sphere."""
    i = F.col("id").cast("double")
    z = 1 - (2 * i + 1) / F.lit(float(n))
    turn = i * F.lit(math.pi * (3 - math.sqrt(5)))
    r = F.sqrt(1 - z * z)
    return spark.range(n).select(F.col("id").alias("node"), (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), z.alias("z"))


def nodes(n: int) -> np.ndarray:
    i = np.arange(n)
    z = 1 - (2 * i + 1) / n
    t, r = i * math.pi * (3 - math.sqrt(5)), np.sqrt(1 - z * z)
    return np.stack([r * np.cos(t), r * np.sin(t), z], axis=1)


def nearest_node(points: DataFrame, n: int, key: str = "id") -> DataFrame:
    """id, node: the grid node of largest dot product; the grid is computed in each task."""

    def each(batches):
        grid = nodes(n)
        for pdf in batches:
            x = pdf[["x", "y", "z"]].to_numpy()
            at = np.concatenate([(x[i : i + 256] @ grid.T).argmax(axis=1) for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, int)
            yield pd.DataFrame({key: pdf[key], "node": at})

    return points.select(key, "x", "y", "z").mapInPandas(each, f"{key} long, node long")


def sphere_edges(spark: SparkSession, n: int, reach: float, own: DataFrame | None = None) -> DataFrame:
    """i, j, cos for nodes i (all, or those of `own`: node) and j within an angle, by cells of the angle's size and their neighbours."""
    g = fibonacci(spark, n)
    size = 2 * math.sin(reach / 2)
    at = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"]
    few = (g if own is None else g.join(own.select("node"), "node")).select("*", *at)
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    wide = g.select("*", *at).select(F.col("node").alias("j"), *(F.col(c).alias(f"j{c}") for c in "xyz"), *(F.col(f"c{c}") for c in "xyz"))
    for c in "xyz":
        few = few.withColumn("s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
    cos = F.least(F.lit(1.0), F.col("x") * F.col("jx") + F.col("y") * F.col("jy") + F.col("z") * F.col("jz"))
    return few.join(wide, ["cx", "cy", "cz"]).select(F.col("node").alias("i"), "j", cos.alias("cos")).where(F.col("cos") >= math.cos(reach))


def sphere_neighbours(spark: SparkSession, n: int, k: int = 8) -> DataFrame:
    """i, j: the k nearest other nodes; ties: the smaller node."""
    reach = min(math.pi / 2, 2 * math.sqrt((4 * k + 16) / n))  # some four times as many nodes
    near = sphere_edges(spark, n, reach).where("i <> j")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("cos"), "j"))).where(F.col("r") <= k).select("i", "j")


def sphere_smooth(counts: DataFrame, edges: DataFrame, sigma: float, steps: int = 1) -> DataFrame:
    """node, v: Gaussian weights of the angle, `steps` times (an angle of sigma * sqrt(steps))."""
    w = edges.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.exp(-0.5 * F.pow(F.acos("cos") / sigma, F.lit(2)))).alias("w"))
    for _ in range(steps):
        counts = w.join(counts.withColumnRenamed("node", "j"), "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return counts


def sphere_regions(field: DataFrame, n: int, sigma: float, share: float = 0.03, mask: float = 0.005, occupied: DataFrame | None = None) -> DataFrame:
    """node, region: peaks that are at least their 8 neighbours and every node within sigma, flooded over the 8-neighbour graph.

    Levels are shares of the field's 0.99 quantile over the nodes that hold rows (occupied: node; all with mass where not given).
    Regions are numbered by height (equal ones: the smaller node).
    """
    spark = field.sparkSession
    scratch = Scratch(spark)
    v = scratch.table(field.groupBy("node").agg(F.sum("v").alias("v")).where("v > 0"))
    held = v if occupied is None else occupied.select("node").distinct().join(v, "node", "left").fillna(0.0, ["v"])
    ref = quantile_values(held.select("v"), "v", 0.99)[0] or 0.0
    near = scratch.table(sphere_neighbours(spark, n))
    higher = lambda pairs, rows: pairs.join(v.select(F.col("node").alias("j"), F.col("v").alias("vj")), "j").join(rows.select(F.col("node").alias("i"), "v"), "i").where("vj > v").select(F.col("i").alias("node"))
    able = scratch.table(v.where(F.col("v") >= share * ref))
    able = scratch.table(able.join(higher(near, able), "node", "left_anti"))
    peaks = able.join(higher(sphere_edges(spark, n, sigma, able), able), "node", "left_anti")
    peaks = peaks.withColumn("region", F.row_number().over(Window.orderBy(F.desc("v"), "node")))  # a row a peak
    cells = v.join(peaks.select("node", "region"), "node", "left").where((F.col("v") > mask * ref) | F.col("region").isNotNull())
    label = flooded(cells.select(F.col("node").alias("id"), F.col("v").alias("height"), "region", F.shiftright("node", int(math.log2(TILE))).alias("tile")), near)
    return spark.range(n).select(F.col("id").alias("node")).join(label.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("region", F.lit(0)).cast("int").alias("region"))


#: Points that meet their centres at once.
BLOCK = 512


def _halves(x: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Some points, cut at the median of the axis in which they are spread the most."""
    own = x[at]
    order = np.argpartition(own[:, np.ptp(own, axis=0).argmax()], len(at) // 2)
    return [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, added up axis by axis."""
    return sum((np.subtract.outer(x[:, i], y[:, i]) ** 2 for i in range(1, x.shape[1])), np.subtract.outer(x[:, 0], y[:, 0]) ** 2)


def _ball(own: np.ndarray) -> tuple[np.ndarray, float]:
    """Middle of some points' box, and the distance from it to the farthest of them."""
    mid = (own.min(axis=0) + own.max(axis=0)) / 2
    return mid, math.sqrt(_squares(mid[None], own).max())


def nearest_centre(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point (ties: the first one), and the square of its distance; exact, without meeting all pairs.

    Points are halved, and a part keeps the centres that may be nearest to one of its points: those no farther from its middle than the nearest one there and twice its radius.
    """
    to, cost = np.zeros(len(x), int), np.zeros(len(x))
    todo = [(np.arange(len(x)), np.sort(np.unique(centre, axis=0, return_index=True)[1]))] if len(x) else []
    while todo:
        at, few = todo.pop()
        own = x[at]
        if len(few) > 1:
            mid, radius = _ball(own)
            away = np.sqrt(_squares(mid[None], centre[few])[0])
            few = few[~(away > (away.min() + 2 * radius) * (1 + 1e-9))]
            if radius == 0:  # copies
                own = own[:1]
            elif len(at) > BLOCK or len(few) > BLOCK and len(at) > 16:
                todo += [(half, few) for half in _halves(x, at)]
                continue
        d = _squares(own, centre[few])
        best = d.argmin(axis=1)
        to[at], cost[at] = few[best], d[np.arange(len(own)), best]
    return to, cost


def spread_starts(x: np.ndarray, k: int, draws: list[np.random.Generator]) -> list[np.ndarray]:
    """k-means++: the indices of k points a generator, each drawn by its squared distance from those before.

    Points lie in blocks, and a new centre meets those that it may be nearer to than what they have; a tree of sums, 16 a node, is drawn from.
    """
    todo, blocks = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            blocks.append(at)
        else:
            todo += _halves(x, at)
    balls = [_ball(x[at]) for at in blocks]
    mid, radius = np.array([m for m, _ in balls]), np.array([r for _, r in balls])
    out = []
    for rng in draws:
        found = [int(rng.integers(len(x)))]
        far = _squares(x[found], x)[0]
        top = np.array([far[at].max() for at in blocks])
        sums = [np.append(far, np.zeros(-len(far) % 16))]
        while len(sums[-1]) > 16:
            up = sums[-1].reshape(-1, 16).sum(axis=1)
            sums.append(np.append(up, np.zeros(-len(up) % 16)))
        far = sums[0]
        while len(found) < k:
            total, i = sums[-1].sum(), 0
            if total > 0:
                left = rng.random() * total
                for level in reversed(sums):
                    upto = level[16 * i : 16 * i + 16].cumsum()
                    j = min(int(upto.searchsorted(left, side="right")), int(np.flatnonzero(level[16 * i : 16 * i + 16])[-1]))
                    left, i = left - (upto[j - 1] if j else 0.0), 16 * i + j
            else:
                i = int(rng.integers(len(x)))
            found.append(i)
            gap = np.maximum(np.sqrt(_squares(x[i : i + 1], mid)[0]) - radius * (1 + 1e-9), 0.0)
            moved = []
            for b in np.flatnonzero(gap * gap * (1 - 1e-9) < top):
                at = blocks[b]
                d = _squares(x[i : i + 1], x[at])[0]
                less = d < far[at]
                moved.append(at[less])
                far[at[less]] = d[less]
                top[b] = far[at].max()
            at = np.concatenate(moved) if moved else np.zeros(0, int)
            for low, high in zip(sums, sums[1:]):
                at = np.unique(at // 16)
                high[at] = low.reshape(-1, 16)[at].sum(axis=1)
        out.append(np.array(found))
    return out


def split_regions(points: DataFrame, regions: DataFrame, limit: int, key: str = "id", starts: int = 4, rounds: int = 20) -> DataFrame:
    """id, region, sector: regions of over `limit` points are cut by k-means into ceil(n / limit); sector = region * 1000 + c + 1
    (where a region has 1000 parts or more: times the next power of ten above the most parts).

    All regions and starts go on together: a round is one job, which adds up each centre's points in the tasks. Points lie in order of region and
    cell, so that a task meets few centres, of which a point meets those near by. Starts are
    k-means++ on a hashed sample of about SEEDS points a centre; of a region's starts the cheapest stays. Tasks are sent the centres (starts
    for every `limit` points), sums come back a row a centre.
    """
    spark = points.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(points.join(regions, key).select(key, F.col("region").cast("long").alias("region"), "x", "y", "z"))
    ends = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))]
    large = rows.groupBy("region").agg(F.count("*").alias("n"), *ends).where(F.col("n") > limit).collect()  # a row a region
    parts = {r["region"]: -(-r["n"] // limit) for r in large}
    most = max(parts.values(), default=1)
    step = 1000 if most < 1000 else 10 ** len(str(most))
    whole = rows.where(~F.col("region").isin(list(parts) or [-1])).select(key, "region", (F.col("region") * step + 1).alias("sector"))
    if not parts:
        return whole
    side = lambda r, c: ((r[f"{c}1"] - r[f"{c}0"]) / max(1, round(math.sqrt(r["n"] / CELL)))) or 1.0
    shares = spark.createDataFrame([(r["region"], min(1.0, SEEDS * parts[r["region"]] / r["n"]), parts[r["region"]], *(v for c in "xyz" for v in (r[f"{c}0"], side(r, c)))) for r in large], "region long, share double, parts int, x0 double, xw double, y0 double, yw double, z0 double, zw double")
    near = [F.floor((F.col(c) - F.col(f"{c}0")) / F.col(f"{c}w")) for c in "xyz"]
    own = rows.join(F.broadcast(shares), "region").repartitionByRange("region", *near, key).sortWithinPartitions("region", *near)  # a row a region
    own = scratch.table(own.select(key, "region", "x", "y", "z", "share", "parts"))

    def seeded(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x, k, region = pdf[["x", "y", "z"]].to_numpy(), int(pdf.parts.iloc[0]), int(pdf.region.iloc[0])
        found = spread_starts(x, k, [np.random.default_rng([s, region]) for s in range(starts)])
        return pd.DataFrame([(region, s, c, *x[i]) for s, own in enumerate(found) for c, i in enumerate(own)], columns=["region", "start", "c", "x", "y", "z"])

    sample = own.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.col("share") * 1_000_003)
    seeds = sample.groupBy("region").applyInPandas(seeded, "region long, start int, c int, x double, y double, z double").toLocalIterator()
    centre = {r: np.zeros((starts, k, 3)) for r, k in parts.items()}
    for s in seeds:
        centre[s["region"]][s["start"], s["c"]] = s["x"], s["y"], s["z"]

    def totals(batches, sent):
        for pdf in batches:
            out = []
            for r, part in pdf.groupby("region"):
                x = part[["x", "y", "z"]].to_numpy()
                for s, c in enumerate(sent.value[r]):
                    to, cost = nearest_centre(x, c)
                    used, at = np.unique(to, return_inverse=True)
                    out.append(np.stack([np.full(len(used), r), np.full(len(used), s), used, np.bincount(at), *(np.bincount(at, v) for v in (*x.T, cost))], axis=1))
            if out:
                yield pd.DataFrame(np.concatenate(out), columns=["region", "start", "c", "n", "sx", "sy", "sz", "cost"]).astype({"region": int, "start": int, "c": int})

    cost: dict[tuple[int, int], float] = {}
    for i in range(rounds + 1):
        sent = spark.sparkContext.broadcast(centre)
        got = own.mapInPandas(lambda batches: totals(batches, sent), "region long, start int, c int, n double, sx double, sy double, sz double, cost double")
        cost, before = {}, cost
        new = {r: c.copy() for r, c in centre.items()}
        for t in got.groupBy("region", "start", "c").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sz", "cost"))).toLocalIterator():
            new[t["region"]][t["start"], t["c"]] = np.array([t["sx"], t["sy"], t["sz"]]) / t["n"]
            cost[t["region"], t["start"]] = cost.get((t["region"], t["start"]), 0.0) + t["cost"]
        sent.destroy()
        if i == rounds or before and all(before[k] - v <= 1e-4 * v for k, v in cost.items()):
            break
        centre = new
    best = spark.sparkContext.broadcast({r: c[min(range(starts), key=lambda s: (cost[r, s], s))] for r, c in centre.items()})

    def assigned(batches):
        for pdf in batches:
            to = np.zeros(len(pdf), int)
            for r in pdf.region.unique():
                at = (pdf.region == r).to_numpy()
                to[at] = nearest_centre(pdf.loc[at, ["x", "y", "z"]].to_numpy(), best.value[r])[0]
            yield pd.DataFrame({key: pdf[key], "region": pdf.region, "sector": pdf.region * step + to + 1})

    return whole.unionByName(own.mapInPandas(assigned, f"{key} {dict(rows.dtypes)[key]}, region long, sector long"))


#: Points a centre that starts are chosen from.
SEEDS = 64

#: Points of a cell (aimed at) by which the points of a region are put in order.
CELL = 4096


def ocean(points: DataFrame, spark: SparkSession, probes: int = 40_000, degrees: tuple[float, ...] = (1.0, 2.0, 4.0)) -> DataFrame:
    """deg, share of evenly spread probes farther than an angle from every point, through cells of a probe's angle."""
    out = None
    for d in degrees:
        size = 2 * math.sin(math.radians(d) / 2)
        steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
        at = lambda df: df.select("*", *(F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"))
        p, wide = at(points.select("x", "y", "z")), at(fibonacci(spark, probes).select("node", *(F.col(c) for c in "xyz")))
        wide = wide.select("node", *(F.col(c).alias(f"p{c}") for c in "xyz"), "cx", "cy", "cz")
        for c in "xyz":
            wide = wide.withColumn("s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("s")).drop("s")
        near = p.join(wide, ["cx", "cy", "cz"]).where(F.col("x") * F.col("px") + F.col("y") * F.col("py") + F.col("z") * F.col("pz") >= math.cos(math.radians(d))).select("node").distinct()
        one = near.agg((1 - F.count("*") / F.lit(float(probes))).alias("share")).select(F.lit(d).alias("deg"), "share")
        out = one if out is None else out.unionByName(one)
    return out
