"""Places of regions, words near peaks, colour legends and tilings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscape.functions.columns import clamped_chroma, clip, dot, rgb255
from lexiscape.operators import terrain
from lexiscape.operators.layout import uniform
from lexiscape.operators.ranks import quantile_values
from lexiscape.session import Scratch


def region_places(points: DataFrame, regions: DataFrame, peaks: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, least: int = 150) -> DataFrame:
    """region, n, x, y (centre of the peak's cell), sx, sy (population SD), peak. points: id, x, y; regions: id, region."""
    x0, x1, y0, y1 = box
    own = points.join(regions, "id").where("region > 0").groupBy("region").agg(F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where(F.col("n") >= least)
    at = peaks.select("region", ((F.col("ix") + 0.5) / nx * (x1 - x0) + x0).alias("x"), ((F.col("iy") + 0.5) / ny * (y1 - y0) + y0).alias("y"), F.col("height").alias("peak"))
    return own.join(at, "region").select("region", "n", "x", "y", "sx", "sy", "peak")


def sphere_places(points: DataFrame, regions: DataFrame, least: int = 150) -> DataFrame:
    """region, n, x, y, z (unit centre), spread_deg: root mean square angle to the centre."""
    rows = points.join(regions, "id").where("region > 0")
    c = rows.groupBy("region").agg(F.count("*").alias("n"), *(F.avg(a).alias(f"m{a}") for a in "xyz")).where(F.col("n") >= least)
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    c = c.select("region", "n", *((F.col(f"m{a}") / size).alias(f"c{a}") for a in "xyz"))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.col("cx") + F.col("y") * F.col("cy") + F.col("z") * F.col("cz")))
    spread = rows.join(c, "region").groupBy("region").agg(F.degrees(F.sqrt(F.avg(F.acos(cos) ** 2))).alias("spread_deg"))
    return c.join(spread, "region").select("region", "n", *(F.col(f"c{a}").alias(a) for a in "xyz"), "spread_deg")


def place_levels(points: DataFrame, words: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int, sigmas: list[float], least: int = 150, power: float = 1.0, share: float = 0.03, keep: int = 8) -> DataFrame:
    """level, region, n, x, y, sx, sy, peak, words: places of a map at several widths (in the units of x), the widest first, with their feature words.

    points: id, x, y; words: id, w. Words are weighed by how near to its peak's density a point lies, to a power. Places under `least` points have no row.
    """
    scratch, out = Scratch(points.sparkSession), None
    x0, x1, y0, y1 = box
    at = points.select("id", "x", "y", terrain.cell(F.col("x"), x0, x1, nx).alias("ix"), terrain.cell(F.col("y"), y0, y1, ny).alias("iy"))
    for level, sigma in enumerate(sigmas):
        wide = sigma * nx / (x1 - x0)
        field = scratch.table(terrain.smooth(terrain.histogram2d(points, "x", "y", box, nx, ny), wide, sigma * ny / (y1 - y0), nx, ny).withColumn("v", F.round("v", 9)))
        peaks = scratch.table(terrain.box_peaks(field, max(1, round(wide)), share))
        own = scratch.table(terrain.assigned(at, terrain.watershed(field, peaks), field, peaks))
        best = _feature_words(words, own.select("id", "region", F.pow("wt", F.lit(power)).alias("wt")), keep)
        one = region_places(points, own.select("id", "region"), peaks, box, nx, ny, least).join(best, "region", "left").select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _feature_words(words: DataFrame, regions: DataFrame, keep: int) -> DataFrame:
    from lexiscape.operators import keywords

    return keywords.feature_words(keywords.region_scores(words, regions.where("region > 0")), "region", keep=keep)


def sphere_levels(points: DataFrame, words: DataFrame, n: int, sigma: float, steps: list[int], least: int = 150, limit: int | None = None, keep: int = 8) -> DataFrame:
    """level, place, of, n, x, y, z, spread_deg, peak, words: places of a spherical map, smoothed `steps` times at each level, with their feature words.

    points: id, x, y, z (unit); words: id, w. A region of over `limit` points is split, and its parts (of: the region) stand for it, at their mean direction;
    others stand at their peak's node. spread_deg: standard deviation of the angles to that place.
    """
    spark = points.sparkSession
    scratch, out = Scratch(spark), None
    at = scratch.table(terrain.nearest_node(points, n))
    count = scratch.table(at.groupBy("node").agg(F.count("*").cast("double").alias("v")))
    edges = scratch.table(terrain.sphere_edges(spark, n, 3 * sigma))
    done, field = 0, count
    for level, k in enumerate(sorted(steps)):
        field, done = scratch.table(terrain.sphere_smooth(field, edges, sigma, k - done)), k
        even = scratch.table(field.withColumn("v", F.round("v", 9)))
        label = scratch.table(terrain.sphere_regions(even, n, sigma * math.sqrt(k), occupied=count))
        tops = label.where("region > 0").join(even, "node").groupBy("region").agg(F.max_by("node", F.struct("v", -F.col("node"))).alias("node"), F.max("v").alias("peak"))
        tops = tops.join(terrain.fibonacci(spark, n), "node").select(F.col("region").cast("long").alias("place"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"), "peak")
        own = at.join(label, "node").where("region > 0").select("id", F.col("region").cast("long").alias("region"))
        size = own.groupBy("region").agg(F.count("*").alias("_n"))
        own = scratch.table(own.join(size, "region"))
        split = F.col("_n") > limit if limit else F.lit(False)
        whole = own.where(~split & (F.col("_n") >= least)).select("id", F.col("region").alias("place"), F.lit(None).cast("long").alias("of"))
        if limit:
            parts = terrain.split_regions(points, own.where(split).select("id", "region"), limit)
            whole = whole.unionByName(parts.select("id", F.col("sector").alias("place"), F.col("region").alias("of")))
        whole = scratch.table(points.join(whole, "id"))
        mean = whole.where("of is not null").groupBy("place").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        long = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
        centre = tops.unionByName(mean.select("place", *((F.col(f"m{c}") / long).alias(f"c{c}") for c in "xyz"), F.lit(None).cast("double").alias("peak")))
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x") * F.col("cx") + F.col("y") * F.col("cy") + F.col("z") * F.col("cz"))))
        one = whole.join(centre, "place").groupBy("place").agg(F.first("of").alias("of"), F.count("*").alias("n"), *(F.first(f"c{c}").alias(c) for c in "xyz"), F.degrees(F.stddev_pop(angle)).alias("spread_deg"), F.first("peak").alias("peak"))
        best = _feature_words(words, whole.select("id", F.col("place").alias("region"), F.lit(1.0).alias("wt")), keep).withColumnRenamed("region", "place")
        one = one.join(best, "place", "left").select(F.lit(level).alias("level"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _near(points: DataFrame, peaks: DataFrame, radius: float) -> DataFrame:
    """Points (x, y) with the peaks (peak, px, py) within a radius: both meet in cells of its size, so that a point sees only its neighbourhood."""
    cells = lambda x, y: (F.floor(x / radius).alias("cx"), F.floor(y / radius).alias("cy"))
    own = points.select("*", *cells(F.col("x"), F.col("y")))
    wide = peaks.select("peak", "px", "py", *cells(F.col("px"), F.col("py")))
    for c in ("cx", "cy"):
        wide = wide.withColumn("s", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("s")).drop("s")
    return own.join(wide, ["cx", "cy"]).where((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 <= radius**2)


def peak_words(points: DataFrame, words: DataFrame, peaks: DataFrame, radius: float, least: int = 5, smooth: float = 20.0, keep: int = 4, target: Column | None = None) -> DataFrame:
    """peak, w, n_near, n_all, score = n_near / (n_all + smooth): words of points (of the target, where there is one) within a radius of a peak (peak, px, py)."""
    near = _near(points.where(target) if target is not None else points, peaks, radius).select("peak", "id")
    n_all = words.groupBy("w").agg(F.count("*").alias("n_all"))
    n = near.join(words, "id").groupBy("peak", "w").agg(F.count("*").alias("n_near")).where(F.col("n_near") >= least).join(n_all, "w")
    from lexiscape.operators.keywords import top

    return top(n.select("peak", "w", "n_near", "n_all", (F.col("n_near") / (F.col("n_all") + smooth)).alias("score")), "peak", keep)


def peak_counts(points: DataFrame, peaks: DataFrame, radius: float, target: Column) -> DataFrame:
    """peak, n_target, n_other: points of the target and others within a radius of each peak."""
    near = _near(points.withColumn("_t", F.coalesce(target, F.lit(False))), peaks, radius).groupBy("peak").agg(F.count_if("_t").alias("n_target"), F.count_if(~F.col("_t")).alias("n_other"))
    return peaks.select("peak").join(near, "peak", "left").fillna(0, ["n_target", "n_other"])


def pixel_colours(points: DataFrame, ix: Column, iy: Column) -> DataFrame:
    """ix, iy, n, mean r, g, b."""
    return points.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "rgb"))


def web_chroma(points: DataFrame, value: str, top: float = 0.145, mode: str = "web") -> DataFrame:
    """Adds chroma. web: the 5th to 95th percentile of a value over 0.85 to 1.30 of `top`, clipped; figure: in proportion, `top` at the 95th; flat: `top`."""
    if mode == "flat":
        return points.withColumn("chroma", F.lit(top))
    lo, hi = quantile_values(points, value, 0.05, 0.95)
    if mode == "figure":
        return points.withColumn("chroma", F.col(value) * (top / (hi or 1.0)))
    at = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - lo) / (hi - lo)))
    return points.withColumn("chroma", top * (0.85 + 0.45 * at))


def label_mix(rows: DataFrame, vector: str, cents: list[list[float]], beta: float, light: float = 0.72, chroma: float = 0.17, key: str = "vec_id") -> DataFrame:
    """id, r, g, b: softmax of beta times similarity to a few centroids mixes colours spread over the circle."""
    sims = [dot(F.col(vector), F.array(*map(F.lit, c))) for c in cents]
    best = F.greatest(*sims) if len(sims) > 1 else sims[0]
    rows = rows.select(key, *(F.exp(beta * (s - best)).alias(f"w{i}") for i, s in enumerate(sims)))
    total = sum((F.col(f"w{i}") for i in range(len(cents))), F.lit(0.0))
    turn = [2 * math.pi * i / len(cents) for i in range(len(cents))]
    a = sum((F.col(f"w{i}") * math.cos(t) for i, t in enumerate(turn)), F.lit(0.0)) / total * chroma
    b = sum((F.col(f"w{i}") * math.sin(t) for i, t in enumerate(turn)), F.lit(0.0)) / total * chroma
    r, g, bl = rgb255(F.lit(light), a, b)
    return rows.select(F.col(key).alias("id"), r.alias("r"), g.alias("g"), bl.alias("b"))


def warp(hue: Column, anchors: list[tuple[float, float]]) -> Column:
    """Monotone circular piecewise-linear map that takes each anchor's first hue (degrees) to its second."""
    pts = sorted((a % 360, b % 360) for a, b in anchors)
    out = F.lit(None).cast("double")
    for (a, x), (b, y) in zip(pts, pts[1:] + [(pts[0][0] + 360, pts[0][1])]):
        rise = (y - x) % 360
        h = F.when(hue < pts[0][0], hue + 360).otherwise(hue)
        out = F.when((h >= a) & (h <= b), F.pmod(x + (h - a) / (b - a) * rise, F.lit(360.0))).otherwise(out)
    return out


def mixing_beta(rows: DataFrame, vector: str, cents: list[list[float]], target: float = 0.6, rounds: int = 4, grid: int = 16) -> float:
    """The beta whose mean largest softmax weight is `target`: an interval is cut in `grid` parts a pass, all of them in one aggregate."""
    sims = rows.select(F.array(*(dot(F.col(vector), F.array(*map(F.lit, c))) for c in cents)).alias("s"))
    lo, hi = 0.0, 1000.0
    for _ in range(rounds):
        betas = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
        top = lambda b: F.avg(1 / F.aggregate("s", F.lit(0.0), lambda t, x: t + F.exp(b * (x - F.array_max("s")))))
        got = sims.agg(*(top(b).alias(f"b{i}") for i, b in enumerate(betas))).first()
        at = max((i for i in range(grid) if (got[f"b{i}"] or 0.0) <= target), default=0)
        lo, hi = betas[at], betas[at + 1]
    return (lo + hi) / 2


def coordinate_colours(rows: DataFrame, key: str, light: float = 0.63, spread: float = 0.11, chroma: float = 0.13) -> DataFrame:
    """id, r, g, b of 3-D coordinates c0, c1, c2: turned to principal axes, each scaled from its 2nd to 98th percentile to -1..1;
    the two widest make the chroma, the third the lightness, and chroma is pressed into the gamut."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = rows.select(F.col(key).alias("id"), array_to_vector(F.array(*(F.col(f"c{i}").cast("double") for i in range(3)))).alias("v"))
    t = PCA(k=3, inputCol="v", outputCol="p").fit(t).transform(t).select("id", vector_to_array("p").alias("p")).select("id", *(F.col("p")[i].alias(f"p{i}") for i in range(3)))
    ends = [[x or 0.0 for x in quantile_values(t, f"p{i}", 0.02, 0.98)] for i in range(3)]
    part = [clip((F.col(f"p{i}") - (lo + hi) / 2) / (((hi - lo) / 2) or 1.0), -1.0, 1.0) for i, (lo, hi) in enumerate(ends)]
    t = t.select("id", (light + spread * part[2]).alias("l"), F.hypot(part[0] * chroma, part[1] * chroma).alias("c"), F.atan2(part[1], part[0]).alias("h"))
    t = t.withColumn("c", clamped_chroma(F.col("l"), F.col("c"), F.col("h")))
    return t.select("id", *(x.alias(n) for x, n in zip(rgb255(F.col("l"), F.col("c") * F.cos("h"), F.col("c") * F.sin("h")), "rgb")))


def hue_sector(hue: Column, sectors: int = 12) -> Column:
    return F.pmod(F.floor(F.pmod(hue, F.lit(360.0)) / (360 / sectors)), F.lit(sectors)).cast("int")


def legend(points: DataFrame, label: str, light: float = 0.72) -> DataFrame:
    """label, n, a, b, chroma, r, g, b_: the mean colour of each label's points (hue_deg, chroma) at one lightness."""
    h = F.radians("hue_deg")
    mean = points.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col("chroma") * F.cos(h)).alias("ma"), F.avg(F.col("chroma") * F.sin(h)).alias("mb"))
    c, t = F.hypot("ma", "mb"), F.atan2("mb", "ma")
    fit = mean.withColumn("chroma", c).withColumn("fit", clamped_chroma(F.lit(light), c, t)).withColumn("t", t)
    rgb = rgb255(F.lit(light), F.col("fit") * F.cos("t"), F.col("fit") * F.sin("t"))
    return fit.select(label, "n", "ma", "mb", "chroma", *(x.alias(n) for x, n in zip(rgb, ("r", "g", "b"))))


def swatches(labels: DataFrame, legend_rows: DataFrame, label: str, plain: list[str]) -> DataFrame:
    """label, r, g, b: a label's own swatch, replaced by its members' mean; labels in `plain` stay as they are."""
    mean = legend_rows.select(label, *(F.col(c).alias(f"m_{c}") for c in "rgb"))
    keep = F.col(label).cast("string").isin(plain) if plain else F.lit(False)
    return labels.join(mean, label, "left").select(label, *(F.when(keep | F.col(f"m_{c}").isNull(), F.col(c)).otherwise(F.col(f"m_{c}")).alias(c) for c in "rgb"))


def window_centre(points: DataFrame, label: str, node: str, start: dict, nodes: int) -> DataFrame:
    """label, centre: the median of ring nodes within a quarter turn of a label's first guess, counted from it (the guess where none are)."""
    first = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for k, v in start.items() for x in (k, float(v)))), F.col(label)), F.lit(0.0))
    off = F.pmod(F.col(node) - first + nodes / 2, F.lit(float(nodes))) - nodes / 2
    t = points.where(F.col(label).isin(list(start))).select(label, first.alias("first"), off.alias("off"))
    near = F.percentile(F.when(F.abs("off") < nodes / 4, F.col("off")), 0.5)
    return t.groupBy(label).agg((F.first("first") + F.coalesce(near, F.lit(0.0))).alias("centre"))


def tiled(points: DataFrame, size: float) -> DataFrame:
    """A periodic square repeated 3 x 3: u, v and the tile."""
    steps = F.array(*(F.struct(F.lit(i).alias("du"), F.lit(j).alias("dv")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return points.withColumn("t", F.explode(steps)).withColumn("u", F.col("u") + F.col("t.du") * size).withColumn("v", F.col("v") + F.col("t.dv") * size)


def interleaved(rows: DataFrame, key: str, label: str, labels: list[str], parts: int = 16) -> DataFrame:
    """Adds part (by a number of the integer key) and order: labels rotate from part to part, so that none always lies on top."""
    place = F.array_position(F.array(*map(F.lit, labels)), F.col(label).cast("string")) - 1
    t = rows.withColumn("part", F.floor(uniform(F.col(key), 0) * parts).cast("int"))
    return t.withColumn("order", F.col("part") * len(labels) + F.pmod(place + F.col("part"), F.lit(len(labels))))
