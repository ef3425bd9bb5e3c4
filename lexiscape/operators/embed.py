"""A layout that keeps neighbourhoods: attraction along weighted neighbour edges, repulsion from sampled rows.

Weights are joins and one grouped minimum per row. The descent goes in rounds. A round deals the rows to blocks that lie
close together in the present layout (a space-filling order cut at quantiles of a hashed sample), and a task moves the
rows of its block for several epochs: partners in the block move along, partners elsewhere stand where the round found
them, and repulsion comes from the hashed sample, which every task has. Rounds cut blocks from other offsets, so that
borders move. The driver holds the sample only (SAMPLE rows, or AHEAD a block where that is more), never the layout.

A row with very many edges pulls at each of its partners; itself it follows a hashed HUB of them a round, weighted
up, so that no block depends on its degree. Rows of one place (copies) are told apart by their ids, in blocks as in the first layout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.operators.layout import graph_layout
from lexiscape.session import Scratch

#: Edges of a block (aimed at); rows that every task is sent, at least, and for each block.
BLOCK_EDGES, SAMPLE, AHEAD = 1 << 17, 4096, 16
#: Edges that a row follows in a round.
HUB = 128


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a d^2b), fitted (least squares) to 1 up to min_dist and an exponential tail of width spread."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p, damp = np.array([0.0, 0.0]), 1e-2  # logarithms of a and b

    def fitted(p):
        a, b = np.exp(p)
        return 1 / (1 + a * x ** (2 * b))

    for _ in range(200):
        f = fitted(p)
        b = math.exp(p[1])
        slope = -f * (1 - f)
        j = np.stack([slope, slope * 2 * b * np.log(x)], axis=1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ (y - f))
        better = ((y - fitted(p + step)) ** 2).sum() < ((y - f) ** 2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 4)
        if np.abs(step).max() < 1e-10:
            break
    return float(math.exp(p[0])), float(math.exp(p[1]))


def fuzzy_weights(edges: DataFrame, k: int = 15) -> DataFrame:
    """src, dst, w in both directions: how surely two rows are neighbours.

    Of each row, distances count from its nearest neighbour that isn't at its own place, on a scale at which the k weights sum to
    log2(k). A pair whose ends have weights p and q has p + q - pq.
    """

    @F.pandas_udf("array<double>")
    def weights(column: pd.Series) -> pd.Series:
        out = []
        for own in column:
            d = np.asarray(own, float)
            ahead = d - (d[d > 0].min() if (d > 0).any() else 0.0)
            ahead = np.maximum(ahead, 0)
            lo, hi, target = 0.0, np.inf, math.log2(max(len(d), 2))
            s = 1.0
            for _ in range(64):
                if np.exp(-ahead / s).sum() > target:
                    hi = s
                    s = (lo + hi) / 2
                else:
                    lo = s
                    s = 2 * s if hi == np.inf else (lo + hi) / 2
            s = max(s, 1e-3 * d.mean(), 1e-12)
            out.append(np.exp(-ahead / s))
        return pd.Series(out)

    own = F.array_sort(F.collect_list(F.struct("rank", "dst", "dist")))  # k entries
    t = edges.where(F.col("rank") <= k).groupBy("src").agg(own.alias("n"))
    t = t.withColumn("w", weights(F.transform("n", lambda s: s["dist"])))
    one = t.select("src", F.explode(F.arrays_zip(F.transform("n", lambda s: s["dst"]).alias("dst"), F.col("w").alias("w"))).alias("x")).select("src", "x.dst", "x.w")
    pair = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    both = pair.agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))
    return both.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))).alias("x")).select("x.*")


@dataclass(frozen=True)
class Space:
    """Where a layout lives: `plane` (any number of axes), `sphere` (unit vectors of three) or `torus` (two axes of a period)."""

    kind: str = "plane"
    axes: int = 2
    size: float = 10.0

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The way from y to x, as long as their distance: the distance's gradient at x, times the distance."""
        if self.kind == "torus":
            d = x - y
            return d - self.size * np.round(d / self.size)
        if self.kind == "sphere":
            cos = np.clip((x * y).sum(axis=-1, keepdims=True), -1, 1)
            away = x * cos - y  # along the sphere at x
            long = np.linalg.norm(away, axis=-1, keepdims=True)
            return away * (np.arccos(cos) / np.maximum(long, 1e-12))
        return x - y

    def moved(self, x: np.ndarray, step: np.ndarray) -> np.ndarray:
        if self.kind == "torus":
            return np.mod(x + step, self.size)
        if self.kind == "sphere":
            y = x + step
            return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
        return x + step

    def started(self, x: np.ndarray) -> np.ndarray:
        """A first layout of unit variance, put into the space."""
        if self.kind == "sphere":
            return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if self.kind == "torus":
            return np.mod(self.size * (0.5 + x / 5), self.size)
        return 4 * x


def order(x: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number for each place, near for near ones: interleaved bits of the axes, then bits of the id's hash."""
    axes = min(x.shape[1], 4)
    bits = 32 // axes
    cell = ((x[:, :axes] - low[:axes]) / np.maximum(high[:axes] - low[:axes], 1e-12) * ((1 << bits) - 1)).clip(0, (1 << bits) - 1).astype(np.uint64)
    out = np.zeros(len(x), np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in range(axes):
            out = out << np.uint64(1) | (cell[:, a] >> np.uint64(b) & np.uint64(1))
    own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)
    return (out << np.uint64(30) | own).astype(np.int64)


def _block(t: pa.Table, space: Space, names: list[str], sample: np.ndarray, a: float, b: float, negatives: int, alphas: np.ndarray, seed: int) -> pa.Table:
    """Moves the rows of a block; t has an edge a row, with both places."""
    src, dst = t["src"].to_numpy(), t["dst"].to_numpy()
    ids, first, own = np.unique(src, return_index=True, return_inverse=True)
    place = lambda p: np.stack([t[f"{p}{c}"].to_numpy() for c in names], axis=1)
    x, there, w = place("s_")[first], place("d_"), t["w"].to_numpy()
    at = np.searchsorted(ids, dst).clip(0, len(ids) - 1)
    inside = ids[at] == dst
    pull = np.bincount(own, w, len(ids))
    rng = np.random.default_rng([seed, int(ids[0]) & 0x7FFFFFFF, len(ids)])
    for alpha in alphas:
        there[inside] = x[at[inside]]
        d = space.apart(x[own], there)
        sq = (d * d).sum(axis=1)
        near = np.maximum(sq, 1e-12)
        force = -2 * a * b * near ** (b - 1) / (1 + a * near**b) * (sq > 0)
        step = np.stack([np.bincount(own, w * np.clip(force * d[:, i], -4, 4), len(ids)) for i in range(d.shape[1])], axis=1) / pull[:, None]
        for _ in range(negatives):
            d = space.apart(x, sample[rng.integers(0, len(sample), len(x))])
            sq = (d * d).sum(axis=1, keepdims=True)
            step += np.where(sq > 0, np.clip(2 * b / ((1e-3 + sq) * (1 + a * sq**b)) * d, -4, 4), 0)
        x = space.moved(x, alpha * step)
    return pa.table([pa.array(ids), *(pa.array(x[:, i]) for i in range(len(names)))], names=["id", *names])


def embedded(edges: DataFrame, kind: str = "plane", axes: int = 2, k: int = 15, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 10, epochs: int = 30, negatives: int = 5, size: float = 10.0, seed: int = 42, start: DataFrame | None = None, block_edges: int = BLOCK_EDGES) -> DataFrame:
    """id, c0, c1[, ...]: a layout of a neighbour table (src, rank, dst, dist) in a plane, on a sphere (three axes) or on a torus.

    start: id and as many axes of about unit variance; the graph's slowest modes where it isn't given. Rounds times epochs steps, of falling length.
    Null ends and distances are left out; of repeated pairs all count; an empty table gives no rows.
    """
    space = Space(kind, 3 if kind == "sphere" else axes, size)
    names = [f"c{i}" for i in range(space.axes)]
    scratch = Scratch(edges.sparkSession)
    w = fuzzy_weights(edges.where("src is not null and dst is not null and dist is not null and src <> dst"), k)
    w = scratch.table(w)
    degree = w.groupBy("src").agg(F.count("*").alias("deg"))
    w = scratch.table(w.join(degree.hint("merge"), "src"))
    count = w.count()
    if not count:
        return edges.sparkSession.createDataFrame([], "id long, " + ", ".join(f"{c} double" for c in names))
    blocks, (a, b) = max(1, -(-count // block_edges)), curve(min_dist, spread)
    start = start if start is not None else graph_layout(w.select("src", "dst"), axes=space.axes)
    now = scratch.table(_started(start.select(F.col("id").cast("long").alias("id"), *names), space, names))
    n = now.count()
    alphas = np.linspace(1.0, 0.0, rounds * epochs, endpoint=False)
    for r in range(rounds):
        every = max(1, n // max(SAMPLE, AHEAD * blocks))
        got = now.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(every)) == 0).orderBy("id").toPandas()  # a share of rows that is about SAMPLE
        sample = got[names].to_numpy() if len(got) else now.limit(SAMPLE).toPandas()[names].to_numpy()
        low, high = sample.min(axis=0), sample.max(axis=0)
        low = low - (high - low) * (0.37 * r % 1)  # another offset of cells
        places = np.sort(order(sample, low, high, got["id"].to_numpy() if len(got) else np.zeros(len(sample))))
        cuts = places[np.linspace(0, len(places), blocks, endpoint=False).astype(int)[1:]] if blocks > 1 else np.zeros(0, np.int64)

        @F.pandas_udf("int")
        def block(own: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, order(np.stack(x.to_numpy()), low, high, own.to_numpy()), "right"))

        followed = w.where((F.col("deg") <= HUB) | (F.pmod(F.xxhash64("src", "dst", F.lit(r)), F.col("deg")) < HUB))
        ends = lambda p, key: now.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}{c}") for c in names)).hint("merge")  # noqa: E731  not through the driver
        t = followed.select("src", "dst", "w").join(ends("s_", "src").withColumn("block", block("src", F.array(*(f"s_{c}" for c in names)))), "src").join(ends("d_", "dst"), "dst")
        sent = edges.sparkSession.sparkContext.broadcast((sample, alphas[r * epochs : (r + 1) * epochs]))

        def move(part: pa.Table) -> pa.Table:
            own, steps = sent.value
            return _block(part, space, names, own, a, b, negatives, steps, seed + r)

        after = scratch.table(t.groupBy("block").applyInArrow(move, "id long, " + ", ".join(f"{c} double" for c in names)))
        scratch.drop(now)
        now = after
    return now


def _started(start: DataFrame, space: Space, names: list[str]) -> DataFrame:
    """Places in the space, each shifted a little by its id."""

    def each(batches):
        for b in batches:
            if b.num_rows:
                ids = b.column("id").to_numpy()
                x = np.nan_to_num(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1))
                odd = (np.stack([ids.astype(np.uint64) * np.uint64(2 * i + 3) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44) for i in range(len(names))], axis=1) / 2**20 - 0.5) * 2e-3
                x = space.started(x + odd)
                yield pa.record_batch([b.column("id"), *(pa.array(x[:, i]) for i in range(len(names)))], names=["id", *names])

    return start.mapInArrow(each, "id long, " + ", ".join(f"{c} double" for c in names))


def torus_gradient(a: list, b: list, size: float = 10.0) -> list:
    """The gradient of the periodic distance at a, by axis: a's way from b around the nearer side, over the distance."""
    each = [F.when(2 * F.abs(x - y) < size, x - y).otherwise((x - y) * (F.abs(x - y) - size) / F.abs(x - y)) for x, y in zip(a, b)]
    long = F.sqrt(sum((F.pow(g, F.lit(2)) for g in each[1:]), F.pow(each[0], F.lit(2))))
    return [g / (long + 1e-6) for g in each]
