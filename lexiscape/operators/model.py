"""Iterative models: ring SOM, unbalanced transport, pair accuracy, encoders."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.session import Scratch

RING, ROUNDS = 198, 60


def matrix(rows: DataFrame, vector: str, limit: int = 50_000) -> np.ndarray:
    """At most `limit` vectors, of smallest id hash, for a fit on the driver."""
    return np.array([r[vector] for r in rows.orderBy("_h").limit(limit).select(vector).toLocalIterator()], float)


def ring_som(rows: DataFrame, starts: np.ndarray, key: str = "vec_id", vector: str = "embedding", ring: int = RING, rounds: int = ROUNDS, wide: float = 24.0, narrow: float = 1.5) -> np.ndarray:
    """Nodes of a closed ring of unit vectors: batch rounds of best node, sums by node, and a kernel along the ring.

    starts: centroids in the order of a tour. Each round sums in the tasks; the driver holds ring x dimension numbers.
    """
    spark = rows.sparkSession
    at = np.linspace(0, len(starts), ring, endpoint=False)
    lo, f = at.astype(int), (at % 1)[:, None]
    node = starts[lo] * (1 - f) + starts[(lo + 1) % len(starts)] * f
    node /= np.linalg.norm(node, axis=1, keepdims=True)
    gap = np.abs(np.arange(ring)[:, None] - np.arange(ring)[None])
    gap = np.minimum(gap, ring - gap)
    scratch = Scratch(spark)
    data = scratch.table(rows.select(vector))
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(node)

        def each(batches):
            total = np.zeros_like(shared.value)
            for pdf in batches:
                x = np.array(pdf[vector].tolist(), float)
                if len(x):
                    np.add.at(total, (x @ shared.value.T).argmax(axis=1), x)
            own = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"node": own, "s": [total[j] for j in own]})

        sums = np.zeros_like(node)
        for r in data.mapInPandas(each, "node long, s array<double>").toLocalIterator():  # at most `ring` rows a task
            sums[r["node"]] += r["s"]
        sigma = wide * (narrow / wide) ** (i / max(rounds - 1, 1))
        new = np.exp(-0.5 * (gap / sigma) ** 2) @ sums
        size = np.linalg.norm(new, axis=1, keepdims=True)
        node = np.where(size > 0, new / np.maximum(size, 1e-12), node)
    scratch.drop(data)
    return node


def hues(rows: DataFrame, node: np.ndarray, width: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, hue_deg, agree: direction and length of the kernel-weighted mean over nodes."""
    turn = np.arange(len(node)) / len(node) * 2 * np.pi
    shared = rows.sparkSession.sparkContext.broadcast((node, turn))

    def each(batches):
        node, turn = shared.value
        for pdf in batches:
            if len(pdf):
                d = 1 - np.array(pdf[vector].tolist(), float) @ node.T
                w = np.exp(-(d - d.min(axis=1, keepdims=True)) / width)
                w /= w.sum(axis=1, keepdims=True)
                c, s = w @ np.cos(turn), w @ np.sin(turn)
                yield pd.DataFrame({"id": pdf[key], "hue_deg": np.degrees(np.arctan2(s, c)) % 360, "agree": np.hypot(c, s)})

    return rows.select(key, vector).mapInPandas(each, "id long, hue_deg double, agree double")


def kernel_width(rows: DataFrame, node: np.ndarray, target: float = 0.6, steps: int = 40, **how) -> float:
    """Bisection for the width at which the median agreement of a bounded sample is the target."""
    key, vector = how.get("key", "vec_id"), how.get("vector", "embedding")
    x = matrix(rows.withColumn("_h", F.xxhash64(key)), vector, 20_000)
    turn = np.arange(len(node)) / len(node) * 2 * np.pi
    d = 1 - x @ node.T
    d -= d.min(axis=1, keepdims=True)
    lo, hi = 1e-4, 10.0
    for _ in range(steps):
        mid = (lo * hi) ** 0.5
        w = np.exp(-d / mid)
        w /= w.sum(axis=1, keepdims=True)
        lo, hi = (mid, hi) if np.median(np.hypot(w @ np.cos(turn), w @ np.sin(turn))) > target else (lo, mid)
    return (lo * hi) ** 0.5


def sinkhorn(cost, lam: float, eps: float, rounds: int = 1000, stop: float = 1e-6, shape: tuple[int, int] | None = None) -> tuple[np.ndarray, bool]:
    """Unbalanced transport between uniform masses: the mass that each row sends (1: all of it), and whether it settled.

    cost: a matrix, or a function that gives the costs of a range of rows, and the shape. Scalings are kept as potentials plus a small
    factor: where a factor grows beyond LARGE it goes into the potentials and the kernel is made anew, so that small eps neither
    underflows nor overflows. The kernel is the one large array: each row and each column of it is held over its greatest entry, in
    single precision where double ones would take over KERNEL_BYTES. Sums are double, a round reads the kernel once in blocks of rows,
    and the masses come from the costs in double.
    """
    costs, (n, m) = (cost, shape) if shape else ((lambda i, j: cost[i:j]), cost.shape)
    power = lam / (lam + eps)
    f, g, u, v = np.zeros(n), np.zeros(m), np.ones(n), np.ones(m)
    step = max(1, KERNEL_BLOCK // m)
    blocks = [(i, min(i + step, n)) for i in range(0, n, step)]
    k = np.empty((n, m), np.float64 if 8 * n * m <= KERNEL_BYTES else np.float32)

    def power_of(i: int, j: int) -> np.ndarray:
        return (f[i:j, None] + g - costs(i, j)) / eps

    def made() -> tuple[np.ndarray, np.ndarray]:
        high, wide = np.empty(n), np.full(m, -np.inf)
        for i, j in blocks:
            e = power_of(i, j)
            high[i:j] = e.max(axis=1)
            wide = np.maximum(wide, (e - high[i:j, None]).max(axis=0))
        for i, j in blocks:
            k[i:j] = np.exp(power_of(i, j) - high[i:j, None] - wide)
        return np.exp(high) / (n * m), np.exp(wide)

    def sent() -> np.ndarray:
        return np.concatenate([u[i:j] * (np.exp(power_of(i, j)) @ v) / m for i, j in blocks])

    left, right = made()
    for _ in range(rounds):
        before, given, taken = f + eps * np.log(u), right * v, np.zeros(m)
        for i, j in blocks:
            b = k[i:j].astype(np.float64, copy=False)
            u[i:j] = (1 / n / np.maximum(left[i:j] * (b @ given), 1e-300)) ** power * np.exp(-f[i:j] / (lam + eps))
            taken += (left[i:j] * u[i:j]) @ b
        v = (1 / m / np.maximum(right * taken, 1e-300)) ** power * np.exp(-g / (lam + eps))
        now = f + eps * np.log(u)
        if max(u.max(), v.max(), 1 / u.min(), 1 / v.min()) > LARGE:
            f, g = now, g + eps * np.log(v)
            u, v = np.ones(n), np.ones(m)
            left, right = made()
        if np.abs(now - before).max() / max(1.0, np.abs(now).max()) < stop * eps:
            return sent(), True
    return sent(), False


#: Bytes of a kernel in double precision; entries of it that are worked on at once.
KERNEL_BYTES, KERNEL_BLOCK = 64 << 20, 1 << 19
#: A scaling factor that goes into the potentials.
LARGE = 1e6


def transported(rows: DataFrame, key: str, vector: str, year: str, least_past: int = 20_000, standards: int = 10_000, chunk: int = 10_000, draws: int = 3, grid=((0.05, 0.1, 0.2, 0.4), (0.02, 0.05, 0.1)), components: int = 50) -> tuple[DataFrame, DataFrame]:
    """(id, year) of all rows, and year, draw, id, standard, surplus: mass of a row that the standards of its year and draw don't take, from 0 to 1.

    Vectors are centred, projected to `components` principal axes and renormalised. The penalty and the
    smoothing are those whose converged runs give the most even histogram of surplus on a sample.

    Standards are drawn from earlier years by hash, for all years and draws at once; the draw's next rows, as many and none
    of them a standard, are sent against the standards too (standard = true), for what a year's surplus is to be compared with. Each year, draw
    and chunk of rows meets its standards in a task of its own: one plan for all.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = rows.sparkSession
    vec = rows.select(F.col(key).alias("id"), F.col(year).cast("int").alias("year"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    p = PCA(k=components, inputCol="features", outputCol="p").fit(vec).transform(vec).select("id", "year", vector_to_array("p").alias("p"))
    scratch = Scratch(spark)
    p = scratch.table(p.withColumn("_h", F.xxhash64("id")))
    mu = np.array([r["m"] for r in p.select(F.posexplode("p").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()])

    def unit(x: np.ndarray) -> np.ndarray:
        x = x - mu
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    sample = unit(matrix(p, "p", 2000)) if len(mu) else np.zeros((0, 1))
    scale = float(np.maximum(0, 1 - sample @ sample.T).mean()) if len(sample) else 1.0
    half, scale = len(sample) // 2, scale or 1.0

    def cost(a, b):
        return np.maximum(0, 1 - a @ b.T) / scale

    best, pick = -1.0, (grid[0][0], grid[1][0])
    for lam in grid[0] if half else ():
        for eps in grid[1]:
            kept, ok = sinkhorn(cost(sample[:half], sample[half:]), lam, eps)
            n = np.histogram(np.clip(1 - kept, 0, 1), 50, (0, 1))[0]
            q = n[n > 0] / max(n.sum(), 1)
            h = float(-(q * np.log(q)).sum())
            if ok and h > best:
                best, pick = h, (lam, eps)
    size = {r["year"]: r["count"] for r in p.where("year is not null").groupBy("year").count().collect()}  # a row a year
    past = {y: sum(n for z, n in size.items() if z < y) for y in size}
    used = sorted(y for y in size if past[y] >= max(least_past, 1))
    plan = [(y, d, min(1.0, (2 * standards + 8 * math.sqrt(2 * standards) + 50) / past[y])) for y in used for d in range(draws)]  # a share that holds both draws
    chunks = {y: max(1, -(-size[y] // chunk)) for y in used}
    ids = p.select("id", "year")
    if not plan:
        return ids, spark.createDataFrame([], "year int, draw int, id long, standard boolean, surplus double")
    cases = spark.createDataFrame([(y, d, share, chunks[y]) for y, d, share in plan], "y int, draw int, share double, chunks int")
    every = F.array(*(F.struct(F.lit(y).alias("y"), F.lit(d).alias("draw"), F.lit(share).alias("share")) for y, d, share in plan))
    spot = lambda c: F.xxhash64("id", c["y"], c["draw"])
    chosen = F.filter(every, lambda c: (c["y"] > F.col("year")) & (F.pmod(spot(c), F.lit(1_000_003)) < c["share"] * 1_000_003))
    drawn = p.select("id", "p", "year", F.explode(chosen).alias("c")).select("id", "p", "c.y", "c.draw", spot(F.col("c")).alias("_s"))
    order = Window.partitionBy("y", "draw").orderBy(F.pmod("_s", F.lit(1_000_003)), "_s", "id")
    drawn = scratch.table(drawn.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * standards).select("id", "p", "y", "draw", "r"))
    few = F.broadcast(cases.select("y", "draw", "chunks"))  # a row a year and draw
    own = p.where(F.col("year").isin(used)).withColumnRenamed("year", "y").join(few, "y").select("id", "p", "y", "draw", F.pmod("_h", "chunks").cast("int").alias("c"))
    own = own.unionByName(drawn.where(F.col("r") > standards).select("id", "p", "y", "draw", F.lit(-1).alias("c")))
    std = drawn.where(F.col("r") <= standards).join(few, ["y", "draw"]).select("p", "y", "draw", F.explode(F.sequence(F.lit(-1), F.col("chunks") - 1)).alias("c"))

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"year": key[0], "draw": key[1], "id": a.id, "standard": key[2] < 0})
        if not len(a) or not len(b):
            return out.assign(surplus=np.ones(len(a)))
        x, y = (unit(np.array(t.p.tolist(), float)) for t in (a, b))
        return out.assign(surplus=np.clip(1 - sinkhorn(lambda i, j: cost(x[i:j], y), *pick, shape=(len(x), len(y)))[0], 0, 1))

    keys = ["y", "draw", "c"]
    met = own.groupBy(*keys).cogroup(std.groupBy(*keys)).applyInPandas(meet, "year int, draw int, id long, standard boolean, surplus double")
    return ids, scratch.table(met)


def surplus(rows: DataFrame, key: str, vector: str, year: str, **how) -> DataFrame:
    """id, uot_surplus: the mean over draws; null before there is a past. Settings: see `transported`."""
    ids, met = transported(rows, key, vector, year, **how)
    mean = met.where("not standard").groupBy("id").agg(F.avg("surplus").alias("uot_surplus"))
    return ids.join(mean, "id", "left").select("id", "uot_surplus")


def surplus_years(met: DataFrame) -> DataFrame:
    """year, n, median, p75 of the mean surplus, base_median, base_p75 of standards against other standards (means over draws), and
    reliability: the rank correlation of the first two draws."""
    from lexiscape.operators import ranks

    base = ranks.group_quantiles(met.where("standard"), ["year", "draw"], "surplus", m=0.5, q=0.75)
    base = base.groupBy("year").agg(F.avg("m").alias("base_median"), F.avg("q").alias("base_p75"))
    own = Scratch(met.sparkSession).table(met.where("not standard").groupBy("year", "id").agg(F.avg("surplus").alias("v"), F.max(F.when(F.col("draw") == 0, F.col("surplus"))).alias("a"), F.max(F.when(F.col("draw") == 1, F.col("surplus"))).alias("b")))
    out = own.groupBy("year").agg(F.count("*").alias("n")).join(ranks.group_quantiles(own, ["year"], "v", median=0.5, p75=0.75), "year").join(base, "year", "left")
    return out.join(ranks.group_spearman(own, "year", "a", "b").withColumnRenamed("rho", "reliability"), "year", "left")


#: Bytes of second derivatives that a task sums up at once; more pairs go in several passes.
PAIR_BYTES = 64 << 20


def pair_accuracy(rows: DataFrame, label: str, vector: str, pairs: list[tuple] | None = None, folds: int = 5, key: str = "vec_id", components: int = 50, penalty: float = 1.0, rounds: int = 25) -> DataFrame:
    """a, b, bal_acc: how well two labels are told apart (0.5: not at all), for all pairs where none are given.

    Balanced accuracy of a class-weighted, penalised logistic regression on principal components, mean over folds of the id's
    hash. All regressions (a pair and fold each) take their Newton steps together: a round is one pass over the rows, in which
    a row adds its derivatives to the regressions of its label, and one sum a regression. Null labels take no part.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = rows.sparkSession
    vec = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("lab"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    vec = PCA(k=components, inputCol="v", outputCol="p").fit(vec).transform(vec).select("lab", F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold"), vector_to_array("p").alias("p"))
    vec = Scratch(spark).table(vec)
    count = {(r["lab"], r["fold"]): r["count"] for r in vec.groupBy("lab", "fold").count().collect()}  # a row a label and fold
    labels = sorted({x for x, _ in count})
    at = {x: i for i, x in enumerate(labels)}
    pairs = list(combinations(labels, 2)) if pairs is None else [(a, b) for a, b in pairs]
    known = [(a, b) for a, b in pairs if a in at and b in at]
    width = components + 1
    step = max(1, PAIR_BYTES // (8 * folds * (1 + width + width * width)))
    out = []
    for i in range(0, len(known), step):
        out += _told_apart(vec, [(at[a], at[b]) for a, b in known[i : i + step]], at, count, folds, width, penalty, rounds)
    found = dict(zip(known, out))
    kind = vec.schema["lab"].dataType.simpleString()
    return spark.createDataFrame([(a, b, found.get((a, b))) for a, b in pairs], f"a {kind}, b {kind}, bal_acc double")


def _told_apart(vec: DataFrame, pairs: list[tuple[int, int]], at: dict, count: dict, folds: int, width: int, penalty: float, rounds: int) -> list[float]:
    spark, n = vec.sparkSession, len(pairs)
    names = {i: x for x, i in at.items()}
    train = lambda c, f: sum(count.get((names[c], g), 0) for g in range(folds) if g != f)
    weight = np.array([[[(train(a, f) + train(b, f)) / (2 * max(1, train(c, f))) for c in (a, b)] for f in range(folds)] for a, b in pairs])
    of: dict[int, list[tuple[int, int]]] = {}
    for p, (a, b) in enumerate(pairs):
        of.setdefault(a, []).append((p, 0))
        of.setdefault(b, []).append((p, 1))

    def each_label(batches):
        for b in batches:
            lab = np.array([at.get(x, -1) for x in b.column("lab").to_pylist()], int)
            fold = b.column("fold").to_numpy()
            x = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(len(lab), -1) if len(lab) else np.zeros((0, width - 1))
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            for c in np.unique(lab):
                if c in of:
                    yield x[lab == c], fold[lab == c], of[c]

    def passed(w: np.ndarray, going: np.ndarray) -> dict[int, np.ndarray]:
        """Loss, slope and curvature of each regression that goes on."""
        sent = spark.sparkContext.broadcast((w, going))

        def each(batches):
            w, going = sent.value
            total: dict[int, np.ndarray] = {}
            for x, fold, own in each_label(batches):
                for p, side in own:
                    for f in np.flatnonzero(going[p]):
                        z = x[fold != f]
                        sign = 1 if side else -1
                        m = sign * (z @ w[p, f])
                        s, c = 1 / (1 + np.exp(np.clip(m, -500, 500))), weight[p, f, side]
                        part = np.concatenate([[c * np.logaddexp(0, -m).sum()], -sign * c * (s @ z), (c * (z * (s * (1 - s))[:, None]).T @ z).ravel()])
                        k = p * folds + int(f)
                        total[k] = total[k] + part if k in total else part
            yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["k", "s"])

        def summed(t: pa.Table) -> pa.Table:
            return pa.table([t["k"].slice(0, 1), pa.array([np.stack(t["s"].to_pylist()).sum(axis=0)], pa.list_(pa.float64()))], names=["k", "s"])

        parts = vec.mapInArrow(each, "k long, s array<double>")
        return {r["k"]: np.array(r["s"]) for r in parts.groupBy("k").applyInArrow(summed, "k long, s array<double>").toLocalIterator()}  # a row a regression

    ridge = np.append(np.full(width - 1, penalty), 0.0)
    w, going = np.zeros((n, folds, width)), np.ones((n, folds), bool)
    held, worth = w.copy(), np.full((n, folds), np.inf)  # the best so far, and its loss
    for _ in range(rounds):
        for k, s in passed(w, going).items():
            p, f = divmod(k, folds)
            loss, slope, curve = s[0] + 0.5 * (ridge * w[p, f] ** 2).sum(), s[1 : width + 1] + ridge * w[p, f], s[width + 1 :].reshape(width, width)
            if loss > worth[p, f] + 1e-9 * abs(worth[p, f]):  # a step too far
                w[p, f] = (held[p, f] + w[p, f]) / 2
                continue
            worth[p, f], held[p, f] = loss, w[p, f]
            if np.abs(slope).max() < 1e-6 * max(1.0, loss):
                going[p, f] = False
            else:
                w[p, f] = w[p, f] - np.linalg.solve(curve + np.diag(ridge + 1e-9), slope)
        if not going.any():
            break
    final = spark.sparkContext.broadcast(held)

    def judged(batches):
        hits: dict[tuple[int, int, int], list[int]] = {}
        for x, fold, own in each_label(batches):
            for p, side in own:
                right = (np.einsum("ij,ij->i", x, final.value[p, fold]) > 0) == bool(side)
                for f in np.unique(fold):
                    h = hits.setdefault((p, int(f), side), [0, 0])
                    h[0] += int(right[fold == f].sum())
                    h[1] += int((fold == f).sum())
        flat = [(*k, *h) for k, h in hits.items()]
        yield pa.record_batch([pa.array([r[i] for r in flat], pa.int64()) for i in range(5)], names=["p", "f", "side", "right", "n"])

    got = vec.mapInArrow(judged, "p long, f long, side long, right long, n long").groupBy("p", "f", "side").agg((F.sum("right") / F.sum("n")).alias("r"))
    mean = got.groupBy("p", "f").agg(F.avg("r").alias("r")).groupBy("p").agg(F.avg("r").alias("r"))
    found = {r["p"]: r["r"] for r in mean.collect()}  # a row a pair
    return [found.get(p) for p in range(n)]


def encode(rows: DataFrame, text: str, key: str, dimension: int = 256, encoder=None, prefix: str = "", batch: int = 64) -> DataFrame:
    """id, emb of unit length: hashed words weighted by rarity, or an encoder's vectors.

    encoder: a function that gives a list of texts' vectors (a list or array of `dimension` numbers each); it is called in the tasks, `batch` texts
    at once, each behind `prefix`. Null texts are empty ones.
    """
    if encoder:

        def each(batches):
            for pdf in batches:
                for i in range(0, len(pdf), batch):
                    part = pdf.iloc[i : i + batch]
                    v = np.asarray(encoder([prefix + (x or "") for x in part.text]), float)
                    if v.shape != (len(part), dimension):
                        raise ValueError(f"the encoder gave {v.shape} for {len(part)} texts of {dimension} numbers")
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    yield pd.DataFrame({"id": part.id.to_numpy(), "emb": list(v)})

        kind = dict(rows.select(F.col(key).alias("id")).dtypes)["id"]
        return rows.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInPandas(each, f"id {kind}, emb array<double>")
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = rows.select(F.col(key).alias("id"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "").alias("w"))
    tf = HashingTF(numFeatures=dimension, inputCol="w", outputCol="tf").transform(words)
    out = Normalizer(inputCol="idf", outputCol="n").transform(IDF(inputCol="tf", outputCol="idf").fit(tf).transform(tf))
    return out.select("id", vector_to_array("n").alias("emb"))


def layout(rows: DataFrame, vector: str, key: str, k: int = 2) -> DataFrame:
    """id, c0, c1[, c2]: principal components, the default where no layout is given."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = rows.select(F.col(key).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    out = PCA(k=k, inputCol="v", outputCol="p").fit(vec).transform(vec).withColumn("p", vector_to_array("p"))
    return out.select("id", *(F.col("p")[i].alias(f"c{i}") for i in range(k)))
