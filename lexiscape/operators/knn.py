"""Exact nearest neighbours by cosine, and what follows from the edge table (src, rank, dst, dist)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.functions.columns import dot, norm, unit
from lexiscape.session import Scratch

#: Bytes of the matrix that may be sent to every task; beyond it, rows are dealt to cells, in blocks of so many bytes and rows at most.
SENT_BYTES, BLOCK_BYTES, BLOCK = 16 << 20, 16 << 20, 32_768
#: Queries and rows of a block that meet in one product.
QUERIES, TILE = 256, 8192
#: Bytes of pivots that every task is sent.
PIVOT_BYTES = 64 << 20
EDGES = "src long, dst long, sim double"


def _marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few that hold, eight looked at as one."""
    flat = mask.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    some = (8 * np.flatnonzero(flat.view(np.uint64))[:, None] + np.arange(8)).ravel()
    return some[flat[some]]


def _top(q_ids, q, ids, x, k: int, above: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """k best of a block for each query; similarity is rounded to 12 places, so that the last bit orders nothing.

    Single-precision products find all rows that can be among the k best: unit vectors' products are off by less than `slack`, so
    that these lie at most twice that under the k-th best. Their similarities are then worked out in double precision.
    above: of each query a similarity under which none is asked for.
    """
    x32, q32 = x.astype(np.float32), q.astype(np.float32)
    slack = 2 * (x.shape[1] + 4) * 2.0**-24 + 1e-11
    for at in range(0, len(q_ids), QUERIES):
        own = q_ids[at : at + QUERIES]
        row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        least = np.full(len(own), -np.inf, np.float32) if above is None else (above[at : at + QUERIES] - slack).astype(np.float32)
        for lo in range(0, len(ids), TILE):
            s = q32[at : at + QUERIES] @ x32[lo : lo + TILE].T
            if not lo and above is None and s.shape[1] > 4 * k:
                least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] - np.float32(slack)  # k + 1 rows: one may be the query
            r, c = np.divmod(_marked(s >= least[:, None]), s.shape[1])
            if not len(r):
                continue
            other = own[r] != ids[lo + c]
            r, c = r[other], c[other]
            row, col, sim = np.concatenate([row, r]), np.concatenate([col, lo + c]), np.concatenate([sim, s[r, c]])
            order = np.lexsort((-sim, row))
            row, col, sim = row[order], col[order], sim[order]
            first = np.searchsorted(row, np.arange(len(own)))
            kth = first + k - 1
            full = kth < np.append(first[1:], len(row))
            least[full] = np.maximum(least[full], sim[kth[full]] - np.float32(slack))
            keep = sim >= least[row]
            row, col, sim = row[keep], col[keep], sim[keep]
        exactly = np.concatenate([np.einsum("ij,ij->i", q[at + row[i : i + TILE]], x[col[i : i + TILE]]) for i in range(0, len(row), TILE)] or [np.zeros(0)])
        exactly = np.round(exactly, 12)
        order = np.lexsort((ids[col], -exactly, row))
        row, col, exactly = row[order], col[order], exactly[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        if best.any():
            yield pa.record_batch([pa.array(own[row[best]]), pa.array(ids[col[best]]), pa.array(exactly[best])], names=["src", "dst", "sim"])


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(col), -1)


def exact(rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest others of every row. Equal vectors stay neighbours at distance 0; ties go to the smaller id; null and zero vectors take no part.

    A matrix of up to SENT_BYTES and BLOCK rows is sent to all tasks. Rows of a larger one are dealt to cells by their nearest pivot, and meet
    only those blocks that can hold a neighbour of theirs (see `visits`).
    """
    spark = rows.sparkSession
    x = rows.select(F.col(key).cast("long").alias("id"), F.when(norm(F.col(vector)) > 0, unit(F.col(vector))).alias("v")).where("v is not null")
    n, width = x.agg(F.count("*"), F.max(F.size("v"))).first()
    if n * (width or 0) * 8 <= SENT_BYTES and n <= BLOCK:
        table = x.orderBy("id").toArrow()
        ids = table.column("id").to_numpy()
        shared = spark.sparkContext.broadcast((ids, _matrix(table.column("v").combine_chunks()) if n else np.zeros((0, 0))))

        def each(batches):
            ids, m = shared.value
            for b in batches:
                if b.num_rows:
                    yield from _top(b.column("id").to_numpy(), _matrix(b.column("v")), ids, m, k)

        found = x.repartition(spark.sparkContext.defaultParallelism).mapInArrow(each, EDGES)
    else:
        own, cells = celled(x, n, width)
        met = within(own, k)
        away = visits(met, cells, k)  # worked out twice: it has a row's vector for each block
        pairs = Scratch(spark).table(away.select(F.col("home").alias("to"), F.col("target").alias("block")).distinct())
        there = own.select("id", "v", "block").join(pairs, "block")

        def meet(q: pa.Table, c: pa.Table) -> pa.Table:
            got = list(_top(q["id"].to_numpy(), _matrix(q["v"].combine_chunks()), c["id"].to_numpy(), _matrix(c["v"].combine_chunks()), k, q["above"].to_numpy())) if len(q) and len(c) else []
            return pa.Table.from_batches(got) if got else pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})

        found = away.groupBy("home", "target").cogroup(there.groupBy("to", "block")).applyInArrow(meet, EDGES)
        near = met.select(F.col("id").alias("src"), F.explode(F.arrays_zip("dst", "sim")).alias("x")).select("src", "x.dst", "x.sim")
        found = near.unionByName(found)
    order = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "rank", "dst", (1 - F.col("sim")).alias("dist"))


@dataclass
class Cells:
    """Pivots, and of each cell the number of rows, the greatest distance to its pivot and the number of its blocks."""

    pivot: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors, which the triangle inequality holds for."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def celled(x: DataFrame, n: int, width: int) -> tuple[DataFrame, Cells]:
    """Rows (id, v) with cell and block: the cell of the nearest pivot, cut by hash into blocks of bounded size.

    Pivots are different vectors of a hashed sample, one for each block that the rows fill; tasks return a row a cell.
    """
    spark = x.sparkSession
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * width)))
    wanted = max(1, min(-(-n // most), PIVOT_BYTES // (8 * width)))
    share = max(1, n // (2 * wanted))
    sample = x.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy(F.xxhash64("id", F.lit(1)), "id").limit(wanted).toArrow()  # PIVOT_BYTES at most
    sample = sample if len(sample) else x.limit(wanted).toArrow()
    pivot = np.unique(_matrix(sample.column("v").combine_chunks()), axis=0)
    sent = spark.sparkContext.broadcast(pivot)

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = _apart(_matrix(b.column("v")), sent.value)
                at = d.argmin(axis=1)
                yield pa.record_batch([b.column("id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at])], names=["id", "v", "cell", "away"])

    t = Scratch(spark).table(x.mapInArrow(assign, "id long, v array<double>, cell int, away double"))
    cells = Cells(pivot, *(np.zeros(len(pivot)) for _ in range(2)), np.ones(len(pivot), np.int64))
    for r in t.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).toLocalIterator():  # a row a pivot
        cells.rows[r["cell"]], cells.radius[r["cell"]], cells.blocks[r["cell"]] = r["n"], r["r"], -(-r["n"] // most)
    first = np.cumsum(cells.blocks) - cells.blocks
    many, start = spark.sparkContext.broadcast(cells.blocks), spark.sparkContext.broadcast(first)

    @F.pandas_udf("int")
    def block(cell: pd.Series, h: pd.Series) -> pd.Series:
        c = cell.to_numpy()
        return pd.Series((start.value[c] + h.to_numpy() % many.value[c]).astype(np.int32))

    return t.withColumn("block", block("cell", F.xxhash64("id"))).drop("away"), cells


def within(own: DataFrame, k: int) -> DataFrame:
    """id, v, cell, block, dst, sim: the k nearest in a row's own block, written once."""

    def each(t: pa.Table) -> pa.Table:
        ids, v = t["id"].to_numpy(), _matrix(t["v"].combine_chunks())
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        dst, sim = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)
        for got in _top(ids, v, ids, v, k):
            src, d, s = (got.column(c).to_numpy() for c in range(3))
            for part in np.split(np.arange(len(src)), np.flatnonzero(np.diff(src)) + 1):
                for i in order[slice(*np.searchsorted(sorted_ids, [src[part[0]], src[part[0]] + 1]))]:
                    dst[i], sim[i] = d[part], s[part]
        return t.append_column("dst", pa.array(dst, pa.list_(pa.int64()))).append_column("sim", pa.array(sim, pa.list_(pa.float64())))

    return Scratch(own.sparkSession).table(own.groupBy("block").applyInArrow(each, "id long, v array<double>, cell int, block int, dst array<long>, sim array<double>"))


def visits(met: DataFrame, cells: Cells, k: int) -> DataFrame:
    """id, v, above, home, target: the other blocks that may hold one of a row's k nearest, and the similarity of the k-th in its own (-2: none).

    At most as far as its k-th nearest lies the k-th of the row's own block, and the far side of any cell with k + 1 rows. A cell
    whose rows all lie farther is passed over: they are no nearer than the distance to its pivot less its radius, nor, since they are
    nearer to its pivot than to the row's, than the row is to the plane between the two pivots.
    """
    sent = met.sparkSession.sparkContext.broadcast((cells, _apart(cells.pivot, cells.pivot)))

    def each(batches):
        c, between = sent.value
        first = np.cumsum(c.blocks) - c.blocks
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                ids, cell, home = b.column("id").to_numpy(), b.column("cell").to_numpy(), b.column("block").to_numpy()
                d = _apart(_matrix(b.column("v")), c.pivot)
                above = np.array([s[k - 1] if len(s) >= k else -2.0 for s in b.column("sim").to_pylist()])
                reach = np.where(above > -2, np.sqrt(np.maximum(0.0, 2 - 2 * above)), np.inf)
                full = c.rows > k
                if full.any():
                    reach = np.minimum(reach, (d + c.radius)[:, full].min(axis=1))
                own = d[np.arange(len(ids)), cell][:, None]
                plane = (d * d - own * own) / np.maximum(2 * between[cell], 1e-12)
                least = np.maximum(d - c.radius, np.where(np.arange(len(c.pivot)) == cell[:, None], 0, plane))
                row, to = np.nonzero((least <= reach[:, None] + 1e-6) & (c.rows > 0))
                many = c.blocks[to]
                row, target = np.repeat(row, many), np.repeat(first[to], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                go = target != home[row]
                row, target = row[go], target[go]
                for i in range(0, len(row), 4096):
                    at = pa.array(row[i : i + 4096])
                    yield pa.record_batch([b.column("id").take(at), b.column("v").take(at), pa.array(above[row[i : i + 4096]]), pa.array(home[row[i : i + 4096]]), pa.array(target[i : i + 4096].astype(np.int32))], names=["id", "v", "above", "home", "target"])

    return met.select("id", "v", "cell", "block", "sim").mapInArrow(each, "id long, v array<double>, above double, home int, target int")


def distances(edges: DataFrame, k: int = 15) -> DataFrame:
    """id, d1, dk_mean over ranks up to k."""
    return edges.where(F.col("rank") <= k).groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("rank") == 1, F.col("dist"))).alias("d1"), F.avg("dist").alias("dk_mean"))


def gathered(edges: DataFrame, attributes: DataFrame, key: str = "id") -> DataFrame:
    """Edges with the attributes of their neighbour."""
    return edges.join(attributes.withColumnRenamed(key, "dst"), "dst")


def clustering(edges: DataFrame, k: int = 15) -> DataFrame:
    """1 - hits / (k (k - 1)): hits are neighbours of a neighbour that are neighbours too."""
    e = materialised(edges.where(F.col("rank") <= k).select("src", "dst"))  # three uses
    two = e.alias("a").join(e.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    hits = two.join(e, ["src", "dst"], "inner").groupBy("src").agg(F.count("*").alias("hits"))
    return e.select("src").distinct().join(hits, "src", "left").select(F.col("src").alias("id"), (1 - F.coalesce("hits", F.lit(0)) / F.lit(float(k * (k - 1)))).alias("bridge_cc"))


def centroids(rows: DataFrame, label: str, vector: str, centre: bool = False, scale: bool = True) -> DataFrame:
    """label, cent: mean vector of each label (after subtracting the mean of all), to unit length."""
    flat = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("p", "x"))
    mean = flat.groupBy(label, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    if centre:
        mu = rows.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("mu"))
        mean = mean.join(mu, "p").select(label, "p", (F.col("x") - F.col("mu")).alias("x"))
    cent = F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"])
    out = mean.groupBy(label).agg(cent.alias("cent"))
    return out.withColumn("cent", unit(F.col("cent"))) if scale else out


def rao_stirling(edges: DataFrame, labels: DataFrame, distance: DataFrame, k: int = 30, least: int = 10) -> DataFrame:
    """id, bridge_rs = sum p_i p_j d_ij over ordered pairs of neighbour labels; null below `least` labelled neighbours.

    labels: id, lab (null where unlabelled); distance: a, b, d for every ordered pair of labels.
    """
    near = gathered(edges.where(F.col("rank") <= k), labels).where("lab is not null").groupBy("src", "lab").agg(F.count("*").alias("c"))
    p = near.withColumn("n", F.sum("c").over(Window.partitionBy("src"))).select("src", "lab", "n", (F.col("c") / F.col("n")).alias("p"))
    pair = p.select("src", "n", F.col("lab").alias("a"), F.col("p").alias("pa")).join(p.select("src", F.col("lab").alias("b"), F.col("p").alias("pb")), "src").join(distance, ["a", "b"])
    rs = pair.groupBy("src").agg(F.sum(F.col("pa") * F.col("pb") * F.col("d")).alias("rs"), F.max("n").alias("n"))
    return edges.select("src").distinct().join(rs, "src", "left").select(F.col("src").alias("id"), F.when(F.col("n") >= least, F.col("rs")).alias("bridge_rs"))


def label_distances(cent: DataFrame, label: str) -> DataFrame:
    """a, b, d = 1 - cosine of centroids, for ordered pairs; there are as many rows as label pairs."""
    a, b = cent.select(F.col(label).alias("a"), F.col("cent").alias("ca")), cent.select(F.col(label).alias("b"), F.col("cent").alias("cb"))
    return a.join(b, F.col("a") != F.col("b")).select("a", "b", (1 - dot(F.col("ca"), F.col("cb"))).alias("d"))


def growth(edges: DataFrame, years: DataFrame, recent: int = 2023, k: int = 50) -> DataFrame:
    """id, log2 of the smoothed share of recent neighbours over the overall share. years: id, year."""
    g = years.agg(F.avg((F.col("year") >= recent).cast("double"))).first()[0]
    near = gathered(edges.where(F.col("rank") <= k), years.withColumn("r", (F.col("year") >= recent).cast("int"))).groupBy("src").agg(F.sum("r").alias("s"))
    return near.select(F.col("src").alias("id"), F.log2((F.col("s") + 2 * F.lit(g)) / F.lit(float(k + 2)) / F.lit(g)).alias("growth"))


def label_lift(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distribution of neighbours' labels, own and missing labels left out; lift against the labelled rows that aren't of the source label."""
    named = labels.where("lab is not null")
    near = gathered(edges, named).withColumnRenamed("lab", "dst_lab").join(named.select(F.col("id").alias("src"), F.col("lab").alias("src_lab")), "src").where("src_lab <> dst_lab")
    n = near.groupBy("src_lab", "dst_lab").agg(F.count("*").alias("n"))
    size = named.groupBy("lab").agg(F.count("*").alias("m"))
    total = named.count()
    share = F.col("n") / F.sum("n").over(Window.partitionBy("src_lab"))
    out = n.join(size.withColumnRenamed("lab", "dst_lab"), "dst_lab").join(size.select(F.col("lab").alias("src_lab"), F.col("m").alias("ms")), "src_lab")
    return out.select("src_lab", "dst_lab", share.alias("share"), (share / (F.col("m") / (F.lit(total) - F.col("ms")))).alias("lift"))


def lean(edges: DataFrame, labels: DataFrame, a, b) -> DataFrame:
    """id, side: more neighbours in a or in b."""
    near = gathered(edges, labels).groupBy("src").agg(F.count_if(F.col("lab") == a).alias("na"), F.count_if(F.col("lab") == b).alias("nb"))
    return near.select(F.col("src").alias("id"), "na", "nb", F.when(F.col("na") > F.col("nb"), "A").when(F.col("na") < F.col("nb"), "B").otherwise("tie").alias("side"))


def cohesion(edges: DataFrame, members: DataFrame, k: int = 30) -> DataFrame:
    """id, frac: share of a member's k neighbours that are members. members: id."""
    e = edges.where(F.col("rank") <= k).join(members.select(F.col("id").alias("src")), "src", "left_semi")
    near = e.join(members.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.count("*").alias("n"))
    return e.select("src").distinct().join(near, "src", "left").select(F.col("src").alias("id"), (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("frac"))


def recall(high: DataFrame, low: DataFrame, k: int = 15) -> DataFrame:
    """Mean share of the k neighbours that another space keeps."""
    both = high.join(low.select("src", "dst"), ["src", "dst"]).groupBy("src").agg(F.count("*").alias("n"))
    return high.select("src").distinct().join(both, "src", "left").agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def materialised(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """An edge table for several uses."""
    return (scratch or Scratch(edges.sparkSession)).table(edges)


def nearest_prototype(rows: DataFrame, prototypes: DataFrame, key: str, vector: str) -> DataFrame:
    """id, prototype, sim: the most similar of a few prototypes (id p, vector pv); ties: the smaller id."""
    few = [(r["p"], [float(x) for x in r["pv"]]) for r in prototypes.select("p", "pv").orderBy("p").collect()]
    sims = F.array(*(F.struct(F.round(dot(F.col(vector), F.array(*map(F.lit, v))), 12).alias("s"), (-F.lit(p)).alias("m")) for p, v in few))
    best: Column = F.array_max(sims)
    return rows.select(F.col(key).alias("id"), (-best["m"]).alias("prototype"), best["s"].alias("sim"))
