"""Approximate nearest neighbours: hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample (SAMPLE rows of smallest id hash) by k-means with FAN centres a
level; every row is then assigned to a leaf. A query walks the tree with a priority queue: the most
promising branch first, by the bound |q - centre|; leaves come out in that order. How many leaves a
query visits is calibrated: leaf visits are widened on calibration queries, searched exactly against
all rows, until their recall reaches TARGET. Queries are then joined with the leaves they visit, by
shards of leaves: a query goes once to each shard, which returns its k best. A shard with many rows or
queries is split into blocks, so that a hot leaf makes more tasks, not a longer one.
Within a block, equal vectors are scored once. Scores are inner products in double precision of the
original vectors; ties go to the smaller id.

For the largest inner product, rows are searched by the cosine order of the tree on scaled vectors: a
row of norm r is given the extra component sqrt(R^2 - r^2), R the largest norm, which makes the largest
inner product the smallest distance.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, as queries or candidates; so do rows with null id. Repeated ids are separate candidates, but ask once: a
query id with several vectors asks by the smallest of them (as arrays). No query meets a row of its own id. Fewer candidates than k give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.llm import text as T
from lexiscape.session import Scratch

K, EVERY = 20, 20
SAMPLE, FAN, LEAF_ROWS, ITERATIONS = 20_000, 16, 100, 8
CALIBRATION, TARGET = 200, 0.95
SHARD_ROWS, BLOCK_QUERIES = 12_000, 1000
#: Leaves at most; the tree is sent to all tasks, 8 bytes a component of each centre.
MAX_LEAVES = 4096


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: rows that take part. The common length is the most frequent one (ties: the shorter)."""
    found = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    found = found.where(fine)
    size = found.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.where(F.size("v") == (size["n"] if size else 0))


class Tree:
    """Centres of a hierarchical k-means."""

    def __init__(self, x: np.ndarray, leaves: int, fan: int = FAN):
        self.children: list[list[int]] = [[]]
        self.centre = [x.mean(axis=0) if len(x) else np.zeros(1)]
        self.leaf: dict[int, int] = {}
        per = max(1, len(x) // max(leaves, 1))
        stack = [(0, x)]
        while stack:
            node, own = stack.pop()
            if len(own) <= per or len(self.leaf) + len(stack) >= MAX_LEAVES:
                self.leaf[node] = len(self.leaf)
                continue
            centres, label = kmeans(own, min(fan, -(-len(own) // per)))
            if len(centres) < 2:
                self.leaf[node] = len(self.leaf)
                continue
            for c in range(len(centres)):
                child = len(self.centre)
                self.centre.append(centres[c])
                self.children.append([])
                self.children[node].append(child)
                stack.append((child, own[label == c]))
        self.centres = np.array(self.centre)
        self.square = (self.centres**2).sum(axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: the nearest centre at each level."""
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node in self.leaf:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = np.array(self.children[node])
                near = (self.square[kids][None] - 2 * x[rows] @ self.centres[kids].T).argmin(axis=1)
                stack += [(k, rows[near == i]) for i, k in enumerate(kids.tolist())]
        return out

    def visits(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves, best bin first."""
        distance = self.square - 2 * (self.centres @ q)
        heap, out = [(0.0, 0)], []
        while heap and len(out) < n:
            _, node = heapq.heappop(heap)
            if node in self.leaf:
                out.append(self.leaf[node])
            else:
                for k in self.children[node]:
                    heapq.heappush(heap, (distance[k], k))
        return out


def kmeans(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's algorithm from evenly spaced rows of a fixed order; empty centres go."""
    rng = np.random.default_rng(42)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(ITERATIONS):
        label = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        used = np.unique(label)
        centres = np.array([x[label == c].mean(axis=0) for c in used])
    label = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(radius**2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(q_ids, q, ids, x, k: int, leaf=None, visits=None) -> pd.DataFrame:
    """Each query's k best of a block, by score and then id; with leaves, of the leaves that it visits."""
    if not len(q) or not len(x):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    leaf = leaf[order] if leaf is not None else None
    same, where = np.unique(x, axis=0, return_inverse=True)
    where = where.ravel()
    by = np.argsort(where, kind="stable")
    first = np.searchsorted(where[by], np.arange(len(same) + 1))
    if leaf is not None:  # equal vectors share a leaf; distinct ones are put in order of leaves
        home = leaf[by[first[:-1]]]
        order = np.argsort(home, kind="stable")
        same, home = same[order], home[order]
        by = np.concatenate([by[first[c] : first[c + 1]] for c in order])
        first = np.concatenate([[0], np.cumsum(np.diff(first)[order])])
    count = np.diff(first)
    q_ids, m = np.asarray(q_ids), min(len(same), k + 1)
    out = []
    for at in range(0, len(q), 256):
        part, names = q[at : at + 256], q_ids[at : at + 256]
        if leaf is None:
            rough = part @ same.T
        else:
            rough = np.full((len(part), len(same)), -np.inf)
            goes, asks = np.concatenate(visits[at : at + 256]), np.repeat(np.arange(len(part)), [len(v) for v in visits[at : at + 256]])
            by_leaf = np.argsort(goes, kind="stable")
            goes, asks = goes[by_leaf], asks[by_leaf]
            for c in np.unique(goes):
                lo, hi = np.searchsorted(home, (c, c + 1))
                if hi > lo:
                    own = asks[np.searchsorted(goes, c) : np.searchsorted(goes, c, "right")]
                    rough[own, lo:hi] = part[own] @ same[lo:hi].T
        near = np.argpartition(-rough, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(rough, near, 1)
        cut = value.min(axis=1)
        # several vectors at the cut, or copies of a vector among the best: one query at a time
        plain = ~np.isfinite(cut) & (count == 1).all() | ((rough >= (cut - 1e-9 * np.maximum(1.0, np.abs(cut)))[:, None]).sum(axis=1) == m) & (count[near] == 1).all(axis=1)
        rows, score = by[first[near[plain]]], (same[near[plain]] * part[plain][:, None]).sum(axis=2)
        score = np.where((ids[rows] == names[plain][:, None]) | ~np.isfinite(value[plain]), -np.inf, score)
        order = np.lexsort((ids[rows], -score), axis=1)[:, :k]
        found, best = np.take_along_axis(ids[rows], order, 1), np.take_along_axis(score, order, 1)
        real = np.isfinite(best)
        out.append(pd.DataFrame({"query_id": np.repeat(names[plain], real.sum(axis=1)), "vec_id": found[real], "score": best[real]}))
        out += [_one(names[i], part[i], rough[i], cut[i], ids, same, by, first, k) for i in np.flatnonzero(~plain).tolist()]
    return pd.concat(out, ignore_index=True)


def _one(name, q, rough, cut, ids, same, by, first, k: int) -> pd.DataFrame:
    """A query where ties or copies matter: of equal vectors the smallest ids that can count are taken."""
    near = np.flatnonzero(np.isfinite(rough) & (rough >= (cut - 1e-9 * max(1.0, abs(cut)) if np.isfinite(cut) else -np.inf)))
    if not len(near):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    score = (same[near] * q).sum(axis=1)
    took = [by[first[c] : first[c + 1]][: k + 1 + _own(ids, by[first[c] : first[c + 1]], name)] for c in near]
    cand, value = np.concatenate(took), np.repeat(score, [len(x) for x in took])
    keep = ids[cand] != name
    cand, value = cand[keep], value[keep]
    best = np.lexsort((ids[cand], -value))[:k]
    return pd.DataFrame({"query_id": name, "vec_id": ids[cand[best]], "score": value[best]})


def _own(ids, rows, q) -> int:
    """How often a query's own id stands among rows."""
    own = ids[rows]
    return int(np.searchsorted(own, q, "right") - np.searchsorted(own, q, "left"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(spark, rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """A few queries against all rows, by blocks."""
    shared = spark.sparkContext.broadcast((q_ids, q))

    def each(batches):
        for b in batches:
            got = nearest(*shared.value, b.column("id").to_numpy(), _matrix(b.column("v")), k)
            yield pa.RecordBatch.from_pandas(got, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), preserve_index=False)

    return _best(rows.select("id", "v").mapInArrow(each, "query_id long, vec_id long, score double"), k).toPandas()


def search(rows: DataFrame, every: int = EVERY, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found for each row whose id is divisible by `every`."""
    spark = rows.sparkSession
    scratch = Scratch(spark)
    rows = scratch.table(usable(rows))
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = T.sample(rows, SAMPLE, "id").toPandas()
    tree = Tree(lifted(np.stack(sample["v"].to_numpy()), norm), min(MAX_LEAVES, -(-n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast((tree, norm))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, norm = shared.value
        for b in batches:
            leaf = tree.assign(lifted(_matrix(b.column("v")), norm)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.record_batch([b.column("id"), b.column("v"), pa.array(leaf.astype(np.int32))], names=["id", "v", "leaf"])

    leaves = scratch.table(rows.mapInArrow(assign, "id long, v array<double>, leaf int"))
    size = {r["leaf"]: r["count"] for r in leaves.groupBy("leaf").count().collect()}  # a row a leaf
    # calibration: exact neighbours of a bounded set of queries, and the leaf visit at which each is met
    asking = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    probe = T.sample(asking, CALIBRATION, "id").toPandas()
    visits = len(tree.leaf)
    if len(probe):
        q_ids, q = probe["id"].to_numpy(), np.stack(probe["v"].to_numpy())
        truth = _exact(spark, rows, q_ids, q, k)
        wanted = spark.createDataFrame(pd.DataFrame({"id": truth["vec_id"].unique()}), "id long") if len(truth) else None
        home = {r["id"]: r["leaf"] for r in leaves.join(wanted, "id").select("id", "leaf").collect()} if wanted is not None else {}
        place = {i: {leaf: p for p, leaf in enumerate(tree.visits(lifted_query(x), len(tree.leaf)))} for i, x in zip(q_ids.tolist(), q)}
        met = np.sort([place[a][home[b]] for a, b in zip(truth["query_id"].tolist(), truth["vec_id"].tolist())])
        visits = int(met[min(len(met) - 1, int(np.ceil(target * len(met))) - 1)]) + 1 if len(met) else visits
    # consecutive leaves make a shard of about SHARD_ROWS rows; a leaf that is larger is cut into row blocks
    shard_of, shards, held = np.zeros(len(tree.leaf), np.int64), 0, 0
    for leaf in range(len(tree.leaf)):
        c = size.get(leaf, 0)
        if held and held + c > SHARD_ROWS:
            shards, held = shards + 1, 0
        shard_of[leaf], held = shards, held + c
    filled = np.bincount(shard_of, [size.get(leaf, 0) for leaf in range(len(tree.leaf))], shards + 1)
    row_blocks = np.maximum(1, -(-filled // SHARD_ROWS)).astype(int)
    told = spark.sparkContext.broadcast((tree, visits, shard_of))

    def route(batches):
        tree, visits, shard_of = told.value
        for b in batches:
            at, shard, go = [], [], []
            for i, x in enumerate(_matrix(b.column("v"))):
                leaves = np.sort(np.array(tree.visits(lifted_query(x), visits), np.int64))
                own = shard_of[leaves]
                for s in np.unique(own):
                    at.append(i)
                    shard.append(s)
                    go.append(leaves[own == s])
            yield pa.record_batch([b.column("id").take(pa.array(at, pa.int64())), b.column("v").take(pa.array(at, pa.int64())), pa.array(np.array(shard, np.int32)), pa.array(go, pa.list_(pa.int64()))], names=["id", "v", "shard", "go"])

    queries = scratch.table(asking.mapInArrow(route, "id long, v array<double>, shard int, go array<long>"))
    asked = {r["shard"]: r["count"] for r in queries.groupBy("shard").count().collect()}
    split = spark.createDataFrame([(s, int(row_blocks[s]), max(1, -(-asked.get(s, 0) // BLOCK_QUERIES))) for s in range(shards + 1)], "shard int, row_blocks int, query_blocks int")  # at most MAX_LEAVES rows
    homes = spark.createDataFrame([(leaf, int(s)) for leaf, s in enumerate(shard_of)], "leaf int, shard int")
    left = leaves.join(F.broadcast(homes), "leaf").join(F.broadcast(split), "shard").withColumn("rb", F.pmod(F.xxhash64("id"), "row_blocks").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("shard", "rb", "qb", "id", "v", "leaf")
    right = queries.join(F.broadcast(split), "shard").withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), "query_blocks").cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).select("shard", "rb", "qb", "id", "v", "go")

    def meet(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty or q.empty:
            return nearest([], [], [], [], k)
        return nearest(q["id"].to_numpy(), np.stack(q["v"].to_numpy()), x["id"].to_numpy(), np.stack(x["v"].to_numpy()), k, x["leaf"].to_numpy(), list(q["go"]))

    found = left.groupBy("shard", "rb", "qb").cogroup(right.groupBy("shard", "rb", "qb")).applyInPandas(meet, "query_id long, vec_id long, score double")
    return _best(found, k)


def lifted_query(q: np.ndarray) -> np.ndarray:
    return np.append(q, 0.0)
