"""Connected components by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscape.session import Scratch

MAX_ROUNDS = 40


#: Edges that one task may take (16 bytes each).
WHOLE = 1_000_000


#: Edges that a task links among themselves before edges are shuffled.
LINKED = 1 << 20


def _lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, and of each the smallest one that these edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, low = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:  # each end takes the smaller name of both, then names are followed to their own names
        x, y = low[a], low[b]
        if (x == y).all():
            return nodes, nodes[low]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


def _whole(pdf: pd.DataFrame) -> pd.DataFrame:
    node, component = _lowest(pdf.u.to_numpy(), pdf.v.to_numpy())
    return pd.DataFrame({"node": node, "component": component})


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components by fewer edges: of each LINKED edges, one from every node to the smallest that they reach."""
    held: list[pa.RecordBatch] = []

    def linked() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, low = _lowest(*(t[c].to_numpy() for c in ("u", "v")))
        own = node != low
        return pa.record_batch([pa.array(node[own], t.schema.field("u").type), pa.array(low[own], t.schema.field("v").type)], names=["u", "v"])

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LINKED:
            yield linked()
            held = []
    if held:
        yield linked()


def connected_components(edges: DataFrame, scratch: Scratch | None = None, whole: int = 0) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node reachable.

    A graph of integer nodes with at most `whole` different edges goes to one task (off where not asked for); others:

    Tasks first link the edges that they hold anyway, which leaves at most an edge a node of each LINKED edges. Then
    large-star and small-star steps alternate until the edges form stars; the number of rounds
    grows with the logarithm of the largest component. Each step aggregates before it joins, so
    that a hub costs one row a task in the aggregation, and each round is written to the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    e = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if whole and e.count() <= whole:
        return e.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(lambda pdf: _whole(pdf), "node long, component long")
    kinds = dict(e.dtypes)
    linked = scratch.table(e.mapInArrow(_stars, f"u {kinds['u']}, v {kinds['v']}").distinct())
    scratch.drop(e)
    e, before = linked, None
    for _ in range(MAX_ROUNDS):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        after = scratch.table(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e)
        e = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def followed(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """c, root: pointers (c, o) followed until they end in themselves, three steps of the last round at once."""
    now = scratch.table(pointers.select("c", F.col("o").alias("root")))
    while True:
        hop = now.select(F.col("c").alias("at"), F.col("root").alias("next"))
        two = now.withColumn("at", F.col("root")).join(hop, "at").select("c", "root", F.col("next").alias("at")).join(hop, "at")
        after = scratch.table(two.select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        scratch.drop(now)
        if not after.where("moved").limit(1).count():
            return after.select("c", "root")
        now = after


def component_sizes(edges: DataFrame, nodes: DataFrame, scratch: Scratch | None = None, whole: int = 0) -> DataFrame:
    """component, n of the undirected graph on some nodes (id) only, isolated ones included."""
    kept = edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi")
    comp = connected_components(kept.select("a", "b"), scratch, whole)
    own = nodes.select(F.col("id").alias("node")).distinct().join(comp, "node", "left")
    return own.groupBy(F.coalesce("component", "node").alias("component")).agg(F.count("*").alias("n"))
