"""Density clusters over a neighbour graph: minimum spanning forest and condensed tree, by joins.

The forest is Borůvka's: each component picks its least edge (a grouped minimum), picks point from component to component,
pointers are followed to their ends, and parallel edges between components are reduced to their least. The tree is then built from
the bottom. Forest edges come in ranges by weight; in a range, edges join components so far, and each connected part of
the range is merged in a task of its own, which knows of every component only its size and the running sums of its
present cluster. A range takes half of the edges that are left, or less, until no part has more than RANGE edges: a task's
work is bounded by RANGE, whatever the graph.

Sums: a cluster's stability is the sum over its rows of (1 / level at which a row leaves - 1 / level at which the cluster was born).
From the bottom the leaving levels are met first, so that the sum is kept as two numbers, and the birth is
subtracted when the cluster meets another one of its size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscape.operators.graph import connected_components, followed
from lexiscape.operators.mapserve import dense_id
from lexiscape.session import Scratch

#: Forest edges that a connected part of a range may have.
RANGE = 1 << 16


def reachability(edges: DataFrame, min_samples: int = 5) -> DataFrame:
    """a, b, w: neighbour pairs by the largest of their distance and both ends' distances to their min_samples-th neighbour."""
    core = edges.where(F.col("rank") == min_samples).select(F.col("src").alias("id"), F.col("dist").alias("core"))
    w = edges.join(core.withColumnRenamed("id", "src").withColumnRenamed("core", "c1"), "src").join(core.withColumnRenamed("id", "dst").withColumnRenamed("core", "c2"), "dst")
    return w.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min(F.greatest("dist", "c1", "c2")).alias("w"))


def spanning_forest(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """a, b, w of the minimum spanning forest of undirected edges (a, b, w); equal weights in order of a and b."""
    scratch = scratch or Scratch(edges.sparkSession)
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = scratch.table(edges.where("a <> b and w is not null").groupBy(low.alias("a"), high.alias("b")).agg(F.min("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    parts = []
    while e.limit(1).count():
        both = e.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "w", "a", "b").unionByName(e.select(F.col("cb").alias("c"), F.col("ca").alias("o"), "w", "a", "b"))
        pick = scratch.table(both.groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("x")).select("c", "x.*"))
        parts.append(pick.select("a", "b", "w"))
        other = pick.select(F.col("c").alias("o"), F.col("a").alias("oa"), F.col("b").alias("ob"))
        mutual = (F.col("a") == F.col("oa")) & (F.col("b") == F.col("ob")) & (F.col("c") < F.col("o"))  # two that pick one edge: the smaller is the end
        root = followed(pick.join(other, "o").select("c", F.when(mutual, F.col("c")).otherwise(F.col("o")).alias("o")), scratch)
        t = e.join(root.select(F.col("c").alias("ca"), F.col("root").alias("ra")), "ca").join(root.select(F.col("c").alias("cb"), F.col("root").alias("rb")), "cb").where("ra <> rb")
        least = t.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min(F.struct("w", "a", "b")).alias("x"))
        after = scratch.table(least.select("x.a", "x.b", "x.w", "ca", "cb"))
        scratch.drop(e)
        e = after
    out = e.select("a", "b", "w")
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()  # two components may have picked one edge


_STATE = "sup long, size long, cluster long, leaving double, counted double, lower double, split boolean"
_EVENT = "kind string, sup long, target long, size long, cluster long, leaving double, counted double, lower double, split boolean, wins boolean"


def _worth(s: dict, born: float) -> tuple[float, bool]:
    """A cluster's best value, and whether it is its own rather than that of the clusters below."""
    own = s["leaving"] - born * s["counted"]
    return (s["lower"], False) if s["split"] and s["lower"] > own else (own, True)


def _merged(edges: pd.DataFrame, states: pd.DataFrame, least: int) -> pd.DataFrame:
    """Merges one connected part of a range; a new cluster is named by the place of the edge that makes it."""
    state = {r["sup"]: dict(r) | {"members": [r["sup"]]} for r in states.to_dict("records")}
    for s in state.values():
        s["cluster"] = None if pd.isna(s["cluster"]) else int(s["cluster"])
    parent = {x: x for x in state}
    events: list[dict] = []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def assign(s: dict, cluster: int) -> None:
        events.extend({"kind": "assign", "sup": m, "target": cluster} for m in s["loose"])

    for s in state.values():
        s["loose"] = [s["sup"]] if s["size"] < least else []
    for pos, w, sa, sb in edges.sort_values("uid")[["uid", "w", "sa", "sb"]].itertuples(index=False):
        x, y = state[find(sa)], state[find(sb)]
        if x["size"] < y["size"]:
            x, y = y, x
        lam, size = 1 / max(w, 1e-12), x["size"] + y["size"]
        if y["size"] >= least:
            lower = 0.0
            for s in (x, y):
                value, wins = _worth(s, lam)
                lower += value
                events.append({"kind": "final", "cluster": s["cluster"], "target": int(pos), "wins": wins})
            x |= {"cluster": int(pos), "leaving": lam * size, "counted": float(size), "lower": lower, "split": True}
        elif x["size"] >= least:
            assign(y, x["cluster"])
            x["leaving"] += lam * y["size"]
            x["counted"] += y["size"]
        elif size >= least:
            x |= {"cluster": int(pos), "leaving": lam * size, "counted": float(size), "lower": 0.0, "split": False}
            for s in (x, y):
                assign(s, int(pos))
            x["loose"] = []
        else:
            x["loose"] += y["loose"]
        x["size"] = size
        parent[y["sup"]] = x["sup"]
    for x in state:
        r = find(x)
        events.append({"kind": "move", "sup": x, "target": r})
        if r == x:
            events.append({"kind": "state", **{k: state[x][k] for k in ("sup", "size", "cluster", "leaving", "counted", "lower", "split")}})
    out = pd.DataFrame(events, columns=[c.split()[0] for c in _EVENT.split(", ")])
    return out.astype({c: "Int64" for c in ("sup", "target", "size", "cluster")} | {c: "boolean" for c in ("split", "wins")} | {c: "float64" for c in ("leaving", "counted", "lower")})


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def condensed(forest: DataFrame, least: int = 25, scratch: Scratch | None = None, most: int | None = None) -> DataFrame:
    """id, cluster: the clusters with the largest excess of mass in the tree of a spanning forest (a, b, w); -1: noise.

    Clusters are numbered by their smallest id. `most`: edges that a task may merge.
    """
    spark, most = forest.sparkSession, most or RANGE
    scratch = scratch or Scratch(spark)
    f = scratch.table(dense_id(forest.select("a", "b", "w", F.struct("w", "a", "b").alias("k")), "k").drop("k"))
    total, lo = f.count(), 0
    ends = f.select(F.col("a").alias("id")).unionByName(f.select(F.col("b").alias("id"))).distinct()
    at = scratch.table(ends.select("id", F.col("id").alias("sup")))
    none = lambda kind: F.lit(None).cast(kind)
    state = scratch.table(ends.select(F.col("id").alias("sup"), F.lit(1).cast("long").alias("size"), none("long").alias("cluster"), F.lit(0.0).alias("leaving"), F.lit(0.0).alias("counted"), F.lit(0.0).alias("lower"), F.lit(False).alias("split")))
    assigned, finals = [], []
    while lo < total:
        hi = min(total, lo + max(most, (total - lo) // 2))
        while True:
            own = f.where((F.col("uid") >= lo) & (F.col("uid") < hi)).join(at.select(F.col("id").alias("a"), F.col("sup").alias("sa")), "a").join(at.select(F.col("id").alias("b"), F.col("sup").alias("sb")), "b")
            own = scratch.table(own.select("uid", "w", "sa", "sb"))
            if hi - lo <= most:  # few enough edges for one task, whatever parts they have
                parted, joined = own.withColumn("part", F.lit(lo)), own.select(F.explode(F.array("sa", "sb")).alias("sup")).distinct().withColumn("part", F.lit(lo))
                break
            part = scratch.table(connected_components(own.select(F.col("sa").alias("a"), F.col("sb").alias("b")), scratch))
            parted, joined = own.join(part.select(F.col("node").alias("sa"), F.col("component").alias("part")), "sa"), part.select(F.col("node").alias("sup"), F.col("component").alias("part"))
            if parted.groupBy("part").count().agg(F.max("count")).first()[0] <= most:
                break
            hi = lo + max(most, (hi - lo) // 2)
            scratch.drop(own, part)
        known = state.join(joined, "sup")
        got = scratch.table(parted.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(lambda e, s: _merged(e, s, least), _EVENT))
        assigned.append(scratch.table(at.join(got.where("kind = 'assign'").select("sup", F.col("target").alias("cluster")), "sup").select("id", "cluster")))
        finals.append(got.where("kind = 'final'").select("cluster", F.col("target").alias("parent"), "wins"))
        moves = got.where("kind = 'move'").select("sup", "target")
        now = scratch.table(at.join(moves, "sup", "left").select("id", F.coalesce("target", "sup").alias("sup")))
        new = scratch.table(state.join(moves, "sup", "left_anti").unionByName(got.where("kind = 'state'").select(*state.columns)))
        scratch.drop(at, state, own)
        at, state, lo = now, new, hi
    roots = state.where("cluster is not null")
    ends_of = roots.select("cluster", none("long").alias("parent"), (~(F.col("split") & (F.col("lower") > F.col("leaving")))).alias("wins"))  # born at level infinity
    tree = _union([*finals, ends_of], spark, "cluster long, parent long, wins boolean")
    up = scratch.table(tree.select("cluster", F.col("parent").alias("jump"), F.when(F.col("wins"), F.col("cluster")).alias("top")))
    while up.where("jump is not null").limit(1).count():
        above = up.select(F.col("cluster").alias("jump"), F.col("jump").alias("next"), F.col("top").alias("higher"))
        after = scratch.table(up.join(above, "jump", "left").select("cluster", F.col("next").alias("jump"), F.coalesce("higher", "top").alias("top")))
        scratch.drop(up)
        up = after
    rows = scratch.table(_union(assigned, spark, "id long, cluster long").join(up.select("cluster", "top"), "cluster").where("top is not null").select("id", "top"))
    number = dense_id(rows.groupBy("top").agg(F.min("id").alias("least")), "least", "n").select("top", F.col("n").cast("int").alias("n"))
    return ends.join(rows.join(number, "top"), "id", "left").select("id", F.coalesce("n", F.lit(-1)).alias("cluster"))


def density_clusters(edges: DataFrame, min_cluster: int = 25, min_samples: int = 5) -> DataFrame:
    """id, cluster (-1: noise) of a neighbour table (src, rank, dst, dist): clusters by density, whatever their number."""
    scratch = Scratch(edges.sparkSession)
    w = scratch.table(reachability(edges, min_samples))
    return condensed(scratch.table(spanning_forest(w, scratch)), min_cluster, scratch)
