"""Spanning forests and density clusters against plain versions."""

import random

import numpy as np
import pandas as pd
import pytest

from lexiscape.operators import density, knn


def plain_forest(edges):
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for w, a, b in sorted({(w, min(a, b), max(a, b)) for a, b, w in edges if a != b}):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((a, b, w))
    return sorted(out)


def plain_clusters(pdf, least):
    """Excess of mass over the single-linkage tree."""
    ids = np.unique(np.concatenate([pdf.a, pdf.b]))
    at = {int(x): i for i, x in enumerate(ids)}
    n = len(ids)
    parent, node = list(range(n)), list(range(n))
    size, kids, level = [1] * n, [()] * n, [0.0] * n

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, w in pdf.sort_values(["w", "a", "b"])[["a", "b", "w"]].itertuples(index=False):
        x, y = find(at[int(a)]), find(at[int(b)])
        if x != y:
            parent[y] = x
            size.append(size[node[x]] + size[node[y]])
            kids.append((node[x], node[y]))
            level.append(float(w))
            node[x] = len(size) - 1
    stability: dict[int, float] = {}
    below: dict[int, list[int]] = {}

    def members(t):
        stack, out = [t], []
        while stack:
            u = stack.pop()
            stack += kids[u]
            if u < n:
                out.append(u)
        return out

    chosen: list[int] = []
    order, stack = [], [(node[r], 0.0) for r in {find(i) for i in range(n)} if size[node[r]] >= least]
    while stack:
        top, birth = stack.pop()
        order.append(top)
        score, t = 0.0, top
        while True:
            lam = 1 / max(level[t], 1e-12)
            big = [k for k in kids[t] if size[k] >= least]
            if len(big) == 1:
                score += (lam - birth) * (size[t] - size[big[0]])
                t = big[0]
                continue
            score += (lam - birth) * size[t]
            below[top] = big if len(big) == 2 else []
            stack += [(k, lam) for k in below[top]]
            break
        stability[top] = score
    best: dict[int, float] = {}
    picked: dict[int, list[int]] = {}
    for top in reversed(order):
        lower = sum(best[k] for k in below[top])
        if below[top] and lower > stability[top]:
            best[top], picked[top] = lower, [x for k in below[top] for x in picked[k]]
        else:
            best[top], picked[top] = stability[top], [top]
    roots = [t for t in order if not any(t in b for b in below.values())]
    chosen = sorted((x for r in roots for x in picked[r]), key=lambda t: min(members(t)))
    out = np.full(n, -1)
    for c, t in enumerate(chosen):
        out[members(t)] = c
    return pd.DataFrame({"id": ids, "cluster": out})


def random_graph(seed, n, ties=False):
    """Clumps of several densities, with bridges and a few rows apart."""
    rng = random.Random(seed)
    edges, at = [], [(rng.choice([0, 0, 8, 8, 8, 20]) + rng.gauss(0, rng.choice([0.3, 1, 2])), rng.choice([0, 9]) + rng.gauss(0, 1)) for _ in range(n)]
    for i in range(n):
        d = sorted((((at[i][0] - x) ** 2 + (at[i][1] - y) ** 2) ** 0.5, j) for j, (x, y) in enumerate(at) if j != i)[:4]
        edges += [(i, j, float(round(w)) if ties else w) for w, j in d]
    return edges + [(10_000 + i, 10_001 + i, 0.1 * i + 0.05) for i in range(3)] + [(7, 7, 0.0)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, w double")


@pytest.mark.parametrize("ties", [False, True])
def test_forest(spark, ties):
    edges = random_graph(3, 150, ties)
    edges += [(b, a, w + 1) for a, b, w in edges[::5]]
    assert sorted(tuple(r) for r in density.spanning_forest(frame(spark, edges)).collect()) == plain_forest(edges)


@pytest.mark.parametrize("seed,most", [(1, 40), (4, 10_000)])
def test_condensed_tree_in_ranges(spark, seed, most):
    forest = plain_forest(random_graph(seed, 160))
    want = plain_clusters(pd.DataFrame(forest, columns=["a", "b", "w"]), 6)
    got = density.condensed(frame(spark, forest), 6, most=most).toPandas().sort_values("id")
    assert got.id.tolist() == want.id.tolist() and got.cluster.tolist() == want.cluster.tolist()
    assert want.cluster.nunique() > 3


def test_no_part_holds_the_graph(spark, monkeypatch):
    """A chain of rising weights, where the whole is one growing component."""
    forest = [(i, i + 1, 1.0 + i / 1000) for i in range(60)]
    sizes, plain = [], density._merged

    def seen(e, s, least):
        assert len(e) <= 20
        return plain(e, s, least)

    monkeypatch.setattr(density, "_merged", seen)
    got = density.condensed(frame(spark, forest), 10, most=20).toPandas().sort_values("id")
    want = plain_clusters(pd.DataFrame(forest, columns=["a", "b", "w"]), 10)
    assert got.cluster.tolist() == want.cluster.tolist()


def test_clusters_of_neighbours(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.eye(6)[i % 3] * 5 + rng.normal(size=6) * 0.2]) for i in range(60)]
    e = knn.materialised(knn.exact(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 12))
    got = density.density_clusters(e, 10).toPandas()
    labels = got[got.cluster >= 0].groupby(got.id % 3).cluster.nunique()
    assert got.cluster.nunique() >= 3 and (labels == 1).all()
    own = density.reachability(e).toPandas()
    want = plain_clusters(own[["a", "b", "w"]], 10)
    assert dict(zip(got.id, got.cluster)) == dict(zip(want.id, want.cluster))


def test_empty_graph(spark):
    assert density.condensed(frame(spark, []), 5).count() == 0
