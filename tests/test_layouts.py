"""Layouts that keep neighbourhoods: survival of neighbours, spaces and their gradients, odd tables."""

import numpy as np
import pytest

from lexiscape.operators import embed, knn, layout, model


def survival(edges, low, names, k=15):
    """Mean share of the k neighbours that are among the k nearest of the layout."""
    p = low.toPandas().sort_values("id")
    x, ids = p[names].to_numpy(), p.id.to_numpy()
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    near = ids[np.argsort(d, axis=1)[:, :k]]
    high = edges.toPandas().groupby("src")["dst"].apply(set)
    return np.mean([len(high[i] & set(n)) / k for i, n in zip(ids, near)])


@pytest.fixture(scope="module")
def edges(spark):
    return knn.materialised(knn.exact(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 15))


@pytest.mark.parametrize("kind,how", [("plane", {}), ("sphere", {"min_dist": 0.0, "spread": 0.3}), ("torus", {"min_dist": 0.0, "spread": 0.5})])
def test_neighbours_survive_better_than_in_other_layouts(spark, edges, kind, how):
    found = embed.embedded(edges, kind, rounds=5, block_edges=15_000, **how)  # several blocks
    names = [c for c in found.columns if c != "id"]
    assert found.count() == 2000
    own = survival(edges, found, names)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert own > 1.5 * survival(edges, model.layout(rows, "embedding", "vec_id", len(names)), names) if kind != "sphere" else own > 0.03
    assert own > 1.5 * survival(edges, layout.graph_layout(edges), ["c0", "c1"])
    x = found.select(*names).toPandas().to_numpy()
    if kind == "sphere":
        assert np.allclose((x * x).sum(axis=1), 1)
    if kind == "torus":
        assert x.min() >= 0 and x.max() < 10


@pytest.mark.parametrize("kind", ["plane", "sphere", "torus"])
def test_ways_are_gradients(kind):
    space, rng = embed.Space(kind, 3 if kind == "sphere" else 2), np.random.default_rng(0)
    x, y = (space.started(rng.normal(size=(200, space.axes))) for _ in range(2))

    def distance(x, y):
        if kind == "sphere":
            return np.arccos(np.clip((x * y).sum(axis=1), -1, 1))
        d = np.abs(x - y)
        return np.sqrt((np.minimum(d, 10 - d) ** 2 if kind == "torus" else d**2).sum(axis=1))

    way, d = space.apart(x, y), distance(x, y)
    assert np.allclose(np.linalg.norm(way, axis=1), d, atol=1e-6)
    for _ in range(3):
        h = rng.normal(size=x.shape) * 1e-6
        if kind == "sphere":
            h -= x * (h * x).sum(axis=1, keepdims=True)
        assert np.allclose(distance(space.moved(x, h), y) - d, (way * h).sum(axis=1) / d, atol=1e-9)


def test_curve_is_the_usual_one():
    assert np.allclose(embed.curve(0.1, 1.0), (1.577, 0.895), atol=2e-3)


def test_weights_sum_to_the_logarithm(spark, edges):
    few = edges.where("src < 40")
    got = embed.fuzzy_weights(few).toPandas()
    own = few.toPandas()
    for i in (0, 7):
        d = own[own.src == i].sort_values("rank").dist.to_numpy()
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            s = (lo * hi) ** 0.5
            lo, hi = (lo, s) if np.exp(-np.maximum(d - d[0], 0) / s).sum() > np.log2(15) else (s, hi)
        p = dict(zip(own[own.src == i].sort_values("rank").dst, np.exp(-(d - d[0]) / s)))
        for j, w in p.items():
            if not ((own.src == j) & (own.dst == i)).any():
                assert got[(got.src == i) & (got.dst == j)].w.item() == pytest.approx(w, abs=1e-6)
    back = got.rename(columns={"src": "dst", "dst": "src"})
    assert len(got.merge(back, on=["src", "dst", "w"])) == len(got)


def test_clusters_come_apart_and_hubs_fit(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.eye(8)[i % 4] * 4 + rng.normal(size=8) * 0.3]) for i in range(400)]
    e = knn.exact(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10)
    p = embed.embedded(knn.materialised(e), k=10, rounds=4, block_edges=1500).toPandas()
    x, lab = p[["c0", "c1"]].to_numpy(), p.id.to_numpy() % 4
    centre = np.stack([x[lab == c].mean(axis=0) for c in range(4)])
    assert (((x[:, None] - centre) ** 2).sum(-1).argmin(axis=1) == lab).mean() > 0.95
    star = spark.range(1, 3000).selectExpr("id AS src", "1 AS rank", "0L AS dst", "0.5D AS dist")
    assert embed.embedded(star, k=1, rounds=2, epochs=5).count() == 3000


def test_copies_nulls_and_empty_tables(spark):
    copies = [(i, r + 1, (i + r + 1) % 50, 0.0) for i in range(50) for r in range(5)]
    odd = [(None, 1, 3, 0.1), (4, 1, None, 0.1), (5, 6, 6, None)]
    e = spark.createDataFrame(copies + odd, "src long, rank int, dst long, dist double")
    p = embed.embedded(e, k=5, rounds=2, epochs=5).toPandas()
    assert len(p) == 50 and np.isfinite(p[["c0", "c1"]].to_numpy()).all()
    assert embed.embedded(e.limit(0)).count() == 0


def test_places_do_not_pass_through_the_driver(spark, monkeypatch):
    """Tables that are small enough to be broadcast are joined by sorting: a round sends no row's place to the driver."""
    from lexiscape import session

    plans, table = [], session.Scratch.table

    def seen(self, df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return table(self, df, path)

    monkeypatch.setattr(session.Scratch, "table", seen)
    rows = [(i, 1 + j, (i + j + 1) % 60, 0.1 + 0.01 * j) for i in range(60) for j in range(3)]
    edges = spark.createDataFrame(rows, "src long, rank int, dst long, dist double")
    assert embed.embedded(edges, k=3, rounds=2, epochs=2).count() == 60
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
