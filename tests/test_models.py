"""Transport by year, pair accuracy and split regions against plain versions."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiscape.operators import model, ranks, terrain


def test_rank_correlation_by_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "a": np.round(rng.normal(size=400), 1), "b": np.round(rng.normal(size=400), 1)})
    got = {r["g"]: r["rho"] for r in ranks.group_spearman(spark.createDataFrame(pdf).repartition(4), "g", "a", "b").collect()}
    for g, own in pdf.groupby("g"):
        assert got[g] == pytest.approx(own.a.rank().corr(own.b.rank()))


@pytest.fixture(scope="module")
def transported(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) + (3 if i % 7 == 6 else 0)], 2019 + i % 7) for i in range(420)] + [(900, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, year int")
    how = dict(least_past=120, standards=50, chunk=40, components=4, grid=((0.1,), (0.05,)))
    return df, how, model.transported(df, "vec_id", "embedding", "year", **how)


def test_draws_are_disjoint_and_years_are_whole(spark, transported):
    df, how, (ids, met) = transported
    got = met.toPandas()
    assert set(got.year) == {2021, 2022, 2023, 2024, 2025} and got.surplus.between(0, 1).all()
    for (y, d), own in got.groupby(["year", "draw"]):
        assert own.standard.sum() == 50 and sorted(own[~own.standard].id) == [i for i in range(420) if 2019 + i % 7 == y]
        assert all(2019 + i % 7 < y for i in own[own.standard].id) and own[own.standard].id.is_unique
    s = model.surplus(df, "vec_id", "embedding", "year", **how).toPandas()
    assert len(s) == 421 and s.uot_surplus.notna().sum() == 300


def test_transport_is_the_plain_one(spark, transported):
    """Masses of one year and draw, from standards found anew by their hashes."""
    df, how, (_, met) = transported
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.select("vec_id", "year", array_to_vector("embedding").alias("f"))
    p = PCA(k=4, inputCol="f", outputCol="p").fit(vec).transform(vec).select("vec_id", "year", vector_to_array("p").alias("p"), F.xxhash64("vec_id").alias("h"), F.xxhash64("vec_id", F.lit(2023), F.lit(1)).alias("s")).toPandas()
    x = np.array(p.p.tolist())
    x = x - x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    past = p[p.year < 2023].assign(m=lambda t: t.s % 1_000_003).sort_values(["m", "s", "vec_id"]).index
    order = x[p.sort_values("h").index[:2000]]
    scale = np.maximum(0, 1 - order @ order.T).mean()
    own = met.where("year = 2023 and draw = 1").toPandas().set_index("id").surplus
    for chosen in [p[(p.year == 2023) & (p.h % 2 == c)].index for c in (0, 1)] + [past[50:100]]:
        kept, _ = model.sinkhorn(np.maximum(0, 1 - x[chosen] @ x[past[:50]].T) / scale, 0.1, 0.05)
        assert np.allclose(own[p.vec_id[chosen]].to_numpy(), np.clip(1 - kept, 0, 1), atol=1e-6)


def test_years_of_surplus(spark, transported):
    _, _, (_, met) = transported
    pdf, got = met.toPandas(), model.surplus_years(met).toPandas().set_index("year")
    for y, own in pdf.groupby("year"):
        base = own[own.standard].groupby("draw").surplus
        mean = own[~own.standard].groupby("id").surplus.mean()
        a, b = (own[(own.draw == d) & ~own.standard].set_index("id").surplus for d in (0, 1))
        want = [len(mean), mean.median(), mean.quantile(0.75), base.median().mean(), base.quantile(0.75).mean(), a.rank().corr(b.reindex(a.index).rank())]
        assert got.loc[y, ["n", "median", "p75", "base_median", "base_p75", "reliability"]].tolist() == pytest.approx(want)
    assert got.loc[2025, "median"] > got.loc[2025, "base_median"] + 0.1  # the year that lies elsewhere


def test_pair_accuracy_is_the_plain_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    lab = rng.integers(0, 4, 500)
    x = rng.normal(size=(500, 6)) + np.eye(6)[lab] * np.array([0, 0.8, 1.5, 4])[lab][:, None]
    df = spark.createDataFrame([(i, int(lab[i]), [float(v) for v in x[i]]) for i in range(500)] + [(900, None, [0.0] * 6)], "vec_id long, label int, embedding array<double>").repartition(5)
    got = {(r["a"], r["b"]): r["bal_acc"] for r in model.pair_accuracy(df, "label", "embedding", folds=3, components=4).collect()}
    monkeypatch.setattr(model, "PAIR_BYTES", 1)  # a pass a pair
    assert got == pytest.approx({(r["a"], r["b"]): r["bal_acc"] for r in model.pair_accuracy(df, "label", "embedding", folds=3, components=4).collect()})
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = df.where("label is not null").select("vec_id", "label", F.pmod(F.xxhash64("vec_id"), F.lit(3)).alias("fold"), array_to_vector("embedding").alias("v"))
    p = PCA(k=4, inputCol="v", outputCol="p").fit(vec).transform(vec).select("label", "fold", vector_to_array("p").alias("p")).toPandas()
    assert list(got) == list(combinations(range(4), 2))
    for a, b in got:
        own, fair = p[p.label.isin([a, b])], []
        z, y, fold = np.c_[np.array(own.p.tolist()), np.ones(len(own))], (own.label == b).to_numpy(), own.fold.to_numpy()
        for f in range(3):
            t, w = fold != f, np.zeros(5)
            c = np.where(y[t], t.sum() / 2 / y[t].sum(), t.sum() / 2 / (~y[t]).sum())
            for _ in range(4000):  # plain descent
                s = 1 / (1 + np.exp(-z[t] @ w))
                w -= (z[t].T @ (c * (s - y[t])) + np.r_[w[:4], 0]) * 0.002
            hit = (z[~t] @ w > 0) == y[~t]
            fair.append((hit[y[~t]].mean() + hit[~y[~t]].mean()) / 2)
        assert got[a, b] == pytest.approx(np.mean(fair), abs=0.005)
    assert got[0, 3] > 0.95 > got[0, 1]


def test_split_regions_costs_no_more(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 0.1, (150, 3)) for c in ([1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 0], [-1, 0, 0], [0, -1, 0])])
    region = np.r_[np.zeros(600, int), np.ones(300, int)] + 1
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(5000 + i, 9.0, 9.0, 9.0) for i in range(20)], "id long, x double, y double, z double")
    at = spark.createDataFrame([(i, int(r)) for i, r in enumerate(region)] + [(5000 + i, 3) for i in range(20)], "id long, region int")
    got = terrain.split_regions(pts, at, 150).toPandas().set_index("id").sector
    assert len(got) == 920 and set(got[got.index >= 5000]) == {3001}
    for r, k in ((1, 4), (2, 2)):
        own = x[region == r]
        cut = got.loc[np.flatnonzero(region == r)].to_numpy()
        assert set(cut) <= {r * 1000 + c + 1 for c in range(k)}
        cost = sum(((own[cut == s] - own[cut == s].mean(axis=0)) ** 2).sum() for s in set(cut))
        rows = spark.createDataFrame([(p.tolist(),) for p in own], "v array<double>").select(array_to_vector("v").alias("features"))
        assert cost <= 1.001 * min(KMeans(k=k, seed=s).fit(rows).summary.trainingCost for s in range(2))


def test_sectors_of_a_thousand_parts_are_their_own(spark):
    x = np.random.default_rng(4).normal(size=(2160, 3))
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    at = spark.createDataFrame([(i, 1 + (i >= 2100)) for i in range(2160)], "id long, region int")
    got = terrain.split_regions(pts, at, 2, rounds=1).toPandas().set_index("id").sort_index()
    first, second = set(got.sector[:2100]), set(got.sector[2100:])
    assert len(first) > 900 and max(first) - min(first) > 1000 and not first & second
    assert (got.region == np.where(got.index < 2100, 1, 2)).all() and (got.sector // 10_000 == got.region).all()


def test_nearest_centres_and_starts_meet_few_pairs(monkeypatch):
    """Both equal the plain form on copies, clumps, ties and spheres, and the pairs that meet grow as the points do, not as points times centres."""

    def plain(x, k, rng):
        found = [rng.integers(len(x))]
        far = ((x - x[found[0]]) ** 2).sum(axis=1)
        while len(found) < k:
            found.append(rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(x)))
            far = np.minimum(far, ((x - x[found[-1]]) ** 2).sum(axis=1))
        return found

    rng = np.random.default_rng(8)
    ball = lambda n: (lambda g: g / np.linalg.norm(g, axis=1, keepdims=True))(rng.normal(size=(n, 3)))
    clumps = np.concatenate([np.ones((2000, 3)), rng.normal(size=(1000, 3)) * 1e-6, rng.normal(size=(1000, 3))])
    for x in (ball(4000), clumps, np.ones((1500, 3)), rng.integers(0, 6, (4000, 3)).astype(float), ball(3)):
        for k in (1, 5, 150):
            for c in (x[rng.choice(len(x), k)], x[rng.choice(len(x), k)] + rng.normal(size=(k, 3)) / 9):
                d = ((x[:, None] - c) ** 2).sum(axis=2)
                to, cost = terrain.nearest_centre(x, c)
                assert (to == d.argmin(axis=1)).all() and (cost == d.min(axis=1)).all()
            draws = lambda: [np.random.default_rng([s, 2]) for s in range(2)]
            assert [list(f) for f in terrain.spread_starts(x, k, draws())] == [plain(x, k, r) for r in draws()]
    odd = ball(600)
    odd[3] = np.nan
    c = ball(30)
    assert (terrain.nearest_centre(odd, c)[0] == ((odd[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert len(terrain.nearest_centre(np.zeros((0, 3)), c)[0]) == 0
    met, squares = [0], terrain._squares
    monkeypatch.setattr(terrain, "_squares", lambda a, b: met.__setitem__(0, met[0] + len(a) * len(b)) or squares(a, b))
    pairs = []
    for n in (10_000, 80_000):
        x = ball(n)
        met[0] = 0
        found = terrain.spread_starts(x, n // 100, [np.random.default_rng(1)])[0]
        starts, met[0] = met[0], 0
        terrain.nearest_centre(x, x[found])
        pairs.append((starts, met[0]))
    assert all(large < 20 * small for small, large in zip(*pairs))  # 64 times as many, if all met
    assert max(pairs[1]) < 80_000 * 800 / 4


def test_encoder_of_ones_own(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(150)], "id long, text string")

    def encoder(texts):
        assert len(texts) <= 40 and all(t.startswith("query: ") for t in texts)
        return [[len(t), 3.0] for t in texts]

    got = model.encode(rows, "text", "id", 2, encoder, "query: ", 40).toPandas().set_index("id").emb
    want = np.array([[len("query: " + (f"text {i}" if i != 3 else "")), 3.0] for i in range(150)])
    assert np.allclose(np.stack(got.sort_index()), want / np.linalg.norm(want, axis=1, keepdims=True))
    with pytest.raises(Exception, match="the encoder gave"):
        model.encode(rows, "text", "id", 3, encoder, "query: ", 40).count()


def test_levels_of_places_have_words(spark):
    from lexiscape.operators import places

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.12, (200, 2)) for c in ((0.0, 0.0), (0.0, 0.9), (3.0, 3.0))])
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double")
    words = spark.createDataFrame([(i, w) for i in range(600) for w in (f"own{'abc'[i // 200]}", "common")], "id long, w string")
    got = places.place_levels(pts, words, (-1.0, 4.0, -1.0, 4.0), 50, 50, [0.5, 0.15], 30).toPandas()
    assert got.groupby("level").size().tolist() == [2, 3]
    assert sorted(w for w, *_ in got[got.level == 1].words) == ["owna", "ownb", "ownc"] and sorted(got[got.level == 1].n) == [200, 200, 200]
    y = rng.normal(size=(600, 3)) * 0.08 + np.eye(3)[np.arange(600) % 3]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pts = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(y)], "id long, x double, y double, z double")
    words = spark.createDataFrame([(i, f"own{i % 3}") for i in range(600)], "id long, w string")
    got = places.sphere_levels(pts, words, 3000, 0.1, [4, 1], 20, 150).toPandas()
    first = got[got.level == 0]
    assert set(first.of.dropna()) == {1, 2, 3} and first.n.sum() == 600 and all(len(w) == 1 for w in first.words)
    for r in first.itertuples():
        own = y[np.arange(600) % 3 == int(r.words[0][3:])]
        assert (own @ [r.x, r.y, r.z]).max() > 0.99 and abs(np.hypot(np.hypot(r.x, r.y), r.z) - 1) < 1e-9


def test_transport_in_bounded_memory():
    """Beyond KERNEL_BYTES one single-precision kernel is held, whatever the rounds: half of a double one, and no copies of it."""
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = (rng.normal(size=(3000, 8)) / 3 for _ in range(2))
    costs = lambda i, j: ((x[i:j, None, 0] - y[:, 0]) ** 2 + (x[i:j, None, 1] - y[:, 1]) ** 2)
    for lam, eps in ((0.2, 0.05), (0.05, 0.001)):  # the second makes the kernel anew
        want, ok = model.sinkhorn(costs(0, 600), lam, eps)
        small = pytest.MonkeyPatch()
        small.setattr(model, "KERNEL_BYTES", 0)
        got, also = model.sinkhorn(lambda i, j: costs(i, min(j, 600)), lam, eps, shape=(600, 3000))
        small.undo()
        assert ok and also and np.allclose(got, want, atol=1e-6)
    tracemalloc.start()
    model.sinkhorn(costs, 0.2, 0.05, shape=(3000, 3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 4 + (40 << 20)
