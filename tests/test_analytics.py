"""Properties and known answers of neighbours, terrain, colour, keywords and map operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiscape.functions import columns as X
from lexiscape.operators import density, graph, keywords, knn, mapserve, model, ranks, terrain
from lexiscape.sources import files


@pytest.fixture(scope="module")
def emb(spark, small):
    return spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 120")


@pytest.mark.parametrize("spread,least", [(0.05, 0.25), (1.0, 1.01)])
def test_knn_by_cells(spark, monkeypatch, spread, least):
    """Same edges with copies, ties and odd rows; where rows lie in clumps, few blocks are visited."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 6))
    rows = [(i, [float(x) for x in centre[i % 12] + rng.normal(size=6) * spread]) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 6), (2001, None), (2002, [2 * x for x in rows[5][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = sorted(tuple(r) for r in knn.exact(df, 7).collect())
    monkeypatch.setattr(knn, "SENT_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK", 25)
    assert sorted(tuple(r) for r in knn.exact(df, 7).collect()) == want
    x = df.where("vec_id <> 2000").select(F.col("vec_id").alias("id"), X.unit(F.col("embedding")).alias("v")).where("vec_id <> 2000 and v is not null")
    own, cells = knn.celled(x, x.count(), 6)
    blocks = own.select("block").distinct().count()
    assert blocks > 25 and own.groupBy("block").count().agg({"count": "max"}).first()[0] <= 60
    copies = knn.visits(knn.within(own, 7), cells, 7).count() / x.count()
    assert copies < least * blocks


def test_knn_forms_agree(spark, emb, monkeypatch):
    a = sorted(tuple(r) for r in knn.exact(emb, 5).collect())
    monkeypatch.setattr(knn, "SENT_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK", 50)
    assert sorted(tuple(r) for r in knn.exact(emb, 5).collect()) == a
    assert all(s != d for s, _, d, _ in a) and len(a) == 600


def test_knn_duplicates(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["dist"]) for r in knn.exact(rows, 1).collect()}
    assert got[1, 1] == (2, 0.0) and got[2, 1] == (1, 0.0) and got[3, 1][0] == 1


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    touched = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in touched}


def test_ranks(spark):
    rows = spark.createDataFrame([(float(v),) for v in (3, 1, 2, 2, 5)], "v double")
    assert sorted((r["v"], r["rank"], r["n"]) for r in ranks.places(rows, "v").collect()) == [(1.0, 1.0, 5), (2.0, 2.5, 5), (2.0, 2.5, 5), (3.0, 4.0, 5), (5.0, 5.0, 5)]
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 9.0)], "a double, b double")
    assert ranks.spearman(pairs, "a", "b").first()["rho"] == pytest.approx(1.0)


def test_smoothing_keeps_mass_and_flood_partitions(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(-0.5, 0.1, (200, 2)), rng.normal(0.5, 0.1, (200, 2))]))], "id long, x double, y double")
    h = terrain.histogram2d(p, "x", "y", (-1, 1, -1, 1), 20, 20)
    f = terrain.smooth(h, 1.0, 1.0, 20, 20)
    assert f.agg(F.sum("v")).first()[0] == pytest.approx(h.agg(F.sum("v")).first()[0])
    peaks = terrain.box_peaks(f, 4, 0.2)
    assert peaks.count() == 2
    labels = terrain.watershed(f, peaks)
    assert labels.select("ix", "iy").distinct().count() == labels.count() == f.count()
    assert {r[0] for r in labels.select("region").distinct().collect()} >= {1, 2}


def test_sphere(spark):
    g = terrain.fibonacci(spark, 500)
    assert g.agg(F.max(F.abs(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 - 1))).first()[0] < 1e-9
    near = terrain.nearest_node(g.withColumnRenamed("node", "id"), 500).collect()
    assert all(r["id"] == r["node"] for r in near)
    edges = terrain.sphere_edges(spark, 500, 0.2)
    grid = terrain.nodes(500)
    assert edges.count() == int((np.minimum(grid @ grid.T, 1) >= math.cos(0.2)).sum())
    assert terrain.ocean(g, spark, 500).first()["share"] == pytest.approx(0.0)


def test_colour(spark):
    row = spark.range(1).select(*[c.alias(f"w{i}") for i, c in enumerate(X.rgb255(F.lit(1.0), F.lit(0.0), F.lit(0.0)))], X.clamped_chroma(F.lit(0.6), F.lit(0.5), F.lit(0.5)).alias("c"), X.clamped_chroma(F.lit(0.6), F.lit(0.01), F.lit(0.5)).alias("d"), X.hex_channel(F.lit("#ff8000"), 1).alias("h")).first()
    assert (row["w0"], row["w1"], row["w2"]) == (255, 255, 255) and 0 < row["c"] < 0.5 and row["d"] == 0.01 and row["h"] == 128


def test_keyword_folds(spark):
    ranked = F.array(*map(F.lit, ["deep learning", "learning", "genome", "genomes", "x", "y"]))
    assert spark.range(1).select(keywords.distinct_words(ranked)).first()[0] == ["deep learning", "genome", "x", "y"]
    rows = spark.createDataFrame([(1, ["A ", "a", ""]), (2, None)], "id int, k array<string>")
    assert [tuple(r) for r in keywords.exploded(rows, "id", "k", X.keyword_ascii_lower).collect()] == [(1, "a")]
    places = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"])], "region int, words array<string>")
    names = spark.createDataFrame([(2, "Name")], "region int, name string")
    assert {r["region"]: r["label"] for r in keywords.names_or_words(places, names).collect()} == {1: "a / b", 2: "Name"}


def test_map(spark):
    rows = spark.createDataFrame([(k, float(i)) for i, k in enumerate("dacb")], "k string, x double")
    assert sorted((r["k"], r["uid"]) for r in mapserve.dense_id(rows, "k").collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    q = {r["x"]: r["q_x"] for r in mapserve.quantise(rows, "x").collect()}
    assert q[0.0] == -32768 and q[3.0] == 32767
    pages = mapserve.pages(rows, "k", ["k", "x"], 3)
    assert [(r["page"], r["first_key"], r["n"]) for r in pages.orderBy("page").collect()] == [(0, "a", 3), (1, "d", 1)]
    assert mapserve.version(pages) == mapserve.version(mapserve.pages(rows.repartition(3), "k", ["k", "x"], 3))
    assert mapserve.search(rows, "a", ["k"], "k").count() == 0
    assert mapserve.lookup(rows, "k", "d", 3).first() == (1, 0) and mapserve.lookup(rows, "k", "z").count() == 0


def test_models(spark, emb):
    kept, ok = model.sinkhorn(np.zeros((4, 4)), 1.0, 0.1)
    assert ok and np.allclose(kept, 1, atol=0.1)
    rng = np.random.default_rng(2)
    pts = np.concatenate([rng.normal(0, 0.05, (40, 3)) + c for c in ([1, 0, 0], [0, 1, 0])])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "vec_id long, embedding array<double>")
    found = {r["id"]: r["cluster"] for r in density.density_clusters(knn.materialised(knn.exact(rows, 15)), 10).collect()}
    assert len({found[i] for i in range(40)} - {-1}) == 1 and len({found[i] for i in range(40, 80)} - {-1}) == 1
    ring = model.ring_som(rows, np.eye(3), rounds=4, ring=12, wide=3.0)
    assert np.allclose(np.linalg.norm(ring, axis=1), 1)
    acc = model.pair_accuracy(rows.withColumn("label", (F.col("vec_id") >= 40).cast("int")), "label", "embedding", [(0, 1)], 3, components=3).first()
    assert acc["bal_acc"] > 0.95
    e = model.encode(spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string"), "text", "id", 16).collect()
    assert len(e) == 2 and len(e[0]["emb"]) == 16


def test_torus_and_polygon(spark):
    r = spark.range(1).select(X.torus_distance([F.lit(0.1)], [F.lit(2 * math.pi - 0.1)]).alias("d"), X.inside(F.lit(0.2), F.lit(0.2), [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]).alias("a"), X.inside(F.lit(0.9), F.lit(0.9), [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]).alias("b")).first()
    assert r["d"] == pytest.approx(0.2) and r["a"] and not r["b"]


@pytest.mark.parametrize("partitions", [8, 64, 200])
def test_dense_ids_lose_no_row(spark, tmp_path, partitions):
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        n, whole = orders.count(), mapserve.dense_id(orders, "o_orderkey")
        whole.write.parquet(str(tmp_path / "ids"))
        got = spark.read.parquet(str(tmp_path / "ids")).orderBy("uid").toPandas()
        assert got.uid.tolist() == list(range(n)) and got.o_orderkey.is_monotonic_increasing
        assert got.drop(columns="uid").equals(orders.orderBy("o_orderkey").toPandas()[got.columns[:-1]])
        files.write_ranges(orders, "o_orderkey", str(tmp_path / "ranges"), 4)
        parts = spark.read.parquet(str(tmp_path / "ranges")).groupBy("part").count().orderBy("part").collect()
        assert [r["count"] for r in parts] == [min(-(-n // 4), n - i * -(-n // 4)) for i in range(4)]
        mapserve.pages(orders, "o_orderkey", [c for c in orders.columns if c != "o_orderkey"]).write.parquet(str(tmp_path / "pages"))
        assert spark.read.parquet(str(tmp_path / "pages")).agg({"n": "sum"}).first()[0] == n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_version_by_groups(spark):
    rows = spark.createDataFrame([(i, f"h{i}") for i in range(50)], "page long, hash string")
    assert mapserve.version(rows, 4) != mapserve.version(rows.withColumn("hash", F.when(F.col("page") == 7, "x").otherwise(F.col("hash"))), 4)
    assert mapserve.version(rows, 4) == mapserve.version(rows.repartition(7), 4)
    assert mapserve.version(rows, 50) == mapserve.version(rows, 4096)


def test_quantiles_by_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", None, float(round(x, 1))) for x in rng.normal(size=3000)] + [(None, 1, float(i)) for i in range(4)] + [("b", 2, 7.0), ("b", 2, None), ("c", 3, None)] + [("d", i % 3, float(x)) for i, x in enumerate(rng.normal(size=100))]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(5)
    got = {(r["g"], r["h"]): (r["lo"], r["mid"], r["hi"]) for r in ranks.group_quantiles(df, ["g", "h"], "v", lo=0.1, mid=0.5, hi=1.0).collect()}
    want = {}
    for g, h, v in rows:
        if v is not None:
            want.setdefault((g, h), []).append(v)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(tuple(np.quantile(v, [0.1, 0.5, 1.0])))
    assert ranks.group_quantiles(df.limit(0), ["g"], "v", m=0.5).count() == 0


@pytest.mark.parametrize("width", [1, 2, 9, 64])
def test_nearest_of_a_block(monkeypatch, width):
    """Single-precision screening keeps what double precision orders: near ties, copies, small tiles."""
    monkeypatch.setattr(knn, "TILE", 64)
    monkeypatch.setattr(knn, "QUERIES", 50)
    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, width))
    x = np.concatenate([x, x[:40], x[:60] + 1e-7 * rng.normal(size=(60, width)), np.repeat(x[7:8], 30, axis=0)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rng.permutation(len(x)).astype(np.int64)
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -np.inf)
    for k in (1, 15, 500):
        got = {}
        for b in knn._top(ids, x, ids, x, k):
            for s, d, v in zip(*(b.column(c).to_pylist() for c in range(3))):
                got.setdefault(s, []).append((d, v))
        for i, own in enumerate(ids):
            best = np.lexsort((ids, -sim[i]))[: min(k, len(ids) - 1)]
            assert [d for d, _ in got[own]] == ids[best].tolist() and np.allclose([v for _, v in got[own]], sim[i][best], atol=2e-12, rtol=0)
    few = next(knn._top(ids[:5], x[:5], ids, x, 15, np.full(5, 0.999999)))
    assert width < 9 or few.num_rows < 75
    assert min(few.column("sim").to_pylist()) > 0.9999


def test_bounds_of_what_is_sent():
    """What a task holds of the neighbour search: a block and its partner, or as much as a block."""
    assert max(knn.SENT_BYTES, knn.BLOCK_BYTES) <= 16 << 20 and knn.QUERIES * knn.TILE * 4 <= 16 << 20
