"""Operators that no SQL twin covers, against plain Python."""

import heapq
import itertools
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiscape.functions import columns as X
from lexiscape.operators import corpus, graph, keywords, knn, layout, model, parse, places, ranks, records, report, taxonomy, terrain
from lexiscape.sources import fetch, files


def plain_transport(cost, lam, eps, rounds=5000):
    """Scalings in logarithms throughout."""
    n, m = cost.shape
    f, g, fi = np.zeros(n), np.zeros(m), lam / (lam + eps)
    for _ in range(rounds):
        f = fi * -eps * np.log(np.exp((g[None] - cost) / eps).sum(axis=1) / n / m * n)
        g = fi * -eps * np.log(np.exp((f[:, None] - cost) / eps).sum(axis=0) / n / m * m)
    return (np.exp((f[:, None] + g[None] - cost) / eps) / (n * m)).sum(axis=1) * n


@pytest.mark.parametrize("lam,eps", [(0.4, 0.1), (0.05, 0.02), (0.2, 0.005)])
def test_transport(lam, eps):
    rng = np.random.default_rng(1)
    cost = rng.uniform(0, 2, (40, 50))
    sent, ok = model.sinkhorn(cost, lam, eps, rounds=5000)
    assert ok and np.allclose(sent, plain_transport(cost, lam, eps), atol=1e-3)
    assert np.isfinite(model.sinkhorn(cost + 50, 0.05, 0.02)[0]).all()


def test_surplus_lies_between_0_and_1(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8) + (3 if i % 7 == 6 else 0)], 2019 + i % 7) for i in range(420)]
    got = model.surplus(spark.createDataFrame(rows, "vec_id long, embedding array<double>, year int"), "vec_id", "embedding", "year", least_past=60, standards=50, components=4).toPandas()
    value = got.uot_surplus.dropna()
    assert len(got) == 420 and len(value) > 250 and value.between(0, 1).all()


def test_sphere_peaks_are_the_highest_within_sigma(spark):
    n, sigma = 600, 0.4
    grid = terrain.nodes(n)
    rng = np.random.default_rng(3)
    v = np.round(rng.uniform(0, 1, n) ** 4, 6)
    field = spark.createDataFrame(list(zip(range(n), v.tolist())), "node long, v double")
    held = rng.choice(n, 200, replace=False)
    got = terrain.sphere_regions(field, n, sigma, occupied=spark.createDataFrame([(int(i),) for i in held], "node long")).toPandas()
    cos = grid @ grid.T
    ref = np.quantile(v[held], 0.99)
    near = np.argsort(-cos, axis=1, kind="stable")[:, 1:9]
    peaks = [i for i in range(n) if v[i] >= v[near[i]].max() and v[i] >= 0.03 * ref and v[i] > 0 and v[i] >= v[cos[i] >= math.cos(sigma)].max()]
    order = sorted(peaks, key=lambda i: (-v[i], i))
    label = dict(zip(got.node, got.region))
    assert [label[i] for i in order] == list(range(1, len(order) + 1)) and max(label.values()) == len(order)
    heap, want, tick = [], {}, len(order)  # a plain flood
    for r, i in enumerate(order):
        want[i] = r + 1
        heapq.heappush(heap, (-v[i], r, i))
    while heap:
        _, _, at = heapq.heappop(heap)
        for j in near[at].tolist():
            if j not in want and v[j] > 0.005 * ref:
                want[j] = want[at]
                heapq.heappush(heap, (-v[j], tick, j))
                tick += 1
    assert {i: r for i, r in label.items() if r} == want


def test_old_numbers(spark):
    """A number without a sequence is old, one without a number is none."""
    xml = '<grantAward awardNumber="n"><summary xml:lang="ja"><title>t</title><awardNumber awardNumber="a" participate="2017"/><awardNumber awardNumber="b" sequence="1" participate="2011"/><awardNumber sequence="2" participate="2001"/><awardNumber awardNumber="" sequence="3" participate="2002"/><periodOfAward searchStartFiscalYear="2019"/></summary></grantAward>'
    raw = spark.createDataFrame([(xml,)], "x string").select(F.from_xml("x", " ".join(parse.RECORD.split())).alias("r")).select("r.*")
    r = parse.awards(raw).first()
    assert r["old_award_numbers"] == ["a"] and r["start_fy"] == 2017


def test_words_are_trimmed_of_spaces_only(spark):
    rows = spark.createDataFrame([(1, ["0a0", " 1b1 ", "ＡＢ ", "2c2"])], "id long, kw array<string>")
    assert {r["w"] for r in keywords.exploded(rows, "id", "kw").collect()} == {"0a0", "1b1", "ＡＢ", "2c2"}
    assert {r["w"] for r in keywords.exploded(rows, "id", "kw", X.keyword_compact, compose=True).collect()} == {"0a0", "1b1", "ab", "2c2"}


def test_ranks_of_hot_values(spark):
    rows = [(i, 1.0 if i % 3 == 0 else float(i % 50)) for i in range(600)] + [(1000, None)]
    got = ranks.places(spark.createDataFrame(rows, "id long, v double").where("v is not null"), "v").toPandas()
    assert np.allclose(got["rank"], got.v.rank()) and (got.n == 600).all()


def test_blocks_give_the_same_neighbours(spark, small, monkeypatch):
    e = spark.read.parquet(f"{small}/embeddings.parquet").where("vec_id < 120")
    want = knn.exact(e, 5).toPandas()
    monkeypatch.setattr(knn, "SENT_BYTES", 0)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 20_000)
    got = knn.exact(e, 5).toPandas()
    key = ["src", "rank"]
    assert want.sort_values(key).reset_index(drop=True)[["src", "rank", "dst"]].equals(got.sort_values(key).reset_index(drop=True)[["src", "rank", "dst"]])


def test_tour():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 6, 7):
        cost = rng.integers(1, 50, (n, n)).astype(float)
        tour = layout.shortest_tour(cost)
        length = lambda p: sum(cost[a][b] for a, b in zip(p, [*p[1:], p[0]]))
        assert sorted(tour) == list(range(n)) and length(tour) == min(length((0, *p)) for p in itertools.permutations(range(1, n)))


def test_graph_layout_parts_a_barbell(spark):
    """Two cliques with one bridge lie on two sides of the first axis."""
    edges = [(a + o, b + o) for o in (0, 20) for a in range(10) for b in range(10) if a != b] + [(0, 20)]
    got = layout.graph_layout(spark.createDataFrame(edges, "src long, dst long"), rounds=25).toPandas().set_index("id")
    left, right = got.c0.loc[range(10)], got.c0.loc[range(20, 30)]
    assert left.max() < right.min() or right.max() < left.min()
    degree = pd.Series([a for a, b in edges] + [b for a, b in edges]).groupby(lambda i: i)
    assert np.isfinite(got.to_numpy()).all() and degree is not None


def test_labels_and_names():
    many = [("big", 0.5, 0.5, 0, 100), ("near", 0.52, 0.51, 0, 50), ("far", 0.9, 0.9, 0, 10), ("deep", 0.1, 0.1, 1, 70)]
    assert layout.labels_at(many, 1.0) == ["big", "far"] and layout.labels_at(many, 4.0) == ["big", "deep", "near", "far"]
    assert layout.layout_name(nn=15, min_dist=0.3) == "min_dist0.3_nn15"


def test_mixing_beta(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cents = x[:4].tolist()
    beta = places.mixing_beta(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>"), "v", cents, rounds=6)
    s = beta * (x @ np.array(cents).T)
    w = np.exp(s - s.max(axis=1, keepdims=True))
    assert abs((w.max(axis=1) / w.sum(axis=1)).mean() - 0.6) < 1e-3


def test_colours_go_both_ways(spark):
    """OKLab of a colour in gamut, back to bytes, is the colour."""
    rgb = spark.range(0, 4096).selectExpr("id", "(id % 16) * 17 as r", "(id div 16 % 16) * 17 as g", "(id div 256) * 17 as b")
    lab = rgb.select("*", *X.from_srgb(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255)[:1], *(c.alias(n) for c, n in zip(X.from_srgb(F.col("r") / 255, F.col("g") / 255, F.col("b") / 255)[1:], ("la", "lb"))))
    back = lab.select("r", "g", "b", *(c.alias(n) for c, n in zip(X.rgb255(F.col("light"), F.col("la"), F.col("lb")), ("r2", "g2", "b2"))))
    assert back.where("r <> r2 or g <> g2 or b <> b2").count() == 0


def test_coordinate_colours(spark):
    rng = np.random.default_rng(7)
    rows = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(300, 3)) * [5, 3, 1])]
    got = places.coordinate_colours(spark.createDataFrame(rows, "id long, c0 double, c1 double, c2 double"), "id").toPandas()
    assert len(got) == 300 and got[list("rgb")].stack().between(0, 255).all() and got[list("rgb")].nunique().min() > 30


def test_swatches(spark):
    legend = spark.createDataFrame([("a", 1, 2, 3), ("n", 4, 5, 6)], "label string, r int, g int, b int")
    own = spark.createDataFrame([("a", 9, 9, 9), ("n", 8, 8, 8), ("x", 7, 7, 7)], "label string, r int, g int, b int")
    assert {tuple(r) for r in places.swatches(own, legend, "label", ["n"]).collect()} == {("a", 1, 2, 3), ("n", 8, 8, 8), ("x", 7, 7, 7)}


def test_tables_side_by_side_are_checked(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, x int")
    assert records.aligned("k", a, a.withColumnRenamed("x", "y")).count() == 2
    for bad in (a.limit(1), a.unionByName(a), a.withColumn("k", F.col("k") + 1)):
        with pytest.raises(ValueError):
            records.aligned("k", a, bad.withColumnRenamed("x", "y"))


def test_names_are_checked_and_asked_again(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never")], "region int, prompt string")

    def ask(prompt):
        if prompt.startswith("good") or "will not do" in prompt and prompt.startswith("late"):
            return "四文字以上"
        return "медицина" if prompt.startswith("late") else "x"

    got = {r["region"]: (r["name"], r["attempts"]) for r in keywords.named(rows, ask).collect()}
    assert got == {1: ("四文字以上", 1), 2: ("四文字以上", 2), 3: (None, 3)}
    assert spark.createDataFrame([("四文字以上",), ("медицина",), ("x",), (None,)], "n string").select(records.name_ok(F.col("n")).alias("ok")).toPandas().ok.tolist() == [True, False, False, False]
    assert "Not one of: a" in keywords.namer_prompt(["w"], ["t"], ["a"])


def test_tokenizer_plug(spark):
    count = corpus.token_counter(lambda: lambda texts: [[1] + [2] * len(x) for x in texts])
    got = spark.createDataFrame([("ab",), (None,), ("",)], "t string").select(count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in got] == [3, 1, 1]


def test_packed_points(spark):
    rows = spark.range(5).selectExpr("id as uid", "cast(id - 2 as short) as q_x", "cast(id * 3 as short) as q_y", "id as r", "id + 1 as g", "id + 2 as b")
    got = sorted(files.packed_points(rows, ["q_x", "q_y"], size=3).collect())
    assert [(r["page"], r["n"]) for r in got] == [(0, 3), (1, 2)]
    body = bytes(got[1]["body"])
    assert np.frombuffer(body, "<i2", 4).tolist() == [1, 2, 9, 12] and np.frombuffer(body, "<u4", 2, 8).tolist() == [3, 4] and list(body[16:]) == [3, 4, 4, 5, 5, 6]


def test_ranges_are_named(spark, tmp_path):
    files.write_ranges(spark.range(10).withColumnRenamed("id", "k"), "k", str(tmp_path / "o"), 4, "train")
    assert sorted(p for p in os.listdir(tmp_path / "o") if p.startswith("shard")) == [f"shard=train-0000{i}-of-00004" for i in range(4)]
    got = spark.read.parquet(str(tmp_path / "o")).where("shard like 'train-00001-%'").collect()
    assert sorted(r["k"] for r in got) == [3, 4, 5]


def test_pages_are_fetched(spark, tmp_path):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = self.path.encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(fetch.PageSource)
    got = spark.read.format("record_pages").options(base=f"http://127.0.0.1:{server.server_port}/x", key="k", year="2020", total="1200", size="500").load().orderBy("start").collect()
    server.shutdown()
    assert [r["start"] for r in got] == [1, 501, 1001] and "st=501" in got[1]["body"] and "year=2020" in got[1]["body"]
    waits, calls = [], []

    def fails(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return b"ok"

    assert fetch.fetched("u", fails, waits.append) == b"ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        fetch.fetched("u", lambda u: (_ for _ in ()).throw(OSError("down")), waits.append)
    with pytest.raises(ValueError):
        fetch.PageReader({"total": "0"}).partitions()


def test_missing_pages(spark, tmp_path):
    assert [s for s, _ in files.missing_pages(str(tmp_path), 2020, 1200)] == [1, 501, 1001]
    path = files.page_path(str(tmp_path), 2020, 501, 500)
    os.makedirs(os.path.dirname(path))
    open(path, "w").close()
    assert [s for s, _ in files.missing_pages(str(tmp_path), 2020, 1200)] == [1, 1001]


def test_limited_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.xml").write_text(f'<x><grantAward awardNumber="n{i}"><summary xml:lang="ja"><title>t</title></summary></grantAward></x>')
    assert {r["award_number"] for r in parse.read(spark, str(tmp_path), 2).collect()} == {"n0", "n1"} and parse.read(spark, str(tmp_path)).count() == 3


def test_tidy_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "code string, name string")
    taxonomy.write_tidy(rows, str(tmp_path / "t"), "code", ["name"])
    assert spark.read.json(str(tmp_path / "t/json")).where("code = '1'").first()["n_memberships"] == 2
    assert spark.read.csv(str(tmp_path / "t/csv"), header=True).count() == 3
    (tmp_path / "d.json").write_text('{"a": {"x": 1}}')
    assert files.read_json(spark, str(tmp_path / "d.json"), "a struct<x:int>").first()["a"]["x"] == 1


def test_card_and_sizes(spark):
    t = spark.range(1200)
    assert "| n | 1,200 | id |" in report.card("c", {"n": t})
    sizes = graph.component_sizes(spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long"), spark.createDataFrame([(i,) for i in (1, 3, 4, 5, 6)], "id long"))
    assert {tuple(r) for r in sizes.collect()} == {(1, 1), (3, 1), (4, 2), (6, 1)}
    assert abs(report.independent_overlap() - 0.05 / 1.95) < 1e-12


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    for v in (rng.normal(size=501), np.repeat([1.0, 2.0, 9.0], [3, 400, 2]), np.array([4.0])):
        rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
        got = ranks.quantile_values(rows, "v", 0.02, 0.5, 0.98, nearest=(0.05, 0.95, 1.0))
        assert np.allclose(got, [*np.quantile(v, [0.02, 0.5, 0.98]), *np.quantile(v, [0.05, 0.95, 1.0], method="inverted_cdf")])
    assert ranks.quantile_values(rows.limit(0), "v", 0.5, nearest=(0.1,)) == [None, None]


def test_components_in_one_task_or_many(spark):
    rng = np.random.default_rng(9)
    edges = spark.createDataFrame([tuple(map(int, x)) for x in rng.integers(0, 300, (200, 2))], "a long, b long")
    one, many = (sorted(tuple(r) for r in graph.connected_components(edges, whole=w).collect()) for w in (1000, 0))
    assert one == many and len(one) > 100


def test_scratch_is_cleared(spark, tmp_path):
    from lexiscape import session

    t = session.Scratch(spark).table(spark.range(3))
    path = t._scratch.removeprefix("file://")
    assert os.path.exists(path)
    session.clear(spark)
    assert not os.path.exists(path)


def test_colours_at_a_rounding_border(spark, tmp_path):
    """Lightness is single-precision in SQL: a channel of each row lies so near to a half that double precision rounds it elsewhere."""
    import duckdb

    from lexiscape.plans import catalogue

    near = [["-0x1.06d1e4p-3", "-0x1.a9707cp-6", "0x1.e86a36p-5"], ["-0x1.46f6bep-4", "-0x1.890770p-3", "-0x1.06c0e0p-9"], ["0x1.250632p-3", "0x1.40b93ep-4", "-0x1.334354p-4"]]
    rows = [(i, [float.fromhex(x) for x in v], 0) for i, v in enumerate(near)]
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    got = [tuple(r) for r in catalogue.queries()["oklab_rgb"](spark, str(tmp_path)).orderBy("id").collect()]
    assert got == con.execute(catalogue.oracle_sql()["oklab_rgb"] + " order by id").fetchall()
