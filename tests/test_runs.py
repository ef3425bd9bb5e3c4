"""Runs that can be stopped: landing of pages, naming of levels; and joins of similar words."""

import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from lexiscape.functions import columns as X
from lexiscape.operators import keywords
from lexiscape.sources import fetch


@pytest.fixture
def site():
    """Pages of 1,130 records; counts requests, and refuses those of `down`."""

    class Site(BaseHTTPRequestHandler):
        asked, down, total = [], set(), 1130

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            start = int(q["st"])
            Site.asked.append(start)
            if start in Site.down:
                self.send_error(503)
                return
            body = f"<r><totalResults>{Site.total}</totalResults><i>{start}-{q['rw']}</i></r>".encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Site, f"http://127.0.0.1:{server.server_address[1]}/x"
    server.shutdown()


def test_stopped_download_goes_on(spark, tmp_path, site, monkeypatch):
    site, base = site
    folder = str(tmp_path / "land")
    site.down = {801}
    with pytest.raises(Exception):
        fetch.land_year(spark, base, folder, 2020, size=100, batch=3)
    half = {r["start"] for r in fetch.pages(spark, folder).collect()}
    assert half == {1, 101, 201, 301, 401, 501, 601}  # whole jobs before the one that failed
    site.down, site.asked[:] = set(), []
    assert fetch.land_year(spark, base, folder, 2020, size=100, batch=3) == 1130
    assert sorted(site.asked) == [701, 801, 901, 1001, 1101]
    got = {r["start"]: r["body"] for r in fetch.pages(spark, folder).collect()}
    assert sorted(got) == list(range(1, 1131, 100)) and "<i>701-100</i>" in got[701]
    site.asked[:] = []
    fetch.land_year(spark, base, folder, 2020, size=100)
    assert not site.asked
    site.total = 250
    assert fetch.land_year(spark, base, folder, 2020, size=100, force=True, max_pages=2) == 250
    assert sorted(site.asked) == [1, 101] and "250" in fetch.pages(spark, folder).where("start = 101").first()["body"]
    site.total = 0
    with pytest.raises(RuntimeError):
        fetch.land_year(spark, base, folder, 2021, size=100)


def test_levels_are_named_with_their_parents(spark, tmp_path):
    folder, seen = str(tmp_path / "names"), str(tmp_path / "seen")
    members = [(0, i % 2, i, f"text {i} " + "x" * 50, 1.0) for i in range(40)] + [(1, 10 + i % 4, i, f"text {i}", 1.0) for i in range(40)]
    members = spark.createDataFrame(members, "level int, region int, id long, text string, wt double")
    places = spark.createDataFrame([(0, r, [f"w{r}"]) for r in (0, 1)] + [(1, r, [f"w{r}"]) for r in (10, 11, 12, 13)], "level int, region int, words array<string>")
    assert {(r["region"], r["parent"]) for r in keywords.parents(members).collect()} == {(10, 0), (12, 0), (11, 1), (13, 1)}

    def asker(down):
        def ask(prompt):
            with open(seen, "a") as f:
                f.write(prompt.split("Words: ")[1].split("\n")[0] + "\n")
            if down and "w11" in prompt:
                raise OSError("no credit")
            if down and "Words: w1\n" in prompt:
                return "no"  # too short, at every try
            assert prompt.count("---\n") == 5 and "x" * 40 not in prompt
            part = prompt.split("part of the region '")[1].split("'")[0] if "part of the region" in prompt else ""
            return "海" * 4 if "Words: w0\n" in prompt else "山" * 4 if "Words: w1\n" in prompt else (part[:2] or "無親") + "東部"

        return ask

    names = lambda df: {(r["level"], r["region"]): (r["name"], r["attempts"]) for r in df.collect()}
    one = keywords.named_levels(places, members, asker(True), folder, sample=5, longest=30)
    assert names(one) == {(0, 0): ("海海海海", 1), (0, 1): (None, 3), (1, 10): ("海海東部", 1), (1, 12): ("海海東部", 1), (1, 11): (None, 1), (1, 13): ("無親東部", 1)}
    assert "no credit" in one.where("region = 11").first()["problem"]
    open(seen, "w").close()
    two = keywords.named_levels(places, members, asker(False), folder, sample=5, longest=30)
    assert names(two) == {(0, 0): ("海海海海", 1), (0, 1): ("山山山山", 4), (1, 10): ("海海東部", 1), (1, 12): ("海海東部", 1), (1, 11): ("山山東部", 2), (1, 13): ("無親東部", 1)}
    assert sorted(open(seen).read().split()) == ["w1", "w11"]  # only failures are asked again


def test_similar_words_without_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcde" if rng.random() < 0.8 else "がん癌") for _ in range(rng.randrange(9))) for _ in range(300)} | {"", "a", "ん"}
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("a",)], "w string")
    got = keywords.similar_pairs(df)
    n = spark.createDataFrame([(w,) for w in words], "w string")
    want = n.select(F.col("w").alias("a")).crossJoin(n.select(F.col("w").alias("b"))).where("a < b").where(X.similar(F.col("a"), F.col("b")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert keywords.similar_pairs(df.limit(0)).count() == 0


def test_hub_of_many_edges(spark):
    from lexiscape.operators import graph

    hub = spark.range(1, 100_001).selectExpr("id AS a", "0L AS b").unionByName(spark.range(200_000, 200_050).selectExpr("id AS a", "id + 1 AS b"))
    got = graph.connected_components(hub).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 100_001), (200_000, 51)]
