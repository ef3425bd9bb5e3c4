"""Parsing, corpus rules and paging, on small records."""

import pytest
from pyspark.sql import functions as F

from lexiscape.operators import corpus, parse, taxonomy
from lexiscape.sources import files
from lexiscape.streaming import ingest

FULL = """<grantAward id="X-18K1" projectType="project" awardNumber="18K1">
<summary xml:lang="en"><title>Test</title></summary>
<summary xml:lang="ja"><title>試験</title><category path="1" niiCode="359">基盤(C)</category>
<awardNumber awardNumber="18K1" sequence="1"/><awardNumber awardNumber="17H9" participate="2016-2018" sequence="2"/>
<review_section sequence="1">小区分37010:生物</review_section><review_section sequence="2">中区分43:細胞</review_section>
<institution niiCode="1">大学</institution>
<member sequence="1" eradCode="10" role="principal_investigator"/><member sequence="2" eradCode="11" role="co"/>
<projectStatus fiscalYear="2020" statusCode="closed"/><keywordList><keyword> 遺伝 </keyword><keyword>転写</keyword></keywordList>
<paragraphList sequence="1" type="outline_of_research_initial"><paragraph sequence="1">一。 </paragraph><paragraph sequence="2">二。</paragraph></paragraphList>
<paragraphList sequence="2" type="outline_of_research_achievement"><paragraph sequence="1">三。</paragraph></paragraphList>
<periodOfAward searchStartFiscalYear="2018" searchEndFiscalYear="2020"/></summary></grantAward>"""
CHILD = """<grantAward id="X-21H" projectType="publicly" awardNumber="21H"><parentAward id="AREA-20A403"><title xml:lang="en">Cyber</title><title xml:lang="ja">分子</title></parentAward>
<summary xml:lang="en"><title>Only</title><periodOfAward searchStartFiscalYear="2021" searchEndFiscalYear=""/></summary></grantAward>"""
BARE = '<grantAward id="X-0" projectType="p" awardNumber="0"></grantAward>'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("xml") / "2018"
    d.mkdir()
    (d / "st0000001_rw500.xml").write_text(f'<?xml version="1.0" encoding="UTF-8"?>\n<grantAwards>{FULL}{CHILD}{BARE}</grantAwards>')
    return d.parent


def test_parse(spark, folder):
    rows = {r["award_number"]: r for r in parse.read(spark, str(folder)).collect()}
    assert set(rows) == {"18K1", "21H"}
    r = rows["18K1"]
    assert (r["title"], r["title_en"], r["category"], r["category_code"], r["institution"]) == ("試験", "Test", "基盤(C)", "359", "大学")
    assert r["shokubun_codes"] == ["37010"] and len(r["review_sections"]) == 2
    assert (r["pi_erad"], r["n_members"], r["status_code"]) == ("10", 2, "closed")
    assert (r["start_fy"], r["period_start_fy_raw"], r["end_fy"], r["old_award_numbers"]) == (2016, 2018, 2020, ["17H9"])
    assert r["keywords"] == ["遺伝", "転写"] and r["abstract_initial"] == "一。\n二。" and r["abstract_achievement"] == "三。"
    assert r["source_file"].endswith("st0000001_rw500.xml")
    c = rows["21H"]
    assert (c["title"], c["parent_award"], c["parent_title"], c["end_fy"], c["keywords"], c["n_members"]) == ("Only", "20A403", "分子", None, [], 0)
    assert parse.summary(parse.read(spark, str(folder))).first()["corrected"] == 1


def test_stream_pages(spark, folder, tmp_path):
    out = str(tmp_path / "t")
    for _ in range(2):  # the second run finds nothing new
        ingest.append_new(ingest.stream_pages(spark, str(folder)), out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["award_number"] for r in spark.read.parquet(out).collect()) == ["18K1", "21H"]


def test_upsert(spark):
    a = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    b = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, t int")
    assert sorted(tuple(r) for r in ingest.upsert(a, b, "k", "t").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def _awards(spark):
    rows = [("a", 2018, "granted", "x"), ("b", 2020, "declined", "x"), ("c", 2020, "granted", None), ("d", 2020, None, "x"), ("e", 2025, "granted", "x")]
    return spark.createDataFrame(rows, "award_number string, start_fy int, status_code string, abstract_initial string").withColumn("abstract_achievement", F.lit(None).cast("string"))


def test_corpus(spark):
    a = _awards(spark)
    assert sorted(r[0] for r in corpus.kept(a).select("award_number").collect()) == ["d", "e"]
    raw = a.withColumn("period_start_fy_raw", F.when(F.col("award_number") == "d", 2018).otherwise(2024))
    assert "d" not in [r[0] for r in corpus.kept(raw).select("award_number").collect()]
    built = corpus.build(a.withColumn("title", F.lit("t")).withColumn("keywords", F.array().cast("array<string>"))).collect()
    assert {r["text"] for r in built} == {"t\n\nx"}
    old = spark.createDataFrame([("d", "old")], "award_number string, text string")
    new = spark.createDataFrame([("d", "new"), ("e", "e")], "award_number string, text string")
    assert corpus.drift(old, new).count() == 1 and not corpus.same_keys(old, new)
    assert {r["text"] for r in corpus.keep_embedded_text(old, new).collect()} == {"old", "e"}


def test_year_jump(spark):
    n = [("a", y) for y, k in ((2018, 3000), (2019, 3100), (2020, 11000)) for _ in range(k)] + [("b", y) for y, k in ((2018, 600), (2019, 700)) for _ in range(k)]
    assert [tuple(r) for r in corpus.year_jumps(spark.createDataFrame(n, "c string, y int"), "c", "y").collect()] == [("a", 2020, 11000, 3100)]


def test_paging(tmp_path):
    assert corpus.year_spec("2018-2021, 2023") == [2018, 2019, 2020, 2021, 2023] and corpus.year_spec("") == []
    assert files.page_request("k", 2020, 501)["st"] == "501"
    for bad in ({"size": 1}, {"start": 0}, {"start": 200_001}):
        with pytest.raises(ValueError):
            files.page_request("k", 2020, **bad)
    with pytest.raises(ValueError):
        files.page_request("k", 2017)
    assert files.page_path("d", 2018, 501, 500) == "d/2018/st0000501_rw500.xml"
    assert files.page_total(b"<r><totalResults>16731</totalResults></r>") == 16731
    with pytest.raises(RuntimeError):
        files.page_total(b"<error><reason>no key</reason></error>")
    assert len(files.missing_pages(str(tmp_path), 2018, 1001)) == 3


def test_taxonomy(spark):
    xml = '<t><large code="A"><medium code="1"><name>中区分1:哲学</name><small code="01010"><name>小区分01010:倫理</name></small><small code="x"><name>y</name></small></medium></large></t>'
    got = taxonomy.flattened(spark.createDataFrame([(xml,)], "xml string"), taxonomy.TAXONOMY).collect()
    assert [tuple(r) for r in got] == [("A", "1", "哲学", "01010", "倫理")]
    rows = spark.createDataFrame([(1, ["小区分01010:a"]), (2, ["小区分01010:a", "大区分B"]), (3, []), (4, ["中区分1:b"])], "id int, s array<string>")
    small, medium = spark.createDataFrame([("01010", "A")], "code string, dai string"), spark.createDataFrame([("1", "C")], "code string, dai string")
    assert {r["id"]: r["dai"] for r in taxonomy.labels(rows, "s", "id", small, medium).collect()} == {1: "A", 2: "複数", 3: "区分なし", 4: "C"}


def test_sinks(spark, tmp_path):
    files.write_ranges(spark.range(10), "id", str(tmp_path / "r"), 4)
    back = spark.read.parquet(str(tmp_path / "r"))
    assert {r["part"]: r["n"] for r in back.groupBy("part").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3, 2: 3, 3: 1}
    made = []
    for _ in range(2):
        files.stage(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(3))
    assert made == [1]
    (tmp_path / ".env").write_text("KEY='v'\n")
    assert files.setting("KEY", None, str(tmp_path / ".env")) == "v"
