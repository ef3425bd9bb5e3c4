"""More queries over the given tables, with the SQL they must equal: records, checks, reports, colours, map controls."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiscape.functions import columns as X
from lexiscape.operators import embed, keywords, knn, layout, model, parse, places, ranks, records, report, taxonomy, terrain
from lexiscape.plans.catalogue import query
from lexiscape.plans.named import _CENT, _KW, _RANK, _VEC, _dist, _edges, _emb, _knn, _labels, _points, _words, r6, t

C = F.col

# --- records ------------------------------------------------------------------------------------


@query("first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return records.first_rows(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)


_ID = "SELECT p_partkey, CASE WHEN p_size%9=0 THEN 'rec/'||p_partkey ELSE 'REC-'||upper(split_part(p_type,' ',1))||'-'||p_partkey END AS rid FROM part"


@query("type_code", f"SELECT p_partkey, nullif(regexp_extract(rid,'^REC-([A-Z]+)-',1),'') AS code, rid IS NOT DISTINCT FROM ('REC-'||nullif(regexp_extract(rid,'^REC-([A-Z]+)-',1),'')||'-'||p_partkey) AS ok, 'https://example.org/record/'||rid||'/' AS url FROM ({_ID})")
def _(spark, d):
    rid = F.when(C("p_size") % 9 == 0, F.concat(F.lit("rec/"), C("p_partkey").cast("string"))).otherwise(F.concat(F.lit("REC-"), F.upper(F.substring_index("p_type", " ", 1)), F.lit("-"), C("p_partkey").cast("string")))
    code = records.type_code(C("rid"), "REC")
    return t(spark, d, "part").select("p_partkey", rid.alias("rid")).select("p_partkey", code.alias("code"), records.recomposes(C("rid"), "REC", code, C("p_partkey").cast("string")).alias("ok"), records.record_url(C("rid")).alias("url"))


@query("mapped_value", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '' END AS status FROM orders")
def _(spark, d):
    return t(spark, d, "orders").select("o_orderkey", records.mapped(C("o_orderstatus"), {"F": "done", "O": "open"}, "").alias("status"))


_REVISED = "CASE o WHEN 'B' THEN CASE WHEN contains(m,'素粒子') OR contains(m,'天文') THEN 'C' ELSE 'B' END WHEN 'C' THEN CASE WHEN contains(m,'電気電子') THEN 'E' ELSE 'D' END WHEN 'D' THEN CASE WHEN contains(m,'材料工学') THEN 'E' WHEN contains(m,'原子力') THEN 'D' ELSE 'F' END WHEN 'A' THEN 'A' WHEN 'E' THEN 'G' WHEN 'F' THEN 'H' WHEN 'G' THEN 'I' WHEN 'H' THEN 'J' WHEN 'I' THEN 'K' WHEN 'J' THEN 'L' WHEN 'K' THEN 'M' ELSE '?' END"


@query("revised_division", f"SELECT c_custkey, {_REVISED} AS division FROM (SELECT c_custkey, chr((65+c_custkey%12)::INT) AS o, ['素粒子と宇宙','天文学','電気電子工学','材料工学','原子力工学','化学工学','文学'][(1+c_nationkey%7)::INT] AS m FROM customer)")
def _(spark, d):
    names = F.array(*map(F.lit, ["素粒子と宇宙", "天文学", "電気電子工学", "材料工学", "原子力工学", "化学工学", "文学"]))
    c = t(spark, d, "customer").select("c_custkey", F.char(65 + C("c_custkey") % 12).alias("o"), F.get(names, C("c_nationkey") % 7).alias("m"))
    return c.select("c_custkey", taxonomy.revised(C("o"), C("m")).alias("division"))


@query("name_check", "SELECT p_partkey, regexp_full_match(p_name, '[ぁ-ヿA-Za-z0-9・ー々〜～\\-/&()（）\\s]+') AND length(p_name) BETWEEN 4 AND 14 AS ok FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", records.name_ok(C("p_name")).alias("ok"))


@query("short_title", "SELECT doc_id, substr(CASE WHEN doc_id%5=0 THEN '(untitled)' ELSE text END,1,48) AS title FROM documents")
def _(spark, d):
    return t(spark, d, "documents").select("doc_id", records.short_title(F.when(C("doc_id") % 5 > 0, C("text"))).alias("title"))


@query("side_by_side", "SELECT o_orderkey, o_totalprice, n, q FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) USING (o_orderkey)")
def _(spark, d):
    li = t(spark, d, "lineitem").groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return records.aligned("o_orderkey", o.join(li.select("o_orderkey"), "o_orderkey", "left_semi"), li)


@query("order_check", "SELECT count(*) FILTER (a IS DISTINCT FROM b) AS n_bad FROM (SELECT o_orderkey AS k, o_custkey AS a FROM orders) FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey%100=0 THEN -1 ELSE o_custkey END AS b FROM orders WHERE o_orderkey%50<>7) USING (k)")
def _(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", C("o_custkey").alias("place"))
    new = o.where("o_orderkey % 50 <> 7").withColumn("place", F.when(C("o_orderkey") % 100 == 0, -1).otherwise(C("place")))
    return records.same_order(o, new, "o_orderkey", "place")


@query("value_dictionary", "SELECT name, value, (row_number() OVER (PARTITION BY name ORDER BY value)-1)::INT AS code FROM (SELECT DISTINCT 'p_brand' AS name, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_size', p_size::VARCHAR FROM part)")
def _(spark, d):
    return records.dictionary(t(spark, d, "part"), "p_brand", "p_size")


@query("dense_rank", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size)::INT AS r FROM part")
def _(spark, d):
    return t(spark, d, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).alias("r"))


@query("json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_XML = (
    '<grantAward id="ID-{0}" projectType="project" awardNumber="N{0}"><parentAward id="P-X-{1}"><title xml:lang="en">pe{0}</title></parentAward>'
    '<summary xml:lang="en"><title>e{0}</title></summary><summary xml:lang="ja"><title>t{0}</title>'
    '<awardNumber awardNumber="N{0}" sequence="1"/><awardNumber awardNumber="O{0}" participate="20{2}-2029"/><awardNumber awardNumber="" participate="2001"/>'
    '<category path="c" niiCode="7"> cat{1} </category><review_section>小区分0101{1}:x</review_section><review_section>中区分1:y</review_section><institution niiCode="3">inst</institution>'
    '<member sequence="1" eradCode="e{0}" role="principal_investigator"/><member sequence="2" eradCode="z" role="co_investigator"/><projectStatus fiscalYear="2024" statusCode="granted"/>'
    '<keywordList><keyword> a </keyword><keyword></keyword><keyword>b{1}</keyword></keywordList>'
    '<paragraphList type="outline_of_research_initial"><paragraph>one</paragraph><paragraph>two{0}</paragraph></paragraphList>'
    '<periodOfAward searchStartFiscalYear="2019" searchEndFiscalYear="2025"/></summary></grantAward>'
)


@query("parse_all_columns", "SELECT 'N'||n_nationkey AS award_number, 'ID-'||n_nationkey AS kaken_id, 'project' AS project_type, 't'||n_nationkey AS title, 'cat'||n_regionkey AS category, '7' AS category_code, ['小区分0101'||n_regionkey||':x','中区分1:y'] AS review_sections, ['0101'||n_regionkey] AS shokubun_codes, 'inst' AS institution, 'e'||n_nationkey AS pi_erad, 2 AS n_members, 'granted' AS status_code, least(2019,2010+n_nationkey)::INT AS start_fy, 2025 AS end_fy, 2019 AS period_start_fy_raw, ['O'||n_nationkey] AS old_award_numbers, n_regionkey::VARCHAR AS parent_award, 'pe'||n_nationkey AS parent_title, 'e'||n_nationkey AS title_en, ['a','b'||n_regionkey] AS keywords, 'one'||chr(10)||'two'||n_nationkey AS abstract_initial, NULL::VARCHAR AS abstract_achievement, NULL::VARCHAR AS source_file FROM nation")
def _(spark, d):
    xml = F.format_string(_XML.replace("{0}", "%1$s").replace("{1}", "%2$s").replace("{2}", "%3$s"), C("n_nationkey").cast("string"), C("n_regionkey").cast("string"), (10 + C("n_nationkey")).cast("string"))
    raw = t(spark, d, "nation").select(F.from_xml(xml, " ".join(parse.RECORD.split())).alias("r")).select("r.*")
    return parse.awards(raw)


# --- vectors --------------------------------------------------------------------------------------


@query("norm_check", f"WITH {_VEC} SELECT count(*) AS n, round(max(abs(sqrt(list_dot_product(w,w))-1)),6) AS worst FROM e")
def _(spark, d):
    return records.norm_error(_emb(spark, d), "embedding").select("n", *r6("worst"))


@query("similar_to_item", f"WITH {_VEC} SELECT a.id, round(round(list_dot_product(a.v,b.v),12),6) AS sim FROM u a, u b WHERE b.id=7 ORDER BY round(list_dot_product(a.v,b.v),12) DESC, a.id LIMIT 16")
def _(spark, d):
    return records.similar_to(_emb(spark, d), "vec_id", "embedding", 7).select("id", *r6("sim"))


@query("pair_similarity", f"WITH {_VEC}, r AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM u), s AS (SELECT list_dot_product(a.v,b.v) AS sim FROM r a JOIN r b ON a.n-b.n BETWEEN 1 AND 10) SELECT count(*) AS n, round(quantile_disc(sim,0.5),6) AS median, round(quantile_disc(sim,0.05),6) AS p5, round(quantile_disc(sim,0.95),6) AS p95 FROM s")
def _(spark, d):
    return report.similarity_spread(_emb(spark, d), "vec_id", "embedding").select("n", *r6("median", "p5", "p95"))


@query("indicator_merge", f"WITH {_knn(15)}, x AS (SELECT src AS id, max(CASE WHEN rank=1 THEN dist END) AS d1, avg(dist) AS dk_mean FROM edges GROUP BY ALL) SELECT id, lab AS label, round(d1,6) AS d1, round(dk_mean,6) AS dk_mean, CASE WHEN id%3=0 THEN (id*2)::DOUBLE END AS other FROM e LEFT JOIN x USING (id)")
def _(spark, d):
    meta = _emb(spark, d).select(C("vec_id").alias("id"), "label")
    other = meta.where("id % 3 = 0").select("id", (C("id") * 2.0).alias("other"))
    return records.merged(meta, "id", knn.distances(_edges(spark, d, 15)), other).select("id", "label", *r6("d1", "dk_mean"), "other")


@query("components_sizes", f"WITH RECURSIVE {_knn(2)}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), k AS (SELECT a, b FROM b JOIN e x ON x.id=a JOIN e y ON y.id=b WHERE x.lab<3 AND y.lab<3), r AS (SELECT id, id AS c FROM e WHERE lab<3 UNION SELECT k.b, r.c FROM r JOIN k ON k.a=r.id AND k.b>r.c), z AS (SELECT id, min(c) AS c FROM r GROUP BY id), cs AS (SELECT c, count(*) AS n FROM z GROUP BY c) SELECT count(*) AS n_components, max(n) AS largest, count(*) FILTER (n=1) AS isolated FROM cs")
def _(spark, d):
    from lexiscape.operators import graph

    own = _emb(spark, d).where("label < 3").select(C("vec_id").alias("id"))
    return graph.component_sizes(_edges(spark, d, 2).select(C("src").alias("a"), C("dst").alias("b")), own).agg(F.count("*").alias("n_components"), F.max("n").alias("largest"), F.count_if(C("n") == 1).alias("isolated"))


@query("ring_node", f"WITH {_VEC}, p AS (SELECT id AS p, w AS pv FROM e WHERE id<12), z AS (SELECT e.id, p.p, round(list_dot_product(w,pv),12) AS s FROM e, p), b AS (SELECT id, p FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, p) AS r FROM z) WHERE r=1), o AS (SELECT e.lab, ((b.p-lab-0.5+6.0)%12.0+12.0)%12.0-6.0 AS off FROM b JOIN e USING (id)) SELECT lab AS label, round(lab+0.5+coalesce(median(off) FILTER (abs(off)<3),0),6) AS centre FROM o GROUP BY lab")
def _(spark, d):
    e = _emb(spark, d)
    at = knn.nearest_prototype(e, e.where("vec_id < 12").select(C("vec_id").cast("int").alias("p"), C("embedding").alias("pv")), "vec_id", "embedding")
    rows = e.select(C("vec_id").alias("id"), "label").join(at, "id")
    return places.window_centre(rows, "label", "prototype", {i: i + 0.5 for i in range(10)}, 12).select("label", *r6("centre"))


@query("layout_plane")
def _(spark, d):
    return embed.embedded(knn.materialised(_edges(spark, d, 15)))


@query("layout_sphere")
def _(spark, d):
    return embed.embedded(knn.materialised(_edges(spark, d, 15)), "sphere", min_dist=0.0, spread=0.3)


@query("layout_torus")
def _(spark, d):
    return embed.embedded(knn.materialised(_edges(spark, d, 15)), "torus", min_dist=0.0, spread=0.5)


_PERIODIC = "p AS (SELECT event_id AS id, value - 10 * floor(value / 10) AS u, (event_id * 7 % 1000) / 100.0::DOUBLE AS v FROM events), q AS (SELECT a.id, a.u - b.u AS x, a.v - b.v AS y FROM p a JOIN p b ON b.id = a.id + 1), g AS (SELECT id, CASE WHEN 2 * abs(x) < 10 THEN x ELSE x * (abs(x) - 10) / abs(x) END AS gx, CASE WHEN 2 * abs(y) < 10 THEN y ELSE y * (abs(y) - 10) / abs(y) END AS gy FROM q)"


@query("torus_metric", f"WITH {_PERIODIC} SELECT id, round(sqrt(gx * gx + gy * gy), 6) AS d, round(gx / (sqrt(gx * gx + gy * gy) + 1e-6), 6) AS gu, round(gy / (sqrt(gx * gx + gy * gy) + 1e-6), 6) AS gv FROM g")
def _(spark, d):
    p = t(spark, d, "events").select(C("event_id").alias("id"), (C("value") - 10 * F.floor(C("value") / 10)).alias("u"), (C("event_id") * 7 % 1000 / 100.0).alias("v"))
    q = p.join(p.select((C("id") - 1).alias("id"), C("u").alias("u2"), C("v").alias("v2")), "id")
    a, b = [C("u"), C("v")], [C("u2"), C("v2")]
    gu, gv = embed.torus_gradient(a, b)
    return q.select("id", F.round(X.torus_distance(a, b, 10.0), 6).alias("d"), F.round(gu, 6).alias("gu"), F.round(gv, 6).alias("gv"))


@query("graph_layout")
def _(spark, d):
    return layout.graph_layout(_edges(spark, d, 15))


# --- reports --------------------------------------------------------------------------------------

_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _corr(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr(x,y),6) AS rho, round(count(*) FILTER (x>0.95*n AND y>0.95*n)::DOUBLE/count(*) FILTER (x>0.95*n OR y>0.95*n),6) AS jaccard FROM (SELECT {_RANK.format(a)} AS x, {_RANK.format(b)} AS y, count(*) OVER () AS n FROM lineitem)"


@query("correlation_table", " UNION ALL ".join(_corr(a, b) for i, a in enumerate(_METRICS) for b in _METRICS[i + 1 :]))
def _(spark, d):
    return report.correlations(t(spark, d, "lineitem"), *_METRICS).select("a", "b", "n", *r6("rho", "jaccard"))


@query("rank_medians", f"SELECT p_brand AS grp, 'p_size' AS metric, count(*) AS n, round(median(q),6) AS median FROM (SELECT p_brand, {_RANK.format('p_size')}/count(*) OVER () AS q FROM part) GROUP BY ALL UNION ALL SELECT p_brand, 'p_retailprice', count(*), round(median(q),6) FROM (SELECT p_brand, {_RANK.format('p_retailprice')}/count(*) OVER () AS q FROM part) GROUP BY ALL")
def _(spark, d):
    return report.rank_medians(t(spark, d, "part"), C("p_brand"), "p_size", "p_retailprice").select("grp", "metric", "n", *r6("median"))


@query("value_by_year", "WITH o AS (SELECT year(o_orderdate)::INT AS year, o_totalprice AS v FROM orders) SELECT year, count(*) AS n, round(median(v),6) AS median, round(quantile_cont(v,0.75),6) AS p75, 100.0::DOUBLE AS base_median, 200.0::DOUBLE AS base_p75 FROM o GROUP BY year")
def _(spark, d):
    o = t(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    base = o.select("year").distinct().select("year", F.lit(100.0).alias("base_median"), F.lit(200.0).alias("base_p75"))
    return report.by_year(o, "year", "o_totalprice", base).select("year", "n", *r6("median", "p75"), "base_median", "base_p75")


@query("topic_report", "WITH x AS (SELECT year(o_orderdate)::VARCHAR AS y, o_orderpriority AS c, o_orderstatus='F' AS h FROM orders) SELECT kind, value, n, hits, round(1000.0*hits/n,6) AS per_mille FROM (SELECT 'year' AS kind, y AS value, count(*) AS n, count(*) FILTER (h) AS hits FROM x GROUP BY y UNION ALL SELECT 'category', c, count(*), count(*) FILTER (h) FROM x GROUP BY c UNION ALL SELECT 'all', '', count(*), count(*) FILTER (h) FROM x)")
def _(spark, d):
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    return report.topic(o, "year", C("o_orderstatus") == "F", "o_orderpriority").select("kind", "value", "n", "hits", *r6("per_mille"))


@query("topic_coverage", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus='F') AS hits, round(count(*) FILTER (o_orderstatus='F')::DOUBLE/sum(count(*) FILTER (o_orderstatus='F')) OVER (),6) AS share FROM orders GROUP BY ALL")
def _(spark, d):
    return report.coverage(t(spark, d, "orders"), "o_orderpriority", C("o_orderstatus") == "F").select("o_orderpriority", "n", "hits", *r6("share"))


@query("merge_candidates", f"WITH {_VEC}, {_CENT}, k AS (SELECT a, b, d, b%3 AS g, round((a+b)%5/10.0+0.5,2) AS acc FROM dd) SELECT a, b, round(d,6) AS d, row_number() OVER (PARTITION BY a ORDER BY round(d,9), b)::INT AS rank_all, row_number() OVER (PARTITION BY a, g ORDER BY round(d,9), b)::INT AS rank_in_group, CASE WHEN a<b THEN acc::DOUBLE END AS bal_acc, CASE WHEN a<b THEN dense_rank() OVER (ORDER BY CASE WHEN a<b THEN acc END NULLS LAST)::DOUBLE END AS acc_rank FROM k")
def _(spark, d):
    dist = _dist(spark, d)
    groups = _emb(spark, d).where("label <> 9").select(C("label").alias("lab"), (C("label") % 3).alias("grp")).distinct()
    acc = dist.where("a < b").select("a", "b", F.round((C("a") + C("b")) % 5 / 10.0 + 0.5, 2).alias("bal_acc"))
    return report.merge_candidates(dist, groups, acc).select("a", "b", *r6("d"), "rank_all", "rank_in_group", "bal_acc", C("acc_rank").cast("double").alias("acc_rank"))


# --- fields ---------------------------------------------------------------------------------------

_FIELDS = "f AS (SELECT year(o_orderdate)::INT AS year, (o_custkey%4)::INT AS ix, (o_orderkey%3)::INT AS iy, count(*)::DOUBLE AS v FROM orders WHERE year(o_orderdate)<1998 GROUP BY ALL)"


def _fields(spark, d):
    o = t(spark, d, "orders").withColumn("year", F.year("o_orderdate")).where("year < 1998")
    return o.groupBy("year", (C("o_custkey") % 4).cast("int").alias("ix"), (C("o_orderkey") % 3).cast("int").alias("iy")).agg(F.count("*").cast("double").alias("v"))


@query("field_blend", f"WITH {_FIELDS}, y AS (SELECT year, lead(year) OVER (ORDER BY year) AS nx, row_number() OVER (ORDER BY year)-1 AS i FROM (SELECT DISTINCT year FROM f)), p AS (SELECT i*17+j AS frame, year, NULL::INT AS nx, 0.0::DOUBLE AS t FROM y, range(5) r(j) UNION ALL SELECT i*17+5+j, year, nx, (j+1)/13.0::DOUBLE FROM y, range(12) r(j) WHERE nx IS NOT NULL), z AS (SELECT frame, p.year, p.nx, ix, iy, v*(1-t) AS v FROM p JOIN f ON f.year=p.year UNION ALL SELECT frame, p.year, p.nx, ix, iy, v*t FROM p JOIN f ON f.year=p.nx) SELECT frame::INT AS frame, year, coalesce(nx,-1)::INT AS next, ix, iy, round(sum(v),6) AS v FROM z GROUP BY ALL")
def _(spark, d):
    return terrain.blended(_fields(spark, d)).select("frame", "year", F.coalesce("next", F.lit(-1)).alias("next"), "ix", "iy", *r6("v"))


def _masked(base: str) -> str:
    of = "true" if base == "mean" else "year=(SELECT min(year) FROM f)"
    n = "(SELECT count(DISTINCT year) FROM f)::DOUBLE" if base == "mean" else "1.0"
    return f"WITH {_FIELDS}, b AS (SELECT ix, iy, coalesce(sum(v) FILTER ({of}),0)/{n} AS m, coalesce(sum(v/4) FILTER ({of}),0)/({n}*{n}) AS mv FROM f GROUP BY ALL), g AS (SELECT * FROM b, (SELECT DISTINCT year FROM f)) SELECT year, ix, iy, round(coalesce(v,0)-m,6) AS diff, abs(coalesce(v,0)-m)>2*sqrt(coalesce(v/4,0)+mv) AS significant FROM g LEFT JOIN f USING (year, ix, iy)"


@query("masked_anomaly", _masked("mean"))
def _(spark, d):
    f = _fields(spark, d)
    return terrain.masked_anomaly(f, f.select("year", "ix", "iy", (C("v") / 4).alias("var"))).select("year", "ix", "iy", *r6("diff"), "significant")


@query("first_year_anomaly", _masked("first"))
def _(spark, d):
    f = _fields(spark, d)
    return terrain.masked_anomaly(f, f.select("year", "ix", "iy", (C("v") / 4).alias("var")), "first").select("year", "ix", "iy", *r6("diff"), "significant")


# --- colours --------------------------------------------------------------------------------------

# The published matrices from linear sRGB to cone responses and on to OKLab.
_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
_FLAT = "CASE WHEN {0}<=0.04045 THEN {0}/12.92 ELSE (({0}+0.055)/1.055)**2.4 END"


def _mix(row: tuple, names: str) -> str:
    return "+".join(f"({k})*{n}" for k, n in zip(row, names))


@query(
    "oklab_from_rgb",
    f"WITH c AS (SELECT id, (id%256)/255.0::DOUBLE AS r0, (id*7%256)/255.0::DOUBLE AS g0, (id*31%256)/255.0::DOUBLE AS b0 FROM (SELECT event_id AS id FROM events)), f AS (SELECT id, {_FLAT.format('r0')} AS r, {_FLAT.format('g0')} AS g, {_FLAT.format('b0')} AS b FROM c), l AS (SELECT id, "
    + ", ".join(f"cbrt({_mix(row, 'rgb')}) AS {n}" for row, n in zip(_TO_LMS, "xyz"))
    + " FROM f) SELECT id, "
    + ", ".join(f"round({_mix(row, 'xyz')},4)+0.0 AS {n}" for row, n in zip(_TO_LAB, ("light", "a", "b")))
    + " FROM l",
)
def _(spark, d):
    k = C("event_id")
    return t(spark, d, "events").select(k.alias("id"), *X.from_srgb(k % 256 / 255.0, k * 7 % 256 / 255.0, k * 31 % 256 / 255.0)).select("id", *((F.round(c, 4) + 0.0).alias(c) for c in ("light", "a", "b")))


@query("hue_sectors", "SELECT floor(h/30)::INT AS sector, count(*) AS n FROM (SELECT ((event_id*37-100)%360+360)%360 AS h FROM events) GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "events").groupBy(places.hue_sector((C("event_id") * 37 - 100).cast("double")).alias("sector")).agg(F.count("*").alias("n"))


@query("hue_sector_words", f"WITH {_KW}, s AS (SELECT o_orderkey AS id, floor((o_orderkey*37%360)/30)::INT AS sector FROM orders), a AS (SELECT w, count(*) AS n_all FROM w GROUP BY ALL), n AS (SELECT sector, w, count(*) AS n_in FROM w JOIN s USING (id) GROUP BY ALL HAVING count(*)>=30), z AS (SELECT sector, w, n_in, n_all, n_in/(n_all+30.0)::DOUBLE AS score FROM n JOIN a USING (w)) SELECT sector, w, n_in, n_all, round(score,6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY round(score,9) DESC, w) AS rank FROM z) WHERE rank<=4")
def _(spark, d):
    sectors = t(spark, d, "orders").select(C("o_orderkey").alias("id"), places.hue_sector((C("o_orderkey") * 37).cast("double")).alias("sector"))
    return keywords.sector_words(_words(spark, d), sectors).select("sector", "w", "n_in", "n_all", *r6("score"), "rank")


_LEGEND = "m AS (SELECT label, count(*) AS n, avg(0.1*cos(radians(id*37%360))) AS ma, avg(0.1*sin(radians(id*37%360))) AS mb FROM (SELECT vec_id AS id, label FROM embeddings) GROUP BY ALL)"


def _legend(spark, d):
    e = _emb(spark, d).select("label", (C("vec_id") * 37 % 360).cast("double").alias("hue_deg"), F.lit(0.1).alias("chroma"))
    return places.legend(e, "label")


@query("colour_legend", f"WITH {_LEGEND} SELECT label, n, round(sqrt(ma*ma+mb*mb),6) AS chroma, round(ma,6) AS ma, round(mb,6) AS mb FROM m")
def _(spark, d):
    return _legend(spark, d).select("label", "n", *r6("chroma", "ma", "mb"))


@query("mean_swatches")
def _(spark, d):
    own = _emb(spark, d).select("label").distinct().select("label", *(F.lit(128).cast("short").alias(c) for c in "rgb"))
    return places.swatches(own, _legend(spark, d), "label", ["9"])


@query("coordinate_colours")
def _(spark, d):
    p = model.layout(_emb(spark, d), "embedding", "vec_id", 3)
    return places.coordinate_colours(p, "id")


@query("mixing_beta")
def _(spark, d):
    e = _emb(spark, d)
    cent = [r["cent"] for r in knn.centroids(e, "label", "embedding").orderBy("label").collect()]  # a row a label
    return spark.createDataFrame([(places.mixing_beta(e, "embedding", cent),)], "beta double")


# --- map controls -----------------------------------------------------------------------------------


@query("map_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus<>'F' AND o_orderpriority NOT IN ('1-URGENT','5-LOW')")
def _(spark, d):
    return records.filtered(t(spark, d, "orders"), {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "5-LOW"]}).select("o_orderkey")


@query("map_toggles", "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n, o_orderstatus<>'F' AS shown FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), true FROM orders GROUP BY ALL")
def _(spark, d):
    return records.toggles(t(spark, d, "orders"), {"o_orderstatus": ["F"], "o_orderpriority": []})


@query("nearest_pixel", "SELECT event_id AS id, round(sqrt((value-1.5)**2+(event_id%100-50)**2),6) AS d FROM events WHERE value IS NOT NULL ORDER BY sqrt((value-1.5)**2+(event_id%100-50)**2), event_id LIMIT 1")
def _(spark, d):
    e = t(spark, d, "events").where("value is not null").withColumn("y", C("event_id") % 100)
    return layout.nearest_pixel(e, "event_id", "value", "y", (1.5, 50.0)).select("id", *r6("d"))


@query("jitter", f"SELECT event_id, round(1+greatest(least(sqrt(-2*ln({layout.SQL_UNIFORM.format('event_id', 11)}))*cos({2 * math.pi!r}*{layout.SQL_UNIFORM.format('event_id', 23)})*0.002,0.005),-0.005),6) AS r FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", F.round(layout.jitter(C("event_id")), 6).alias("r"))


@query("lasso_lists", "WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS p FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000), k AS (SELECT DISTINCT l_orderkey AS id, lower(trim(p_brand)) AS w FROM lineitem JOIN part ON l_partkey=p_partkey) SELECT w, n, r::INT AS rank FROM (SELECT w, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM k JOIN s USING (id) GROUP BY w) WHERE r<=15")
def _(spark, d):
    own = t(spark, d, "orders").where(C("o_totalprice").between(50000, 150000)).select(C("o_orderkey").alias("id"))
    return keywords.selection_words(_words(spark, d), own)


@query("status_summary", "SELECT o_orderstatus AS status_code, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    return parse.by_status(t(spark, d, "orders").withColumnRenamed("o_orderstatus", "status_code"))


@query("gini_spread", "WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem) SELECT round(sum((2*i-n-1)*v)/(max(n)*sum(v)),6) AS gini, round(log10(quantile_cont(v,0.9)/quantile_cont(v,0.1)),6) AS spread FROM r")
def _(spark, d):
    return ranks.gini(t(spark, d, "lineitem"), "l_extendedprice").select(*r6("gini", "spread"))


# --- places, chroma, sets, merges -----------------------------------------------------------------


def _tags(spark, d):
    """Two words an item, one of them its label's."""
    e = _emb(spark, d)
    return e.select(C("vec_id").alias("id"), F.explode(F.array(F.concat(F.lit("label"), C("label").cast("string")), F.concat(F.lit("mod"), (C("vec_id") % 13).cast("string")))).alias("w"))


@query("place_levels")
def _(spark, d):
    return places.place_levels(_points(spark, d).select("id", "x", "y"), _tags(spark, d), (-1.0, 1.0, -1.0, 1.0), 64, 64, [0.3, 0.15], 10)


@query("sphere_levels")
def _(spark, d):
    p = _points(spark, d)
    n = F.sqrt(C("x") ** 2 + C("y") ** 2 + C("z") ** 2)
    return places.sphere_levels(p.select("id", *((C(c) / n).alias(c) for c in "xyz")), _tags(spark, d), 4000, 0.1, [1, 4], 10, 100)


@query("arc_density", f"WITH {_knn(15)}, d AS (SELECT src AS id, 2*asin(greatest(0.0,least(1.0,sqrt(2*dist)/2))) AS r FROM edges WHERE rank=15 AND dist>0) SELECT id, round(1/(r*r),6) AS density FROM d")
def _(spark, d):
    chords = _edges(spark, d, 15).withColumn("dist", F.sqrt(2 * C("dist")))
    return terrain.local_density(chords, 15, 2, arc=True).select("id", *r6("density"))


@query("peak_counts", "WITH c AS (SELECT o_orderkey AS id, (o_orderkey%97)/97.0 AS x, (o_orderkey%89)/89.0 AS y, o_orderstatus='F' AS t FROM orders), p AS (SELECT * FROM (VALUES (1,0.2,0.3),(2,0.7,0.6)) p(peak,px,py)) SELECT peak, count(*) FILTER (t) AS n_target, count(*) FILTER (NOT t) AS n_other FROM p JOIN c ON (x-px)**2+(y-py)**2<=0.04 GROUP BY peak")
def _(spark, d):
    pts = t(spark, d, "orders").select((C("o_orderkey") % 97 / 97.0).alias("x"), (C("o_orderkey") % 89 / 89.0).alias("y"), "o_orderstatus")
    peaks = spark.createDataFrame([(1, 0.2, 0.3), (2, 0.7, 0.6)], "peak int, px double, py double")
    return places.peak_counts(pts, peaks, 0.2, C("o_orderstatus") == "F")


@query("chroma_modes", "WITH q AS (SELECT quantile_cont(l_extendedprice,0.95) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_extendedprice*(0.145/b),6) AS figure, 0.145::DOUBLE AS flat FROM lineitem, q")
def _(spark, d):
    one = places.web_chroma(t(spark, d, "lineitem"), "l_extendedprice", mode="figure").withColumnRenamed("chroma", "figure")
    return places.web_chroma(one, "l_extendedprice", mode="flat").select("l_orderkey", "l_linenumber", *r6("figure"), C("chroma").alias("flat"))


@query("set_parts", "WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate)<1995), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate)>=1995), x AS (SELECT k, 'both' AS side FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'a' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'b' FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) SELECT * FROM x")
def _(spark, d):
    o = t(spark, d, "orders").select(C("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return records.set_parts(o.where("y < 1995"), o.where("y >= 1995"), "k")


@query("merge_report", f"WITH {_knn(15)}, {_CENT}, k AS (SELECT a, b, d, b%3 AS g FROM dd), r AS (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY round(d,9), b)::INT AS rank_all, row_number() OVER (PARTITION BY a, g ORDER BY round(d,9), b)::INT AS rank_in_group FROM k), l AS (SELECT id, lab FROM e WHERE lab<>9), n AS (SELECT x.lab AS a, y.lab AS b, count(*) AS n FROM edges JOIN l x ON x.id=src JOIN l y ON y.id=dst WHERE x.lab<>y.lab GROUP BY ALL), z AS (SELECT lab, count(*) AS m FROM l GROUP BY ALL), sh AS (SELECT *, n/sum(n) OVER (PARTITION BY a) AS share FROM n), li AS (SELECT a, b, share, share/(y.m/((SELECT count(*) FROM l)-x.m)) AS lift, row_number() OVER (PARTITION BY a ORDER BY round(share,9) DESC, b)::INT AS nearest_rank, first(b) OVER (PARTITION BY a ORDER BY round(share,9) DESC, b) AS nearest FROM sh JOIN z y ON y.lab=b JOIN z x ON x.lab=a) SELECT r.a, r.b, round(d,6) AS d, rank_all, rank_in_group, round(share,6) AS share, round(lift,6) AS lift, nearest_rank, nearest FROM r JOIN li USING (a,b) WHERE a<b AND b<=a+2")
def _(spark, d):
    labels = _labels(spark, d)
    dist = _dist(spark, d)
    groups = labels.where("lab is not null").select("lab", (C("lab") % 3).alias("grp")).distinct()
    merges = dist.where("a < b AND b <= a + 2").select("a", "b")
    found = report.merge_report(merges, dist, groups, knn.label_lift(knn.materialised(_edges(spark, d, 15)), labels))
    return found.select("a", "b", *r6("d"), "rank_all", "rank_in_group", *r6("share", "lift"), "nearest_rank", "nearest")


@query("topic_report", "WITH m AS (SELECT year(o_orderdate)::VARCHAR AS y, o_orderpriority AS p, (o_custkey%7)::VARCHAR AS c, contains(o_orderpriority,'U') AS hit FROM orders), x AS (SELECT 'all' AS kind, '' AS value, hit FROM m UNION ALL SELECT 'year', y, hit FROM m UNION ALL SELECT 'category', p, hit FROM m UNION ALL SELECT 'cluster', c, hit FROM m) SELECT kind, value, count(*) AS n, count(*) FILTER (hit) AS hits, round(1000.0::DOUBLE*count(*) FILTER (hit)/count(*),6) AS per_mille, round(count(*) FILTER (hit)/(SELECT count(*) FILTER (hit) FROM m),6) AS share FROM x GROUP BY ALL")
def _(spark, d):
    o = t(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return report.topic_report(o, "y", F.contains("o_orderpriority", F.lit("U")), {"category": C("o_orderpriority"), "cluster": C("o_custkey") % 7}).select("kind", "value", "n", "hits", *r6("per_mille", "share"))


@query("label_tour")
def _(spark, d):
    return layout.label_tour(knn.centroids(_emb(spark, d), "label", "embedding"))


@query("labels_shown")
def _(spark, d):
    marks = _points(spark, d).groupBy("label", (C("id") % 4).alias("part")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").cast("int").alias("size"))
    return layout.labels_shown(marks.select(F.concat_ws("-", "label", "part").alias("name"), "x", "y", F.least(C("part"), F.lit(2)).cast("int").alias("level"), "size"), [1.0, 2.0, 4.0])

