"""Queries over the given tables, one for each operator, with the SQL they must equal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscape.functions import columns as X
from lexiscape.operators import corpus, density, graph, keywords, knn, layout, mapserve, model, parse, places, ranks, taxonomy, terrain
from lexiscape.plans.catalogue import query
from lexiscape.session import Scratch
from lexiscape.streaming import ingest

C = F.col


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- corpus -----------------------------------------------------------------------------------


def _awards(spark, d):
    o = t(spark, d, "orders")
    return o.select(C("o_orderkey").alias("award_number"), C("o_orderpriority").alias("title"), (F.year("o_orderdate") + 23).alias("period_start_fy_raw"), F.when(C("o_orderstatus") == "F", "declined").when(C("o_orderstatus") == "O", "granted").alias("status_code"), F.when(C("o_orderkey") % 5 > 0, F.array(F.lit("k"), C("o_orderstatus"))).otherwise(F.array().cast("array<string>")).alias("keywords"), F.when(C("o_orderkey") % 7 > 0, C("o_orderpriority")).alias("abstract_initial"), F.lit(None).cast("string").alias("abstract_achievement"))


_AWARDS = "a AS (SELECT o_orderkey AS award_number, o_orderpriority AS title, year(o_orderdate)+23 AS fy, CASE o_orderstatus WHEN 'F' THEN 'declined' WHEN 'O' THEN 'granted' END AS st, CASE WHEN o_orderkey%5>0 THEN 'k、'||o_orderstatus ELSE '' END AS kw, CASE WHEN o_orderkey%7>0 THEN o_orderpriority END AS ab FROM orders)"


@query("corpus_filter", f"WITH {_AWARDS} SELECT award_number, fy::INT AS year FROM a WHERE fy BETWEEN 2019 AND 2025 AND st IS DISTINCT FROM 'declined' AND ab IS NOT NULL")
def _(spark, d):
    return corpus.kept(_awards(spark, d)).select("award_number", C("period_start_fy_raw").alias("year"))


@query("corpus_text", f"WITH {_AWARDS} SELECT award_number, concat_ws(chr(10), title, kw, ab) AS text FROM a WHERE fy BETWEEN 2019 AND 2025 AND st IS DISTINCT FROM 'declined' AND ab IS NOT NULL")
def _(spark, d):
    return corpus.build(_awards(spark, d)).select("award_number", "text")


@query("token_stats", "WITH n AS (SELECT len(regexp_extract_all(text,'\\S+')) AS n FROM documents) SELECT min(n)::BIGINT AS min, quantile_cont(n,0.5)::DOUBLE AS median, quantile_cont(n,0.99)::DOUBLE AS p99, max(n)::BIGINT AS max, count(*) FILTER (n>8192) AS n_over FROM n")
def _(spark, d):
    return corpus.token_stats(t(spark, d, "documents").select(corpus.token_count(C("text")).alias("n_tokens")))


@query("year_jump", "WITH n AS (SELECT o_orderpriority, year(o_orderdate)::INT AS y, count(*) AS n FROM orders GROUP BY ALL), w AS (SELECT *, lag(n) OVER (PARTITION BY o_orderpriority ORDER BY y) AS prev_n, lag(y) OVER (PARTITION BY o_orderpriority ORDER BY y) AS py FROM n) SELECT o_orderpriority, y, n, prev_n FROM w WHERE py=y-1 AND n>=50 AND n>1.02*prev_n")
def _(spark, d):
    return corpus.year_jumps(t(spark, d, "orders").withColumn("y", F.year("o_orderdate")), "o_orderpriority", "y", 50, 1.02)


@query("status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, d):
    return t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("text_drift", "SELECT doc_id AS award_number, text AS old_text, replace(text,'the','teh') AS new_text FROM documents WHERE text <> replace(text,'the','teh')")
def _(spark, d):
    old = t(spark, d, "documents").select(C("doc_id").alias("award_number"), "text")
    return corpus.drift(old, old.withColumn("text", F.replace("text", F.lit("the"), F.lit("teh"))))


@query("any_keyword_filter", "SELECT doc_id FROM documents WHERE contains(text,'tion') OR contains(text,'enung') OR contains(text,'ñado')")
def _(spark, d):
    return t(spark, d, "documents").where(corpus.any_substring(C("text"), ["tion", "enung", "ñado"])).select("doc_id")


@query("regex_topic", "WITH x AS (SELECT doc_id, regexp_replace(source,'thing|rc1','','g') AS a, regexp_replace(text,'thing|rc1','','g') AS b FROM documents) SELECT doc_id FROM x WHERE regexp_matches(a,'ing|s2') OR len(regexp_extract_all(b,'ing|s2'))>=2")
def _(spark, d):
    return t(spark, d, "documents").where(corpus.topic(C("source"), C("text"), "ing|s2", "thing|rc1")).select("doc_id")


@query("category_groups", "SELECT g AS grp, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN starts_with(p_type,'S') THEN 's' END, CASE WHEN p_size>25 THEN 'large' END, CASE WHEN p_brand IN ('Brand#11','Brand#22') THEN 'b' END], lambda x: x IS NOT NULL)) AS g FROM part) GROUP BY ALL")
def _(spark, d):
    groups = {"s": C("p_type").startswith("S"), "large": C("p_size") > 25, "b": C("p_brand").isin("Brand#11", "Brand#22")}
    return corpus.category_groups(t(spark, d, "part"), groups).groupBy("grp").agg(F.count("*").alias("n"))


# --- groups and ranks ---------------------------------------------------------------------------


@query("case_group_stats", "SELECT CASE WHEN starts_with(p_type,'S') THEN 'a' WHEN p_brand IN ('Brand#11','Brand#12') THEN 'b' WHEN p_size=1 THEN 'c' ELSE 'd' END AS grp, count(*) AS n, median(p_retailprice) AS med_price, round(avg(p_retailprice),6) AS avg_price, median(p_size)::DOUBLE AS med_size, round(avg(p_size),6) AS avg_size FROM part GROUP BY ALL")
def _(spark, d):
    grp = F.when(C("p_type").startswith("S"), "a").when(C("p_brand").isin("Brand#11", "Brand#12"), "b").when(C("p_size") == 1, "c").otherwise("d")
    p = t(spark, d, "part").withColumn("grp", grp)
    means = p.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("avg_price"), F.round(F.avg("p_size"), 6).alias("avg_size"))
    return means.join(ranks.group_quantiles(p, ["grp"], "p_retailprice", med_price=0.5), "grp").join(ranks.group_quantiles(p, ["grp"], "p_size", med_size=0.5), "grp")


@query("group_pivot_median", "SELECT p_brand, median(p_retailprice) FILTER (p_size%3=0) AS g0, median(p_retailprice) FILTER (p_size%3=1) AS g1, median(p_retailprice) FILTER (p_size%3=2) AS g2 FROM part GROUP BY ALL")
def _(spark, d):
    p = t(spark, d, "part").withColumn("g", F.concat(F.lit("g"), C("p_size") % 3))
    return ranks.group_quantiles(p, ["p_brand", "g"], "p_retailprice", m=0.5).groupBy("p_brand").pivot("g", ["g0", "g1", "g2"]).agg(F.max("m"))  # a row a group


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0})-1)/2.0)"


@query("avg_rank_quantile", f"SELECT event_id, round({_RANK.format('value')}/count(*) OVER (),9) AS q FROM events WHERE value IS NOT NULL")
def _(spark, d):
    return ranks.quantiles(t(spark, d, "events").select("event_id", "value"), "value").select("event_id", F.round("q", 9).alias("q"))


@query("rank_by_group", f"WITH r AS (SELECT event_type, {_RANK.format('value')}/count(*) OVER () AS q FROM events) SELECT event_type, round(avg(q),6) AS mean_q, round(avg((q>0.9)::INT),6) AS high, round(avg((q<0.1)::INT),6) AS low FROM r GROUP BY ALL")
def _(spark, d):
    q = ranks.quantiles(t(spark, d, "events").select("event_type", "value"), "value")
    return q.groupBy("event_type").agg(F.round(F.avg("q"), 6).alias("mean_q"), F.round(F.avg((C("q") > 0.9).cast("double")), 6).alias("high"), F.round(F.avg((C("q") < 0.1).cast("double")), 6).alias("low"))


@query("spearman_pair", f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS x, {_RANK.format('l_extendedprice')} AS y FROM lineitem) SELECT round(corr(x,y),6) AS rho, count(*) AS n FROM r")
def _(spark, d):
    return ranks.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"), "n")


@query("top5_jaccard", f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS x, {_RANK.format('l_extendedprice')} AS y, count(*) OVER () AS n FROM lineitem) SELECT round(count(*) FILTER (x>0.95*n AND y>0.95*n)::DOUBLE/count(*) FILTER (x>0.95*n OR y>0.95*n),6) AS jaccard FROM r")
def _(spark, d):
    return ranks.top_share_overlap(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("jaccard", 6).alias("jaccard"))


@query("top10_per_metric", "(SELECT 'price' AS metric, o_orderkey, o_totalprice AS v FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) UNION ALL (SELECT 'acct', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def _(spark, d):
    a = t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select(F.lit("price").alias("metric"), "o_orderkey", C("o_totalprice").alias("v"))
    return a.unionByName(t(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10).select(F.lit("acct").alias("metric"), C("c_custkey").alias("o_orderkey"), C("c_acctbal").alias("v")))


@query("indicator_desc", "SELECT metric, count(*) AS n, median(v) AS median, quantile_disc(v,0.05) AS p5, quantile_disc(v,0.95) AS p95 FROM (SELECT 'qty' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem) GROUP BY ALL")
def _(spark, d):
    return ranks.described(t(spark, d, "lineitem").select(C("l_quantity").alias("qty"), C("l_extendedprice").alias("price")), "qty", "price")


@query("top_mode", "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM n) WHERE r=1")
def _(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    best = n.groupBy("o_custkey").agg(F.max("n").alias("n"))
    return n.join(best, ["o_custkey", "n"]).groupBy("o_custkey", "n").agg(F.min("o_orderpriority").alias("o_orderpriority")).select("o_custkey", "o_orderpriority", "n")


@query("event_windows", "SELECT date_trunc('hour',ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS v FROM events GROUP BY ALL")
def _(spark, d):
    return ingest.windowed(t(spark, d, "events"), "ts", "event_type").withColumn("v", F.round("v", 4)).select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "v")


@query("taxonomy_label", "WITH c AS (SELECT o_orderkey, list(DISTINCT n_regionkey) AS r FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey JOIN orders ON l_orderkey=o_orderkey GROUP BY ALL) SELECT o_orderkey, CASE WHEN len(r)=1 THEN chr((65+r[1])::INT) ELSE '複数' END AS dai FROM c")
def _(spark, d):
    n = t(spark, d, "nation")
    small = n.select(F.lpad(C("n_nationkey").cast("string"), 5, "0").alias("code"), F.char(65 + C("n_regionkey")).alias("dai"))
    rows = t(spark, d, "lineitem").join(t(spark, d, "supplier"), C("l_suppkey") == C("s_suppkey")).groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("小区分"), F.lpad(C("s_nationkey").cast("string"), 5, "0"), F.lit(":x"))).alias("s"))
    return taxonomy.labels(rows, "s", "o_orderkey", small, spark.createDataFrame([], "code string, dai string"))


@query("memberships", "SELECT n_regionkey, count(*) AS n_memberships, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY ALL")
def _(spark, d):
    m = taxonomy.memberships(t(spark, d, "nation"), "n_regionkey", ["n_name"])
    return m.select("n_regionkey", "n_memberships", F.transform("memberships", lambda s: s["n_name"]).alias("names"))


# --- neighbours ---------------------------------------------------------------------------------

_VEC = "e AS (SELECT vec_id AS id, label AS lab, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings), u AS (SELECT id, lab, list_transform(w, lambda x: x/sqrt(list_dot_product(w,w))) AS v FROM e)"


def _knn(k: int) -> str:
    return f"{_VEC}, s AS (SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.v,b.v),12) AS sim FROM u a JOIN u b ON a.id<>b.id), edges AS (SELECT src, rank, dst, 1-sim AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM s) WHERE rank<={k})"


def _emb(spark, d):
    return t(spark, d, "embeddings")


def _edges(spark, d, k):
    return knn.exact(_emb(spark, d), k)


def _labels(spark, d):
    return _emb(spark, d).select(C("vec_id").alias("id"), F.when(C("label") != 9, C("label")).alias("lab"))


@query("knn15", f"WITH {_knn(15)} SELECT src, rank::INT AS rank, dst, round(dist,6) AS dist FROM edges")
def _(spark, d):
    return _edges(spark, d, 15).select("src", "rank", "dst", *r6("dist"))


_D = "SELECT src AS id, max(CASE WHEN rank=1 THEN dist END) AS d1, avg(dist) AS dk FROM edges WHERE rank<=15 GROUP BY ALL"


@query("knn_d1_dk15", f"WITH {_knn(15)} SELECT id, round(d1,6) AS d1, round(dk,6) AS dk_mean FROM ({_D})")
def _(spark, d):
    return knn.distances(_edges(spark, d, 15)).select("id", *r6("d1", "dk_mean"))


@query("knn_target_share", f"WITH {_knn(15)} SELECT src AS id, round(avg((l.label=3)::INT),6) AS frac_target FROM edges JOIN embeddings l ON l.vec_id=dst GROUP BY ALL")
def _(spark, d):
    return knn.gathered(_edges(spark, d, 15), _labels(spark, d)).groupBy(C("src").alias("id")).agg(F.round(F.avg(F.coalesce((C("lab") == 3).cast("double"), F.lit(0.0))), 6).alias("frac_target"))


@query("isolated_by_label", f"WITH {_knn(15)}, x AS ({_D}), q AS (SELECT id, dk, rank() OVER (ORDER BY round(dk,9)) AS r0, count(*) OVER (PARTITION BY round(dk,9)) AS c, count(*) OVER () AS n FROM x), z AS (SELECT id, dk, (r0+(c-1)/2.0)/n AS q FROM q) SELECT l.label, count(*) AS n, round(median(dk),6) AS med_dk, round(avg(dk),6) AS avg_dk, round(avg(q),6) AS mean_q, round(avg((q>0.9)::INT),6) AS high FROM z JOIN embeddings l ON l.vec_id=z.id GROUP BY ALL")
def _(spark, d):
    q = ranks.quantiles(knn.distances(_edges(spark, d, 15)).withColumn("v", F.round("dk_mean", 9)), "v")
    q = Scratch(spark).table(q.join(_emb(spark, d).select(C("vec_id").alias("id"), "label"), "id"))
    n = q.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("dk_mean"), 6).alias("avg_dk"), F.round(F.avg("q"), 6).alias("mean_q"), F.round(F.avg((C("q") > 0.9).cast("double")), 6).alias("high"))
    return n.join(ranks.group_quantiles(q, ["label"], "dk_mean", med_dk=0.5).withColumn("med_dk", F.round("med_dk", 6)), "label")


_CENT = "mu AS (SELECT i, avg(w[i]) AS m FROM e, range(1,65) t(i) GROUP BY i), c AS (SELECT lab, i, avg(w[i])-any_value(m) AS x FROM e JOIN mu ON true WHERE lab<>9 GROUP BY lab, i), cn AS (SELECT lab, sqrt(sum(x*x)) AS n FROM c GROUP BY lab), dd AS (SELECT a.lab AS a, b.lab AS b, 1-sum(a.x*b.x)/any_value(p.n*q.n) AS d FROM c a JOIN c b ON a.i=b.i AND a.lab<>b.lab JOIN cn p ON p.lab=a.lab JOIN cn q ON q.lab=b.lab GROUP BY ALL)"


def _dist(spark, d):
    return knn.label_distances(knn.centroids(_emb(spark, d).withColumn("lab", F.when(C("label") != 9, C("label"))), "lab", "embedding", centre=True), "lab")


@query("label_centroid_dist", f"WITH {_VEC}, {_CENT} SELECT a, b, round(d,6) AS d FROM dd")
def _(spark, d):
    return _dist(spark, d).select("a", "b", *r6("d"))


@query("centroid_rank", f"WITH {_VEC}, {_CENT} SELECT a, b, (row_number() OVER (PARTITION BY a ORDER BY round(d,9), b))::INT AS rank_all FROM dd")
def _(spark, d):
    from pyspark.sql import Window

    return _dist(spark, d).select("a", "b", F.row_number().over(Window.partitionBy("a").orderBy(F.round("d", 9), "b")).alias("rank_all"))


@query("bridge_rs", f"WITH {_knn(30)}, {_CENT}, n AS (SELECT src, lab, count(*) AS c FROM edges JOIN e ON e.id=dst WHERE lab<>9 GROUP BY ALL), p AS (SELECT src, lab, c/sum(c) OVER (PARTITION BY src) AS p, sum(c) OVER (PARTITION BY src) AS n FROM n), r AS (SELECT x.src, sum(x.p*y.p*d) AS v, any_value(x.n) AS n FROM p x JOIN p y ON x.src=y.src JOIN dd ON dd.a=x.lab AND dd.b=y.lab GROUP BY ALL) SELECT e.id, round(CASE WHEN r.n>=10 THEN v END,6) AS bridge_rs FROM e LEFT JOIN r ON r.src=e.id")
def _(spark, d):
    return knn.rao_stirling(_edges(spark, d, 30), _labels(spark, d), _dist(spark, d)).select("id", *r6("bridge_rs"))


@query("bridge_cc", f"WITH {_knn(15)}, h AS (SELECT a.src, count(*) AS h FROM edges a JOIN edges b ON a.dst=b.src JOIN edges c ON c.src=a.src AND c.dst=b.dst GROUP BY ALL) SELECT e.id, round(1-coalesce(h,0)/210.0,6) AS bridge_cc FROM e LEFT JOIN h ON h.src=e.id")
def _(spark, d):
    return knn.clustering(_edges(spark, d, 15)).select("id", *r6("bridge_cc"))


@query("growth", f"WITH {_knn(50)}, g AS (SELECT avg((2019+vec_id%7>=2023)::INT) AS g FROM embeddings) SELECT src AS id, round(log2(((sum((2019+dst%7>=2023)::INT)+2*any_value(g))/52.0)/any_value(g)),6) AS growth FROM edges, g GROUP BY src")
def _(spark, d):
    years = _emb(spark, d).select(C("vec_id").alias("id"), (2019 + C("vec_id") % 7).alias("year"))
    return knn.growth(_edges(spark, d, 50), years).select("id", *r6("growth"))


@query("label_lift", f"WITH {_knn(15)}, l AS (SELECT id, lab FROM e WHERE lab<>9), n AS (SELECT a.lab AS src_lab, b.lab AS dst_lab, count(*) AS n FROM edges JOIN l a ON a.id=src JOIN l b ON b.id=dst WHERE a.lab<>b.lab GROUP BY ALL), z AS (SELECT lab, count(*) AS m FROM l GROUP BY ALL), sh AS (SELECT *, n/sum(n) OVER (PARTITION BY src_lab) AS share FROM n) SELECT src_lab, dst_lab, round(share,6) AS share, round(share/(b.m/((SELECT count(*) FROM l)-a.m)),6) AS lift FROM sh JOIN z a ON a.lab=src_lab JOIN z b ON b.lab=dst_lab")
def _(spark, d):
    return knn.label_lift(_edges(spark, d, 15), _labels(spark, d)).select("src_lab", "dst_lab", *r6("share", "lift"))


@query("label_lean", f"WITH {_knn(15)} SELECT src AS id, count(*) FILTER (lab=1) AS na, count(*) FILTER (lab=2) AS nb, CASE WHEN count(*) FILTER (lab=1)>count(*) FILTER (lab=2) THEN 'A' WHEN count(*) FILTER (lab=1)<count(*) FILTER (lab=2) THEN 'B' ELSE 'tie' END AS side FROM edges JOIN e ON e.id=dst GROUP BY src")
def _(spark, d):
    return knn.lean(_edges(spark, d, 15), _labels(spark, d), 1, 2)


@query("cohesion", f"WITH {_knn(30)} SELECT src AS id, round(count(*) FILTER (b.lab=3)/30.0,6) AS frac FROM edges JOIN e a ON a.id=src JOIN e b ON b.id=dst WHERE a.lab=3 GROUP BY src")
def _(spark, d):
    return knn.cohesion(_edges(spark, d, 30), _labels(spark, d).where("lab = 3").select("id")).select("id", *r6("frac"))


@query("nearest_prototype", f"WITH {_VEC}, p AS (SELECT id AS p, w AS pv FROM e WHERE id<3), z AS (SELECT e.id, p.p, round(list_dot_product(w,pv),12) AS s FROM e, p) SELECT id, p::INT AS prototype, round(s,6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, p) AS r FROM z) WHERE r=1")
def _(spark, d):
    e = _emb(spark, d)
    return knn.nearest_prototype(e, e.where("vec_id < 3").select(C("vec_id").cast("int").alias("p"), C("embedding").alias("pv")), "vec_id", "embedding").select("id", "prototype", *r6("sim"))


@query("knn_recall", f"WITH {_knn(15)}, l AS (SELECT id, v[1] AS a, v[2] AS b FROM u), q AS (SELECT x.id AS src, y.id AS dst, round((x.a*y.a+x.b*y.b)/sqrt((x.a*x.a+x.b*x.b)*(y.a*y.a+y.b*y.b)),12) AS sim FROM l x JOIN l y ON x.id<>y.id), lo AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM q) WHERE r<=15) SELECT round(count(*)/15.0/(SELECT count(*) FROM e),4) AS recall FROM edges JOIN lo USING (src, dst)")
def _(spark, d):
    low = knn.exact(_emb(spark, d).withColumn("embedding", F.slice("embedding", 1, 2)), 15)
    return knn.recall(_edges(spark, d, 15), low).select(F.round("recall", 4).alias("recall"))


@query("components", f"WITH RECURSIVE {_knn(2)}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT id, id AS c FROM e UNION SELECT b.b, r.c FROM r JOIN b ON b.a=r.id AND b.b>r.c) SELECT id AS node, min(c) AS component FROM r GROUP BY id")
def _(spark, d):
    return graph.connected_components(_edges(spark, d, 2).select(C("src").alias("a"), C("dst").alias("b")))


# --- keywords -----------------------------------------------------------------------------------


def _words(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), C("l_partkey") == C("p_partkey")).select("l_orderkey", F.array("p_brand").alias("kw"))
    return keywords.exploded(rows, "l_orderkey", "kw", X.keyword_ascii_lower)


_KW = "w AS (SELECT DISTINCT l_orderkey AS id, lower(trim(p_brand)) AS w FROM lineitem JOIN part ON l_partkey=p_partkey)"


@query("kw_atypicality", f"WITH {_KW}, f AS (SELECT w, count(*) AS f FROM w GROUP BY w HAVING count(*)>=5), p AS (SELECT a.id, a.w AS a, b.w AS b, fa.f AS fa, fb.f AS fb FROM w a JOIN w b ON a.id=b.id AND a.w<b.w JOIN f fa ON fa.w=a.w JOIN f fb ON fb.w=b.w), z AS (SELECT a, b, (count(*)-any_value(fa)*any_value(fb)/(SELECT count(*) FROM orders)::DOUBLE)/sqrt(any_value(fa)*any_value(fb)/(SELECT count(*) FROM orders)::DOUBLE) AS z FROM p GROUP BY a, b) SELECT p.id, round(-quantile_cont(z,0.1),6) AS kw_atyp, count(*) AS kw_npairs FROM p JOIN z USING (a,b) GROUP BY p.id")
def _(spark, d):
    return keywords.atypicality(_words(spark, d), t(spark, d, "orders").count()).select("id", *r6("kw_atyp"), "kw_npairs")


_KR = f"{_KW}, r AS (SELECT o_orderkey AS id, (o_custkey%6)::INT AS region, ((o_orderkey%4)+1)/4.0 AS wt FROM orders), s AS (SELECT region, count(DISTINCT id) AS docs FROM r GROUP BY ALL), n AS (SELECT w, count(*) AS n_all FROM w GROUP BY ALL), k AS (SELECT region, w, count(*) AS n_in, sum(wt)::DOUBLE AS w_in FROM w JOIN r USING (id) GROUP BY ALL), sc AS (SELECT region, w, n_in, n_all, w_in/(n_all+30)*sqrt(w_in) AS score FROM k JOIN n USING (w) JOIN s USING (region) WHERE n_in>=5 AND n_in>=0.01*docs)"


def _scores(spark, d):
    reg = t(spark, d, "orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 6).cast("int").alias("region"), ((C("o_orderkey") % 4 + 1) / 4.0).alias("wt"))
    return keywords.region_scores(_words(spark, d), reg)


@query("kw_region_score", f"WITH {_KR} SELECT region, w, n_in, n_all, round(score,6) AS score FROM sc")
def _(spark, d):
    return _scores(spark, d).select("region", "w", "n_in", "n_all", *r6("score"))


@query("kw_sector_words", f"WITH {_KR} SELECT region, w, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(score,9) DESC, w) AS rank FROM sc) WHERE rank<=4")
def _(spark, d):
    return keywords.top(_scores(spark, d), "region", 4).select("region", "w", "rank")


def _pairs_of(w: str) -> str:
    return f"list_distinct(list_transform(range(1,length({w})), lambda i: {w}[i:i+1]))"


_ALIKE = f"contains(x,w) OR contains(w,x) OR (least(len({_pairs_of('x')}),len({_pairs_of('w')}))>0 AND len(list_intersect({_pairs_of('x')},{_pairs_of('w')}))>=0.5*least(len({_pairs_of('x')}),len({_pairs_of('w')})))"


@query("feature_words", f"WITH RECURSIVE {_KR}, tp AS (SELECT region, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(score,9) DESC, w) AS rank FROM sc) WHERE rank<=60), fw AS (SELECT DISTINCT region, 0 AS k, []::VARCHAR[] AS kept FROM tp UNION ALL SELECT region, k+1, CASE WHEN any_alike THEN kept ELSE list_append(kept,w) END FROM (SELECT fw.region, fw.k, fw.kept, tp.w, len(list_filter(fw.kept, lambda x: {_ALIKE.replace('w)', 'tp.w)').replace('(w', '(tp.w').replace(' w[', ' tp.w[').replace(',w', ',tp.w')}))>0 AS any_alike FROM fw JOIN tp ON tp.region=fw.region AND tp.rank=fw.k+1)) SELECT region, (max_by(kept,k))[1:8] AS words FROM fw GROUP BY region")
def _(spark, d):
    return keywords.feature_words(_scores(spark, d))


@query("cluster_terms", f"WITH {_KW}, r AS (SELECT o_orderkey AS id, (o_custkey%6)::INT AS cluster FROM orders), va AS (SELECT w, count(*) AS va FROM w GROUP BY ALL), k AS (SELECT cluster, w, count(*) AS v FROM w JOIN r USING (id) GROUP BY ALL), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, w) AS c FROM k) WHERE c<=60 AND v>=3), s AS (SELECT cluster, w, v, v*least(1.0,5*v/va::DOUBLE) AS score FROM c JOIN va USING (w)) SELECT cluster, w, v, round(score,6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score,9) DESC, w) AS rank FROM s) WHERE rank<=6")
def _(spark, d):
    cl = t(spark, d, "orders").select(C("o_orderkey").alias("id"), (C("o_custkey") % 6).cast("int").alias("cluster"))
    return keywords.cluster_terms(_words(spark, d), cl).select("cluster", "w", "v", *r6("score"), "rank")


@query("weighted_sample", "SELECT region, id, rank::INT AS rank FROM (SELECT c_nationkey AS region, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(-ln(((c_custkey*7919)%9973+1)/9974.0)/(1+c_custkey%5),9), c_custkey) AS rank FROM customer) WHERE rank<=5")
def _(spark, d):
    rows = t(spark, d, "customer").select(C("c_nationkey").alias("region"), C("c_custkey").alias("id"), (1 + C("c_custkey") % 5).alias("w"))
    return keywords.weighted_sample(rows, "region", "w", ((C("id") * 7919) % 9973 + 1) / F.lit(9974.0), 5).select("region", "id", "rank")


@query("similar_words", "WITH n AS (SELECT DISTINCT p_name AS w FROM part), g AS (SELECT w, list_distinct(list_transform(range(1,length(w)), lambda i: w[i:i+1])) AS g FROM n) SELECT a.w AS a, b.w AS b FROM g a JOIN g b ON a.w<b.w WHERE contains(a.w,b.w) OR contains(b.w,a.w) OR (least(len(a.g),len(b.g))>0 AND len(list_intersect(a.g,b.g))>=0.5*least(len(a.g),len(b.g)))")
def _(spark, d):
    return keywords.similar_pairs(t(spark, d, "part"), "p_name")


@query("splitname", "WITH n AS (SELECT DISTINCT p_name AS w FROM part), c AS (SELECT w, list_filter(range(1,length(w)), lambda i: w[i]=' ') AS c FROM n), m AS (SELECT w, c, list_min(list_transform(c, lambda i: abs(i-length(w)/2.0)*1000+i)) AS m FROM c) SELECT w, CASE WHEN length(w)<=7 OR m IS NULL THEN [w] ELSE [w[1:(round(m)::INT%500)], w[(round(m)::INT%500)+1:]] END AS parts FROM m")
def _(spark, d):
    return t(spark, d, "part").select(C("p_name").alias("w")).distinct().select("w", X.split_name(C("w"), " ").alias("parts"))


# --- terrain ------------------------------------------------------------------------------------

_BOX, _N = (-1.0, 1.0, -1.0, 1.0), 24


def _points(spark, d):
    e = _emb(spark, d)
    return e.select(C("vec_id").alias("id"), C("label"), C("embedding")[0].cast("double").alias("x"), C("embedding")[1].cast("double").alias("y"), C("embedding")[2].cast("double").alias("z"))


_CELL = "greatest(0,least(floor(({0}+1)/2*24),23))::INT"
_H2 = f"p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), h AS (SELECT {_CELL.format('x')} AS ix, {_CELL.format('y')} AS iy, count(*)::DOUBLE AS v FROM p GROUP BY ALL)"


@query("hist2d", f"WITH {_H2} SELECT ix, iy, v FROM h")
def _(spark, d):
    return terrain.histogram2d(_points(spark, d), "x", "y", _BOX, _N, _N)


def _ker(sigma):
    w = terrain.gaussian(sigma)
    return "(VALUES " + ",".join(f"({i - len(w) // 2},{x!r}::DOUBLE)" for i, x in enumerate(w)) + ") k(d,w)"


_REF = "CASE WHEN (({0}+d)%48+48)%48>=24 THEN 47-(({0}+d)%48+48)%48 ELSE (({0}+d)%48+48)%48 END"


@query("density_smooth", f"WITH {_H2}, a AS (SELECT {_REF.format('ix')} AS ix, iy, sum(v*w) AS v FROM h, {_ker(1.2)} GROUP BY ALL), b AS (SELECT ix, {_REF.format('iy')} AS iy, sum(v*w) AS v FROM a, {_ker(1.2)} GROUP BY ALL) SELECT ix::INT AS ix, iy::INT AS iy, round(v,6) AS v FROM b")
def _(spark, d):
    return terrain.smooth(terrain.histogram2d(_points(spark, d), "x", "y", _BOX, _N, _N), 1.2, 1.2, _N, _N).select("ix", "iy", *r6("v"))


_YS = f"y AS (SELECT (2019+id%7)::INT AS year, {_CELL.format('x')} AS ix, {_CELL.format('y')} AS iy, count(*) AS n FROM p GROUP BY ALL), yt AS (SELECT (2019+id%7)::INT AS year, count(*) AS t FROM p GROUP BY ALL), f AS (SELECT year, ix, iy, n/t::DOUBLE AS v FROM y JOIN yt USING (year))"


def _year_fields(spark, d):
    p = _points(spark, d).withColumn("year", (2019 + C("id") % 7).cast("int"))
    return terrain.shares(p, "year", terrain.histogram2d(p, "x", "y", _BOX, _N, _N, "year"))


@query("year_share_diff", f"WITH {_H2}, {_YS}, m AS (SELECT ix, iy, sum(v)/7 AS m FROM f GROUP BY ALL) SELECT yt.year, m.ix, m.iy, round(coalesce(f.v,0)-m.m,6) AS diff FROM m JOIN yt ON true LEFT JOIN f ON f.year=yt.year AND f.ix=m.ix AND f.iy=m.iy")
def _(spark, d):
    return terrain.anomaly(_year_fields(spark, d)).select("year", "ix", "iy", *r6("diff"))


@query("year_change", f"WITH {_H2}, {_YS} SELECT ix, iy, round(sum(CASE WHEN year BETWEEN 2023 AND 2025 THEN v ELSE 0 END)/3-sum(CASE WHEN year BETWEEN 2019 AND 2021 THEN v ELSE 0 END)/3,6) AS diff FROM f GROUP BY ALL")
def _(spark, d):
    return terrain.change(_year_fields(spark, d), (2019, 2021), (2023, 2025)).select("ix", "iy", *r6("diff"))


def _two(spark, d):
    p = _points(spark, d).withColumn("g", (C("label") == 3).cast("int"))
    f = terrain.shares(p, "g", terrain.histogram2d(p, "x", "y", _BOX, _N, _N, "g"))
    return f.where("g = 1").drop("g"), f.where("g = 0").drop("g"), p


@query("total_variation", f"WITH {_H2}, g AS (SELECT (label=3)::INT AS g, {_CELL.format('x')} AS ix, {_CELL.format('y')} AS iy, count(*) AS n FROM p GROUP BY ALL), gt AS (SELECT (label=3)::INT AS g, count(*) AS t FROM p GROUP BY ALL), f AS (SELECT g, ix, iy, n/t::DOUBLE AS v FROM g JOIN gt USING (g)) SELECT round(0.5*sum(abs(coalesce(a.v,0)-coalesce(b.v,0)))/sum(b.v),6) AS tv FROM (SELECT * FROM f WHERE g=1) a FULL JOIN (SELECT * FROM f WHERE g=0) b USING (ix, iy)")
def _(spark, d):
    a, b, _ = _two(spark, d)
    return terrain.total_variation(terrain.contrast(a, b)).select(*r6("tv"))


_HALVES = f"pg AS (SELECT id, (label=3)::INT AS g, {_CELL.format('x')} AS ix, {_CELL.format('y')} AS iy FROM p), sf AS (SELECT g, ix, iy, count(*)::DOUBLE/any_value(t) AS v FROM pg JOIN (SELECT g, count(*) AS t FROM pg GROUP BY g) USING (g) GROUP BY ALL), hp AS (SELECT pg.*, i, {layout.SQL_UNIFORM.format('id', 'i')}<0.5 AS half FROM pg, range(4) r(i)), hs AS (SELECT g, i, half, ix, iy, count(*)::DOUBLE/any_value(t) AS v FROM hp JOIN (SELECT g, i, half, count(*) AS t FROM hp GROUP BY ALL) USING (g, i, half) GROUP BY ALL), hd AS (SELECT g, i, ix, iy, pow(coalesce(sum(v) FILTER (half),0)-coalesce(sum(v) FILTER (NOT half),0),2) AS d FROM hs GROUP BY ALL), sd AS (SELECT g, ix, iy, sqrt(sum(d)/16) AS sd FROM hd GROUP BY ALL)"


@query("group_contrast", f"WITH {_H2}, {_HALVES}, ab AS (SELECT ix, iy, coalesce(x.v,0) AS a, coalesce(y.v,0) AS b FROM (SELECT * FROM sf WHERE g=1) x FULL JOIN (SELECT * FROM sf WHERE g=0) y USING (ix, iy)) SELECT ix, iy, round(a,6) AS a, round(b,6) AS b, round(a-b,6) AS diff, abs(a-b)>2*sqrt(pow(coalesce(s.sd,0),2)+pow(coalesce(z.sd,0),2)) AS significant FROM ab LEFT JOIN (SELECT * FROM sd WHERE g=1) s USING (ix, iy) LEFT JOIN (SELECT * FROM sd WHERE g=0) z USING (ix, iy)")
def _(spark, d):
    a, b, p = _two(spark, d)
    field = lambda q: terrain.shares(q.withColumn("one", F.lit(1)), "one", terrain.histogram2d(q.withColumn("one", F.lit(1)), "x", "y", _BOX, _N, _N, "one")).drop("one")
    out = terrain.contrast(a, b, terrain.half_split_noise(p.where("g = 1"), "id", field), terrain.half_split_noise(p.where("g = 0"), "id", field))
    return out.select("ix", "iy", *r6("a", "b", "diff"), "significant")


@query("density_gini", f"WITH {_knn(15)}, d AS (SELECT 1/(dist*dist) AS v FROM edges WHERE rank=15 AND dist>0), r AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS n FROM d) SELECT round(sum((2*r-n-1)*v)/(any_value(n)*sum(v)),6) AS gini, round(log10(quantile_cont(v,0.9)/quantile_cont(v,0.1)),6) AS spread FROM r")
def _(spark, d):
    return ranks.gini(terrain.local_density(_edges(spark, d, 15), 15, 2), "density").select(*r6("gini", "spread"))


@query("entropy_hist", "WITH h AS (SELECT least(floor(l_discount*10*50),49) AS b, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT n/sum(n) OVER () AS p FROM h) SELECT round(-sum(p*ln(p)),6) AS entropy FROM p")
def _(spark, d):
    return terrain.entropy(t(spark, d, "lineitem").withColumn("s", C("l_discount") * 10), "s").select(*r6("entropy"))


def _field(spark, d):
    return terrain.smooth(terrain.histogram2d(_points(spark, d), "x", "y", _BOX, _N, _N), 1.2, 1.2, _N, _N).withColumn("v", F.round("v", 9))


@query("watershed_regions")
def _(spark, d):
    f = _field(spark, d)
    return terrain.watershed(f, terrain.box_peaks(f, 2, 0.03))


@query("region_weights")
def _(spark, d):
    f = _field(spark, d)
    peaks = terrain.box_peaks(f, 2, 0.03)
    p = _points(spark, d).select("id", terrain.cell(C("x"), -1.0, 1.0, _N).alias("ix"), terrain.cell(C("y"), -1.0, 1.0, _N).alias("iy"))
    return terrain.assigned(p, terrain.watershed(f, peaks), f, peaks)


def _unit3(spark, d):
    p = _points(spark, d)
    n = F.sqrt(C("x") ** 2 + C("y") ** 2 + C("z") ** 2)
    return p.select("id", *((C(c) / n).alias(c) for c in "xyz"))


def _sphere(spark, d, n=2000, sigma=0.2):
    at = Scratch(spark).table(terrain.nearest_node(_unit3(spark, d), n).groupBy("node").agg(F.count("*").cast("double").alias("v")))
    field = terrain.sphere_smooth(at, terrain.sphere_edges(spark, n, 3 * sigma), sigma)
    return terrain.sphere_regions(field.withColumn("v", F.round("v", 9)), n, sigma, occupied=at)


@query("sphere_regions")
def _(spark, d):
    return _sphere(spark, d)


@query("sphere_split_kmeans")
def _(spark, d):
    p = _unit3(spark, d)
    at = terrain.nearest_node(p, 2000).join(_sphere(spark, d), "node").select("id", "region")
    return terrain.split_regions(p, at, 100).select("id", "sector")


_PROBES = f"pr AS (SELECT sqrt(greatest(0.0,1-z*z))*cos(i*{math.pi * (3 - 5**0.5)!r}) AS x, sqrt(greatest(0.0,1-z*z))*sin(i*{math.pi * (3 - 5**0.5)!r}) AS y, z, i FROM (SELECT i, 1-(2*i+1)/40000.0::DOUBLE AS z FROM range(40000) r(i))), pt AS (SELECT embedding[1]::DOUBLE/n AS x, embedding[2]::DOUBLE/n AS y, embedding[3]::DOUBLE/n AS z FROM (SELECT embedding, sqrt(embedding[1]::DOUBLE**2+embedding[2]::DOUBLE**2+embedding[3]::DOUBLE**2) AS n FROM embeddings)), mx AS (SELECT i, max(a.x*b.x+a.y*b.y+a.z*b.z) AS c FROM pr a, pt b GROUP BY i)"


@query("ocean_share", f"WITH {_PROBES} SELECT deg, round(1-count(*) FILTER (c>=cos(radians(deg)))/40000.0::DOUBLE,6) AS share FROM mx, (VALUES (1.0::DOUBLE),(2.0::DOUBLE),(4.0::DOUBLE)) v(deg) GROUP BY deg")
def _(spark, d):
    return terrain.ocean(_unit3(spark, d), spark).select("deg", *r6("share"))


@query("sphere_xyz", "SELECT event_id, round(sin(value)*cos(value*2),6) AS x, round(sin(value)*sin(value*2),6) AS y, round(cos(value),6) AS z FROM events")
def _(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", *X.sphere_xyz(C("value"), C("value") * 2)).select("event_id", *r6("x", "y", "z"))


@query("torus_xyz", "SELECT event_id, round((3+cos(value*2))*cos(value),6) AS x, round((3+cos(value*2))*sin(value),6) AS y, round(sin(value*2),6) AS z FROM events")
def _(spark, d):
    return t(spark, d, "events").select("event_id", *X.torus_xyz(C("value"), C("value") * 2)).select("event_id", *r6("x", "y", "z"))


@query("robust_scale", "WITH q AS (SELECT quantile_cont(l_extendedprice,0.02) AS a, quantile_cont(l_extendedprice,0.98) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(greatest(-1.0,least(1.0,(l_extendedprice-a)/(b-a)*2-1)),6) AS s FROM lineitem, q")
def _(spark, d):
    rows = t(spark, d, "lineitem")
    a, b = ranks.quantile_values(rows, "l_extendedprice", 0.02, 0.98)
    return rows.select("l_orderkey", "l_linenumber", F.round(X.clip((C("l_extendedprice") - a) / (b - a) * 2 - 1, -1.0, 1.0), 6).alias("s"))


# --- colour -------------------------------------------------------------------------------------

_LAB = "l AS (SELECT vec_id AS id, 0.6+embedding[1]/4 AS l, embedding[2]/8 AS a, embedding[3]/8 AS b FROM embeddings), m AS (SELECT id, (l+0.3963377774::DOUBLE*a+0.2158037573::DOUBLE*b)**3 AS p, (l-0.1055613458::DOUBLE*a-0.0638541728::DOUBLE*b)**3 AS q, (l-0.0894841775::DOUBLE*a-1.2914855480::DOUBLE*b)**3 AS r FROM (SELECT id, l::DOUBLE AS l, a::DOUBLE AS a, b::DOUBLE AS b FROM l)), c AS (SELECT id, 4.0767416621::DOUBLE*p-3.3077115913::DOUBLE*q+0.2309699292::DOUBLE*r AS x, -1.2684380046::DOUBLE*p+2.6097574011::DOUBLE*q-0.3413193965::DOUBLE*r AS y, -0.0041960863::DOUBLE*p-0.7034186147::DOUBLE*q+1.7076147010::DOUBLE*r AS z FROM m)"
_S = "round_even(greatest(0,least(1,CASE WHEN {0}<=0.0031308 THEN 12.92*{0} ELSE 1.055*greatest({0},0)**(1/2.4)-0.055 END))*255,0)::SMALLINT"


@query("oklab_rgb", f"WITH {_LAB} SELECT id, {_S.format('x')} AS r, {_S.format('y')} AS g, {_S.format('z')} AS b FROM c")
def _(spark, d):
    v = lambda i, n: (C("embedding")[i] / n).cast("float")
    e = _emb(spark, d).select(C("vec_id").alias("id"), (F.lit(0.6).cast("float") + v(0, 4)).alias("l"), v(1, 8).alias("a"), v(2, 8).alias("b"))  # single precision, as in SQL
    r, g, b = X.rgb255(*(C(c).cast("double") for c in "lab"))
    return e.select("id", r.alias("r"), g.alias("g"), b.alias("b"))


@query("hue_agreement", "SELECT label, round(hypot_(sum(embedding[1]::DOUBLE/n), sum(embedding[2]::DOUBLE/n))/count(*),6) AS agree FROM (SELECT label, embedding, sqrt(embedding[1]::DOUBLE**2+embedding[2]::DOUBLE**2) AS n FROM embeddings) GROUP BY label".replace("hypot_(sum(embedding[1]::DOUBLE/n), sum(embedding[2]::DOUBLE/n))", "sqrt(sum(embedding[1]::DOUBLE/n)**2+sum(embedding[2]::DOUBLE/n)**2)"))
def _(spark, d):
    h = F.atan2("y", "x")
    return _points(spark, d).groupBy("label").agg(F.round(F.hypot(F.sum(F.cos(h)), F.sum(F.sin(h))) / F.count("*"), 6).alias("agree"))


def _linear(light: str, a: str, b: str) -> list[str]:
    lms = [f"pow({light}+({p})*({a})+({q})*({b}),3)" for p, q in X._LMS]
    return ["(" + "+".join(f"({k})*{x}" for k, x in zip(row, lms)) + ")" for row in X._RGB]


def _fits(chroma: str) -> str:
    return " AND ".join(f"{c} BETWEEN -1e-6 AND 1+1e-6" for c in _linear("l", f"{chroma}*cos(h)", f"{chroma}*sin(h)"))


@query("gamut_chroma", f"WITH RECURSIVE p AS (SELECT vec_id AS id, 0.5+embedding[1]::DOUBLE/4 AS l, atan2(embedding[2]::DOUBLE,embedding[1]::DOUBLE) AS h FROM embeddings), b AS (SELECT id, l, h, 0.0::DOUBLE AS lo, 0.4::DOUBLE AS hi, 0 AS i FROM p UNION ALL SELECT id, l, h, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, i+1 FROM (SELECT *, {_fits('mid')} AS ok FROM (SELECT *, (lo+hi)/2 AS mid FROM b WHERE i<16))) SELECT id, round(CASE WHEN {_fits('0.4')} THEN 0.4 ELSE lo END,6) AS chroma FROM b WHERE i=16")
def _(spark, d):
    e = _points(spark, d).select("id", (0.5 + C("x") / 4).alias("l"), F.lit(0.4).alias("c"), F.atan2("y", "x").alias("h"))
    return e.select("id", F.round(X.clamped_chroma(C("l"), C("c"), C("h")), 6).alias("chroma"))


def _ring(spark, d):
    import numpy as np

    e = _emb(spark, d)
    cent = knn.centroids(e, "label", "embedding").orderBy("label").collect()  # a row a label
    return e, model.ring_som(e, np.array([r["cent"] for r in cent]), rounds=8, ring=60, wide=8.0)


@query("ring_hues")
def _(spark, d):
    e, node = _ring(spark, d)
    return model.hues(e, node, model.kernel_width(e, node))


# --- map ----------------------------------------------------------------------------------------


@query("quantize_int16", "WITH b AS (SELECT min(embedding[1]) AS a, max(embedding[1]) AS z FROM embeddings) SELECT vec_id AS id, round_even((embedding[1]::DOUBLE-a::DOUBLE)/(z::DOUBLE-a::DOUBLE)*65535-32768,0)::SMALLINT AS q_x FROM embeddings, b")
def _(spark, d):
    return mapserve.quantise(_points(spark, d), "x").select("id", "q_x")


@query("uid_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)-1 AS uid FROM orders")
def _(spark, d):
    return mapserve.dense_id(t(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("shard_pages", "WITH u AS (SELECT *, row_number() OVER (ORDER BY o_orderkey)-1 AS uid FROM orders), p AS (SELECT (uid//2048)::BIGINT AS page, min(o_orderkey) AS first_key, count(*) AS n, '['||string_agg('{\"uid\":'||uid||',\"o_orderstatus\":\"'||o_orderstatus||'\",\"o_orderpriority\":\"'||o_orderpriority||'\"}', ',' ORDER BY uid)||']' AS payload FROM u GROUP BY ALL) SELECT *, sha1(payload) AS hash FROM p")
def _(spark, d):
    return mapserve.pages(t(spark, d, "orders"), "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("deeplink_lookup", "SELECT ((SELECT count(*) FROM orders WHERE o_orderkey<1001)//2048)::BIGINT AS page, (SELECT count(*) FROM orders WHERE o_orderkey<1001)%2048 AS row WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey=1001)")
def _(spark, d):
    return mapserve.lookup(t(spark, d, "orders"), "o_orderkey", 1001)


@query("search_text", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ',substr(text,1,48),lang,source)),'the') ORDER BY doc_id LIMIT 2000")
def _(spark, d):
    return mapserve.search(t(spark, d, "documents"), " THE ", ["text", "lang", "source"], "doc_id", {"text": 48})


@query("lasso_summary", "WITH s AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), i AS (SELECT label FROM s WHERE y>0 AND x>=0 AND x<0.5-y/2 AND y<1) SELECT 'all' AS kind, '' AS value, count(*) AS n, 1 AS rank FROM i UNION ALL SELECT 'label', value, n, rank FROM (SELECT label::VARCHAR AS value, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, label::VARCHAR))::INT AS rank FROM i GROUP BY label) WHERE rank<=5")
def _(spark, d):
    return mapserve.selection(_points(spark, d), "x", "y", [(0.0, 0.0), (0.5, 0.0), (0.0, 1.0)], {"label": 5})


@query("draw_order", "WITH n AS (SELECT label, vec_id%3 AS cat, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT cat, sum(n) AS m FROM n GROUP BY ALL) SELECT label, cat, n, coalesce(sum(n) OVER (ORDER BY CASE label WHEN 9 THEN 1 WHEN 3 THEN 2 ELSE 3 END, label, m DESC, cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS \"offset\" FROM n JOIN m USING (cat)")
def _(spark, d):
    return mapserve.draw_order(_emb(spark, d).select("label", (C("vec_id") % 3).alias("cat")), "label", "cat", ["9", "3"])


_HEX = f"a AS (SELECT ({3**0.5 / 3!r}*embedding[1]::DOUBLE-embedding[2]::DOUBLE/3)/0.1 AS q, {2 / 3!r}*embedding[2]::DOUBLE/0.1 AS r FROM embeddings), b AS (SELECT q, r, -q-r AS s FROM a), c AS (SELECT round_even(q,0) AS rq, round_even(r,0) AS rr, round_even(s,0) AS rs, abs(round_even(q,0)-q) AS dq, abs(round_even(r,0)-r) AS dr, abs(round_even(s,0)-s) AS ds FROM b)"


@query("hexbin", f"WITH {_HEX} SELECT (CASE WHEN dq>dr AND dq>ds THEN -rr-rs ELSE rq END)::BIGINT AS q, (CASE WHEN dq>dr AND dq>ds THEN rr WHEN dr>ds THEN -rq-rs ELSE rr END)::BIGINT AS r, count(*) AS n FROM c GROUP BY 1, 2")
def _(spark, d):
    return mapserve.hexbin(_points(spark, d), "x", "y", 0.1)


@query("orthographic", "SELECT vec_id AS id, round(embedding[2]::DOUBLE,6) AS px, round(embedding[3]::DOUBLE,6) AS py, embedding[1]>0 AS visible FROM embeddings")
def _(spark, d):
    return _points(spark, d).select("id", *mapserve.orthographic(C("x"), C("y"), C("z"), 0.0, 0.0)).select("id", *r6("px", "py"), "visible")


# --- places -------------------------------------------------------------------------------------


@query("pixel_colours", f"WITH {_H2} SELECT {_CELL.format('x')} AS ix, {_CELL.format('y')} AS iy, count(*) AS n, round(avg(label*20),6) AS r, round(avg(id%256),6) AS g, round(avg(label),6) AS b FROM p GROUP BY ALL")
def _(spark, d):
    p = _points(spark, d).select("x", "y", (C("label") * 20).alias("r"), (C("id") % 256).alias("g"), C("label").alias("b"))
    return places.pixel_colours(p, terrain.cell(C("x"), -1.0, 1.0, _N), terrain.cell(C("y"), -1.0, 1.0, _N)).select("ix", "iy", "n", *r6("r", "g", "b"))


@query("web_chroma", "WITH q AS (SELECT quantile_cont(l_discount,0.05) AS a, quantile_cont(l_discount,0.95) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(0.145*(0.85+0.45*least(1.0,greatest(0.0,(l_discount-a)/(b-a)))),6) AS chroma FROM lineitem, q")
def _(spark, d):
    return places.web_chroma(t(spark, d, "lineitem"), "l_discount").select("l_orderkey", "l_linenumber", *r6("chroma"))


@query("peak_words", f"WITH {_KW}, c AS (SELECT o_orderkey AS id, (o_orderkey%97)/97.0 AS x, (o_orderkey%89)/89.0 AS y FROM orders), p AS (SELECT * FROM (VALUES (1,0.2,0.3),(2,0.7,0.6)) p(peak,px,py)), n AS (SELECT peak, w, count(*) AS n_near FROM c JOIN p ON (x-px)**2+(y-py)**2<=0.04 JOIN w USING (id) GROUP BY ALL HAVING count(*)>=5), a AS (SELECT w, count(*) AS n_all FROM w GROUP BY ALL), z AS (SELECT peak, w, n_near, n_all, n_near/(n_all+20.0) AS score FROM n JOIN a USING (w)) SELECT peak, w, n_near, n_all, round(score,6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY peak ORDER BY round(score::DOUBLE,9) DESC, w) AS rank FROM z) WHERE rank<=4")
def _(spark, d):
    pts = t(spark, d, "orders").select(C("o_orderkey").alias("id"), (C("o_orderkey") % 97 / 97.0).alias("x"), (C("o_orderkey") % 89 / 89.0).alias("y"))
    peaks = spark.createDataFrame([(1, 0.2, 0.3), (2, 0.7, 0.6)], "peak int, px double, py double")
    return places.peak_words(pts, _words(spark, d), peaks, 0.2).select("peak", "w", "n_near", "n_all", *r6("score"), "rank")


@query("region_places")
def _(spark, d):
    f = _field(spark, d)
    peaks = terrain.box_peaks(f, 2, 0.03)
    p = _points(spark, d).withColumn("ix", terrain.cell(C("x"), -1.0, 1.0, _N)).withColumn("iy", terrain.cell(C("y"), -1.0, 1.0, _N))
    own = terrain.assigned(p, terrain.watershed(f, peaks), f, peaks).select("id", "region")
    return places.region_places(p.select("id", "x", "y"), own, peaks, _BOX, _N, _N, 10)


@query("sphere_places")
def _(spark, d):
    p = _unit3(spark, d)
    own = terrain.nearest_node(p, 2000).join(_sphere(spark, d), "node").select("id", "region")
    return places.sphere_places(p, own, 10)


_MIX = "m AS (SELECT lab, i, avg(w[i]) AS x FROM e, range(1,65) t(i) GROUP BY ALL), cn AS (SELECT lab, sqrt(sum(x*x)) AS n FROM m GROUP BY lab), sm AS (SELECT e.id, m.lab, sum(e.w[m.i]*m.x/cn.n) AS s FROM e, m JOIN cn ON cn.lab=m.lab GROUP BY ALL), sw AS (SELECT id, lab, exp(8*(s-max(s) OVER (PARTITION BY id))) AS w FROM sm), ab AS (SELECT id, sum(w*cos(2*pi()*lab/10))/sum(w)*0.17 AS a, sum(w*sin(2*pi()*lab/10))/sum(w)*0.17 AS b FROM sw GROUP BY id)"


def _byte(linear: str) -> str:
    return f"round_even(greatest(0.0,least(1.0,CASE WHEN {linear}<=0.0031308 THEN 12.92*{linear} ELSE 1.055*pow(greatest({linear},0.0),1/2.4)-0.055 END))*255,0)::SMALLINT"


@query("label_mix", f"WITH {_VEC}, {_MIX} SELECT id, " + ", ".join(f"{_byte(c)} AS {n}" for c, n in zip(_linear("0.72", "a", "b"), "rgb")) + " FROM ab")
def _(spark, d):
    e = _emb(spark, d)
    cent = [r["cent"] for r in knn.centroids(e, "label", "embedding").orderBy("label").collect()]  # a row a label
    return places.label_mix(e, "embedding", cent, 8.0)


@query("hue_warp", "SELECT event_id, round(CASE WHEN h<10 THEN (100+(h+360-200)/170*180)%360 WHEN h<=200 THEN 280+(h-10)/190*180-CASE WHEN 280+(h-10)/190*180>=360 THEN 360 ELSE 0 END ELSE (100+(h-200)/170*180)%360 END,6) AS hue FROM (SELECT event_id, (event_id*37%360)::DOUBLE AS h FROM events)")
def _(spark, d):
    h = (C("event_id") * 37 % 360).cast("double")
    return t(spark, d, "events").select("event_id", F.round(places.warp(h, [(10.0, 280.0), (200.0, 100.0)]), 6).alias("hue"))


@query("torus_tiles", "SELECT count(*) AS n, round(sum(u),4) AS u, round(sum(v),4) AS v FROM (SELECT value+a.i*6.0 AS u, value*2+b.i*6.0 AS v FROM events, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(i))")
def _(spark, d):
    p = places.tiled(t(spark, d, "events").select(C("value").alias("u"), (C("value") * 2).alias("v")), 6.0)
    return p.agg(F.count("*").alias("n"), F.round(F.sum("u"), 4).alias("u"), F.round(F.sum("v"), 4).alias("v"))


@query("interleaved_order", f"SELECT part*10+(label+part)%10 AS \"order\", count(*) AS n FROM (SELECT label, floor({layout.SQL_UNIFORM.format('vec_id', 0)}*16)::INT AS part FROM embeddings) GROUP BY 1")
def _(spark, d):
    e = _emb(spark, d)
    return places.interleaved(e, "vec_id", "label", [str(i) for i in range(10)]).groupBy(C("order").cast("int").alias("order")).agg(F.count("*").alias("n"))


# --- models -------------------------------------------------------------------------------------


@query("encode")
def _(spark, d):
    return model.encode(t(spark, d, "documents"), "text", "doc_id", 64)


@query("layout")
def _(spark, d):
    return model.layout(_emb(spark, d), "embedding", "vec_id")


def _transport(spark, d):
    e = _emb(spark, d).withColumn("year", 2019 + C("vec_id") % 7)
    n = min(10_000, max(1, e.count() // 10))  # the usual number of standards, or a tenth of a table that is too small for it
    return (e, "vec_id", "embedding", "year"), {"least_past": 2 * n, "standards": n}


@query("uot_surplus")
def _(spark, d):
    rows, how = _transport(spark, d)
    return model.surplus(*rows, **how)


@query("uot_years")
def _(spark, d):
    rows, how = _transport(spark, d)
    return model.surplus_years(model.transported(*rows, **how)[1])


@query("pair_accuracy")
def _(spark, d):
    return model.pair_accuracy(_emb(spark, d), "label", "embedding")


@query("hdbscan")
def _(spark, d):
    return density.density_clusters(knn.materialised(_edges(spark, d, 15)), 10)


_XML = '<grantAward id="P-{0}" projectType="project" awardNumber="{0}"><summary xml:lang="ja"><title>t{0}</title><keywordList><keyword> a </keyword><keyword>b</keyword></keywordList><periodOfAward searchStartFiscalYear="20{1}" searchEndFiscalYear="2025"/></summary></grantAward>'


@query("parse_xml", "SELECT n_nationkey::VARCHAR AS award_number, 't'||n_nationkey AS title, (2010+n_regionkey)::INT AS start_fy, ['a','b'] AS keywords FROM nation")
def _(spark, d):
    xml = F.format_string(_XML.replace("{0}", "%1$s").replace("{1}", "%2$s"), C("n_nationkey").cast("string"), (10 + C("n_regionkey")).cast("string"))
    raw = t(spark, d, "nation").select(F.from_xml(xml, " ".join(parse.RECORD.split())).alias("r")).select("r.*")
    return parse.awards(raw).select("award_number", "title", "start_fy", "keywords")
