"""Report tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.functions.columns import dot, norm
from lexiscape.operators import ranks
from lexiscape.session import Scratch


def correlations(rows: DataFrame, *metrics: str, share: float = 0.05) -> DataFrame:
    """a, b, n, rho, jaccard: for each pair of metrics the rank correlation and the overlap of the top shares, over rows with both."""
    pairs = list(combinations(metrics, 2))
    gaps = rows.agg(*(F.count_if(F.col(m).isNull()).alias(m) for m in metrics)).first()
    if not any(gaps):  # one rank a metric serves all pairs, and one aggregate has them all
        t = rows.select(*metrics)
        for m in metrics:
            t = t.join(ranks.rank_table(rows, m, f"r_{m}").withColumnRenamed("n", f"n_{m}"), F.col(m) == F.col("_v")).drop("_v")
        top = {m: F.col(f"r_{m}") > (1 - share) * F.col(f"n_{m}") for m in metrics}
        one = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count("*").alias("n"), F.corr(f"r_{a}", f"r_{b}").alias("rho"), (F.count_if(top[a] & top[b]) / F.count_if(top[a] | top[b])).alias("jaccard"))
        return t.agg(F.array(*(one(a, b) for a, b in pairs)).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    out = None
    for a, b in pairs:
        rho = ranks.spearman(rows, a, b)
        both = ranks.top_share_overlap(rows, a, b, share)
        one = rho.withColumn("a", F.lit(a)).withColumn("b", F.lit(b)).join(F.broadcast(both)).select("a", "b", "n", "rho", "jaccard")  # a row each
        out = one if out is None else out.unionByName(one)
    return out


def independent_overlap(share: float = 0.05) -> float:
    """What two unrelated metrics' top shares have in common."""
    return share / (2 - share)


def rank_medians(rows: DataFrame, group: Column, *metrics: str) -> DataFrame:
    """grp, metric, n, median of the percentile rank among all rows."""
    out = None
    for m in metrics:
        q = ranks.quantiles(rows.select(group.alias("grp"), F.col(m).alias("v")), "v")
        n = q.groupBy(F.col("grp").alias("_g")).agg(F.count("*").alias("n"))
        one = ranks.group_quantiles(q, ["grp"], "q", median=0.5).join(n, F.col("grp").eqNullSafe(F.col("_g"))).select("grp", F.lit(m).alias("metric"), "n", "median")
        out = one if out is None else out.unionByName(one)
    return out


def by_year(rows: DataFrame, year: str, value: str, baseline: DataFrame) -> DataFrame:
    """year, n, median, p75 beside a baseline's (year, base_median, base_p75)."""
    t = rows.where(F.col(value).isNotNull()).select(F.col(year).alias("year"), F.col(value).alias("v"))
    own = ranks.group_quantiles(t, ["year"], "v", median=0.5, p75=0.75).join(t.groupBy("year").agg(F.count("*").alias("n")), "year")
    return baseline.join(own, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), "median", "p75", "base_median", "base_p75")


def topic(rows: DataFrame, year: str, hit: Column, category: str) -> DataFrame:
    """kind, value, n, hits, per_mille: a topic's counts by year and by category, and of all rows."""
    marked = rows.select(F.col(year).cast("string").alias("year"), F.col(category).cast("string").alias("category"), F.coalesce(hit, F.lit(False)).alias("hit"))
    cube = marked.groupingSets([["year"], ["category"], []], "year", "category").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "year").when(F.col("g") == 2, "category").otherwise("all")
    return cube.select(kind.alias("kind"), F.coalesce("year", "category", F.lit("")).alias("value"), "n", "hits", (1000.0 * F.col("hits") / F.col("n")).alias("per_mille"))


def coverage(rows: DataFrame, group: str, hit: Column) -> DataFrame:
    """group, n, hits, share of the hits that fall into the group, largest first."""
    n = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    return n.withColumn("share", F.col("hits") / F.sum("hits").over(Window.partitionBy()))  # a row a group


def merge_candidates(distance: DataFrame, groups: DataFrame, accuracy: DataFrame | None = None) -> DataFrame:
    """a, b, d, rank_all, rank_in_group[, bal_acc, acc_rank]: how near b is to a among all labels and among those of b's group.

    distance: a, b, d of ordered pairs; groups: lab, grp; accuracy: a, b, bal_acc, ranked among distinct values.
    """
    pairs = distance.join(groups.withColumnRenamed("lab", "b").withColumnRenamed("grp", "grp_b"), "b")
    at = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.round("d", 9), "b"))
    out = pairs.select("a", "b", "d", at("a").alias("rank_all"), at("a", "grp_b").alias("rank_in_group"))
    if accuracy is None:
        return out
    return out.join(accuracy, ["a", "b"], "left").withColumn("acc_rank", F.when(F.col("bal_acc").isNotNull(), F.dense_rank().over(Window.orderBy(F.col("bal_acc").asc_nulls_last()))))  # a row a pair of labels


def merge_report(merges: DataFrame, distance: DataFrame, groups: DataFrame, lift: DataFrame, accuracy: DataFrame | None = None, lean: DataFrame | None = None) -> DataFrame:
    """a, b, d, rank_all, rank_in_group, share, lift, nearest, nearest_rank[, bal_acc, acc_rank][, n_lean_a, n_lean_b, n_tie]: for planned merges (a, b), how near both are.

    distance and groups: see `merge_candidates`; lift: src_lab, dst_lab, share, lift (`knn.label_lift`); nearest: the label that a's neighbours have most, and
    nearest_rank, b's place among them; lean: a, b, side of the items in question (`knn.lean`).
    """
    near = merge_candidates(distance, groups, accuracy)
    order = Window.partitionBy("src_lab").orderBy(F.desc(F.round("share", 9)), "dst_lab")  # a row a label
    ranked = lift.withColumn("nearest_rank", F.row_number().over(order)).withColumn("nearest", F.first("dst_lab").over(order))
    own = ranked.select(F.col("src_lab").alias("a"), F.col("dst_lab").alias("b"), "share", "lift", "nearest_rank")
    first = ranked.where("nearest_rank = 1").select(F.col("src_lab").alias("a"), "nearest")
    out = merges.select("a", "b").join(near, ["a", "b"], "left").join(own, ["a", "b"], "left").join(first, "a", "left")
    if lean is None:
        return out
    sides = lean.groupBy("a", "b").agg(F.count_if(F.col("side") == "A").alias("n_lean_a"), F.count_if(F.col("side") == "B").alias("n_lean_b"), F.count_if(F.col("side") == "tie").alias("n_tie"))
    return out.join(sides, ["a", "b"], "left")


def topic_report(rows: DataFrame, year: str, hit: Column, parts: dict[str, Column]) -> DataFrame:
    """kind, value, n, hits, per_mille, share: a topic's counts by year, of all, and by each given part (category, origin, region, cluster, ...);
    share: of the topic's items, how many fall to the value. Null values are left out."""
    cols = {"year": F.col(year)} | parts
    marked = rows.select(*(c.cast("string").alias(f"_{i}") for i, c in enumerate(cols.values())), F.coalesce(hit, F.lit(False)).alias("hit"))
    each = F.explode(F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")), *(F.struct(F.lit(k).alias("kind"), F.col(f"_{i}").alias("value")) for i, k in enumerate(cols))))
    n = marked.select("hit", each.alias("x")).where("x.value is not null").groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    total = marked.agg(F.count_if("hit").alias("total"))
    return n.join(F.broadcast(total)).select("kind", "value", "n", "hits", (1000.0 * F.col("hits") / F.col("n")).alias("per_mille"), (F.col("hits") / F.col("total")).alias("share"))  # one row is sent


def similarity_spread(rows: DataFrame, key: str, vector: str, strides: int = 10) -> DataFrame:
    """n, median, p5, p95 of the cosine of each row with its next rows by id, `strides` of them: a bounded share of all pairs that has every row."""
    from lexiscape.operators.mapserve import dense_id

    t = dense_id(rows.select(F.col(key).alias("id"), F.col(vector).alias("v")), "id")
    ahead = t.select(F.explode(F.sequence(F.lit(1), F.lit(strides))).alias("s"), "uid", "v").select((F.col("uid") + F.col("s")).alias("uid"), F.col("v").alias("w"))
    sim = Scratch(rows.sparkSession).table(t.join(ahead, "uid").select((dot(F.col("v"), F.col("w")) / (norm(F.col("v")) * norm(F.col("w")))).alias("sim")))
    got = ranks.quantile_values(sim, "sim", nearest=(0.5, 0.05, 0.95))
    return sim.agg(F.count("*").alias("n")).select("n", *(F.lit(x).cast("double").alias(c) for x, c in zip(got, ("median", "p5", "p95"))))


def card(name: str, tables: dict[str, DataFrame]) -> str:
    """A data card in Markdown: rows and columns of each table."""
    lines = [f"# {name}", "", "| Table | Rows | Columns |", "|-|-|-|"]
    return "\n".join(lines + [f"| {k} | {t.count():,} | {', '.join(t.columns)} |" for k, t in tables.items()]) + "\n"
