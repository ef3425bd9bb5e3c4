"""Ranks over whole tables without one task for all rows."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.session import Scratch


#: Distinct values whose ranks may be sent to all tasks.
SENT_VALUES = 1_000_000


def rank_table(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """_v, rank, n of each distinct value: its average rank, from 1, and the number of rows.

    Values are counted first, with partial sums, so that a value of most rows is one row; distinct values
    are dealt by ranges, and the counts of the ranges before (a row a range) are added. Ranks go back to
    the rows by value: sent while there are at most SENT_VALUES of them, else joined.
    """
    t, found = _cumulated(rows, value)
    found = found.select("_v", (F.col("before") + (F.col("_c") + 1) / F.lit(2.0)).alias(name), "n")
    return F.broadcast(found) if t.count() <= SENT_VALUES else found


def _cumulated(rows: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """A written table of distinct values, and _v, _c, before, n: how often each stands, how many rows lie before it, and all rows."""
    t = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c")).repartitionByRange("_v").withColumn("_p", F.spark_partition_id())
    upto = Window.partitionBy("_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    t = Scratch(rows.sparkSession).table(t.withColumn("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0))))
    every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    size = t.groupBy("_p").agg(F.sum("_c").alias("_n"))
    before = size.select("_p", F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_a"), F.sum("_n").over(Window.partitionBy()).alias("n"))  # a row a range
    return t, t.join(F.broadcast(before), "_p").select("_v", "_c", (F.col("_a") + F.col("_b")).alias("before"), "n")


def quantile_values(rows: DataFrame, value: str, *shares: float, nearest: tuple[float, ...] = ()) -> list[float | None]:
    """Exact quantiles of all rows that have the value, without one task for all of them: linear ones of `shares`, then, of
    `nearest`, the smallest values that cover the share. At most two rows a quantile come back."""
    t, found = _cumulated(rows.where(F.col(value).isNotNull()).select(value), value)
    n = t.agg(F.sum("_c")).first()[0]
    if not n:
        return [None] * (len(shares) + len(nearest))
    spots = [q * (n - 1) for q in shares]
    last = [max(0, math.ceil(q * n - 1e-9) - 1) for q in nearest]
    wanted = sorted({k for h in spots for k in (math.floor(h), math.ceil(h))} | set(last))
    holds = reduce(lambda a, b: a | b, [(F.col("before") <= k) & (F.col("before") + F.col("_c") > k) for k in wanted])
    got = found.where(holds).collect()
    at = {k: float(r["_v"]) for r in got for k in wanted if r["before"] <= k < r["before"] + r["_c"]}
    return [at[math.floor(h)] + (at[math.ceil(h)] - at[math.floor(h)]) * (h - math.floor(h)) for h in spots] + [at[k] for k in last]


def _group_cumulated(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The columns of `by`, _v, _c, before, n: how often a value stands in its group, how many of the group's rows lie before it, and all of them.

    Equal values of a group are one counted row; counted rows are dealt by ranges of group and value, and summed up to each place, so that a group of
    most rows spans many tasks; a row a group and range carries what lies before.
    """
    t = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    t = t.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id())
    upto = Window.partitionBy("_p", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    t = Scratch(rows.sparkSession).table(t.withColumn("_b", F.coalesce(F.sum("_c").over(upto), F.lit(0))))
    size = t.groupBy("_p", *by).agg(F.sum("_c").alias("_n"))
    own, every = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select(F.col("_p").alias("_q"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.coalesce(F.sum("_n").over(every), F.lit(0)).alias("_a"), F.sum("_n").over(own).alias("n"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_p") == F.col("_q"))
    return t.join(before, same).select(*by, "_v", "_c", (F.col("_a") + F.col("_b")).alias("before"), "n")


def group_quantiles(rows: DataFrame, by: list[str], value: str, **shares: float) -> DataFrame:
    """The columns of `by`, and under each given name that linear quantile of the group's values; groups without any value have none.

    Of each group at most two counted rows a share are kept.
    """
    at = _group_cumulated(rows, by, value).select(*by, F.col("_v").cast("double").alias("_v"), "n", F.col("before").alias("lo"), (F.col("before") + F.col("_c")).alias("hi"))
    spot = {name: F.lit(q) * (F.col("n") - 1) for name, q in shares.items()}
    holds = lambda k: (F.col("lo") <= k) & (F.col("hi") > k)
    kept = at.where(reduce(lambda a, b: a | b, [holds(f(h)) for h in spot.values() for f in (F.floor, F.ceil)]))
    ends = [F.max(F.when(holds(f(h)), F.col("_v"))).alias(f"{name}_{e}") for name, h in spot.items() for e, f in (("x", F.floor), ("y", F.ceil))]
    got = kept.groupBy(*by).agg(F.max("n").alias("n"), *ends)
    return got.select(*by, *((F.col(f"{name}_x") + (F.col(f"{name}_y") - F.col(f"{name}_x")) * (h - F.floor(h))).alias(name) for name, h in spot.items()))


def group_spearman(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """The column `by`, rho: the rank correlation within each group, over rows with both values."""
    t = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(by).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"))
    for c in ("a", "b"):
        r = _group_cumulated(t, ["g"], c).select(F.col("g").alias("_g"), "_v", (F.col("before") + (F.col("_c") + 1) / F.lit(2.0)).alias(f"r{c}"))
        t = t.join(r, F.col("g").eqNullSafe(F.col("_g")) & (F.col(c) == F.col("_v"))).drop("_g", "_v")
    return t.groupBy(F.col("g").alias(by)).agg(F.corr("ra", "rb").alias("rho"))


def places(rows: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Adds the average rank of value, from 1, and n, the number of rows."""
    return rows.join(rank_table(rows, value, name), F.col(value).eqNullSafe(F.col("_v"))).drop("_v")


def quantiles(rows: DataFrame, value: str) -> DataFrame:
    """Adds q: average rank over the number of rows. Null values are left out."""
    return places(rows.where(F.col(value).isNotNull()), value).withColumn("q", F.col("rank") / F.col("n")).drop("rank", "n")


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rho and n over rows where both are defined."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    r = places(places(r, "a", "x").drop("n"), "b", "y")
    return r.agg(F.corr("x", "y").alias("rho"), F.count("*").alias("n"))


def gini(rows: DataFrame, value: str) -> DataFrame:
    """Gini coefficient and log10(p90 / p10); tied rows share their mean rank, which changes no sum."""
    r = places(rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), "v")
    lo, hi = quantile_values(rows, value, 0.1, 0.9)
    spread = F.lit(math.log10(hi / lo) if lo and hi and hi / lo > 0 else None).cast("double")
    return r.agg((F.sum((2 * F.col("rank") - F.col("n") - 1) * F.col("v")) / (F.max("n") * F.sum("v"))).alias("gini"), spread.alias("spread"))


def top_share_overlap(rows: DataFrame, a: str, b: str, share: float = 0.05) -> DataFrame:
    """Jaccard overlap of the top shares by two values (rows where both are defined)."""
    r = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    r = places(places(r, "a", "x").drop("n"), "b", "y")
    hi, lo = F.col("x") > (1 - share) * F.col("n"), F.col("y") > (1 - share) * F.col("n")
    return r.agg((F.count_if(hi & lo) / F.count_if(hi | lo)).alias("jaccard"))


def described(rows: DataFrame, *values: str) -> DataFrame:
    """metric, n, median (linear), p5 and p95 (nearest) of each value."""
    n = rows.agg(*(F.count(v).alias(v) for v in values)).first()
    out = [(v, n[v], *quantile_values(rows.select(F.col(v).cast("double").alias("v")), "v", 0.5, nearest=(0.05, 0.95))) for v in values if n[v]]
    return rows.sparkSession.createDataFrame(out, "metric string, n long, median double, p5 double, p95 double")  # a row a metric
