"""What the map needs: dense ids, quantised coordinates, pages, search, selection, lookup."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiscape.functions.columns import inside
from lexiscape.session import Scratch


def dense_id(rows: DataFrame, key: str, name: str = "uid") -> DataFrame:
    """0-based place in key order, without one task for all rows.

    Rows are dealt by ranges, sorted and written once, each with its range and place there; the sizes of the ranges
    before (a row a range) are added when the table is read. Nulls come first; rows of one key are in no fixed order.
    """
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    t = Scratch(rows.sparkSession).table(ranged)  # once: a second shuffle might deal other ranges
    split = F.shiftright("_m", 33)
    size = t.groupBy(split.alias("_p")).agg(F.count("*").alias("_n"))
    before = size.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a range
    own = t.withColumn("_p", split).join(F.broadcast(before), "_p")
    return own.withColumn(name, F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b")).drop("_p", "_m", "_b")


def quantised(x: Column, lo: Column, hi: Column) -> Column:
    """Linear to the full int16 range, half to even."""
    return F.rint((x - lo) / (hi - lo) * 65535 - 32768).cast("short")


def quantise(rows: DataFrame, *axes: str) -> DataFrame:
    box = rows.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return rows.select("*", *(quantised(F.col(a), F.lit(box[f"lo_{a}"]), F.lit(box[f"hi_{a}"])).alias(f"q_{a}") for a in axes))


def pages(rows: DataFrame, key: str, fields: list[str], size: int = 2048) -> DataFrame:
    """page, first_key, n, payload (JSON), hash: rows in key order, `size` a page."""
    t = dense_id(rows.select(key, *(f for f in fields if f != key)), key).withColumn("page", F.floor(F.col("uid") / size).cast("long"))
    own = F.array_sort(F.collect_list(F.struct("uid", *fields)))
    out = t.groupBy("page").agg(F.min_by(key, "uid").alias("first_key"), F.count("*").alias("n"), F.to_json(own).alias("payload"))
    return out.withColumn("hash", F.sha1("payload"))


def version(page_rows: DataFrame, group: int = 4096) -> str:
    """Content-addressed version: a hash over the hashes in order of page, by groups until one is left."""
    t = page_rows.select("page", "hash")
    left = (t.agg(F.max("page")).first()[0] or 0) + 1
    while True:
        own = F.transform(F.array_sort(F.collect_list(F.struct("page", "hash"))), lambda s: s["hash"])
        t, left = t.groupBy(F.floor(F.col("page") / group).cast("long").alias("page")).agg(F.sha1(F.array_join(own, "")).alias("hash")), -(-left // group)
        if left <= 1:
            found = t.first()
            return found["hash"] if found else hashlib.sha1(b"").hexdigest()


def lookup(rows: DataFrame, key: str, value, size: int = 2048) -> DataFrame:
    """page, row of one key: how many keys lie before it decides."""
    return rows.agg(F.count_if(F.col(key) < F.lit(value)).alias("u"), F.count_if(F.col(key) == F.lit(value)).alias("n")).where("n > 0").select(F.floor(F.col("u") / size).cast("long").alias("page"), (F.col("u") % size).cast("long").alias("row"))


def search(rows: DataFrame, query: str, fields: list[str], key: str, cut: dict[str, int] = {}, cap: int = 2000) -> DataFrame:
    """Ids whose fields hold the query, whatever its case; queries of one character find nothing."""
    q = query.strip().lower()
    if len(q) < 2:
        return rows.select(key).limit(0)
    cols = [F.substring(f, 1, cut[f]) if f in cut else F.col(f) for f in fields]
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(q))).select(key).orderBy(key).limit(cap)


def selection(rows: DataFrame, x: str, y: str, polygon: list[tuple[float, float]], facets: dict[str, int]) -> DataFrame:
    """kind, value, n, rank: the size of a polygon's selection and the most common values of each facet."""
    own = rows.where(inside(F.col(x), F.col(y), polygon))
    out = own.agg(F.count("*").alias("n")).select(F.lit("all").alias("kind"), F.lit("").alias("value"), "n", F.lit(1).alias("rank"))
    for f, k in facets.items():
        n = own.groupBy(F.col(f).cast("string").alias("value")).agg(F.count("*").alias("n"))
        n = n.orderBy(F.desc("n"), "value").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))  # k rows
        out = out.unionByName(n.select(F.lit(f).alias("kind"), "value", "n", "rank"))
    return out


def draw_order(rows: DataFrame, label: str, category: str, first: list[str]) -> DataFrame:
    """label, category, n, offset: labels in the given order and then by name; categories by size."""
    n = rows.groupBy(label, category).agg(F.count("*").alias("n"))
    size = n.groupBy(category).agg(F.sum("n").alias("m"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, first)), F.col(label).cast("string")), F.lit(0)), F.lit(len(first) + 1))
    w = Window.orderBy(place, label, F.desc("m"), category)  # a row a label and category
    return n.join(size, category).select(label, category, "n", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def orthographic(x: Column, y: Column, z: Column, lon: float, lat: float) -> list[Column]:
    """px, py, visible of unit vectors seen from above (lon, lat in radians)."""
    import math

    cl, sl, ca, sa = math.cos(lon), math.sin(lon), math.cos(lat), math.sin(lat)
    return [(-sl * x + cl * y).alias("px"), (-sa * cl * x - sa * sl * y + ca * z).alias("py"), ((ca * cl * x + ca * sl * y + sa * z) > 0).alias("visible")]


def hexbin(rows: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """q, r, n: hexagonal bins in axial coordinates, by cube rounding."""
    q = (F.lit(3**0.5 / 3) * F.col(x) - F.col(y) / 3) / size
    r = F.lit(2 / 3) * F.col(y) / size
    t = rows.select(q.alias("q"), r.alias("r")).withColumn("s", -F.col("q") - F.col("r"))
    for c in "qrs":
        t = t.withColumn(f"r{c}", F.rint(c)).withColumn(f"d{c}", F.abs(F.rint(c) - F.col(c)))
    rq = F.when((F.col("dq") > F.col("dr")) & (F.col("dq") > F.col("ds")), -F.col("rr") - F.col("rs")).otherwise(F.col("rq"))
    rr = F.when((F.col("dq") > F.col("dr")) & (F.col("dq") > F.col("ds")), F.col("rr")).otherwise(F.when(F.col("dr") > F.col("ds"), -F.col("rq") - F.col("rs")).otherwise(F.col("rr")))
    return t.select(rq.cast("long").alias("q"), rr.cast("long").alias("r")).groupBy("q", "r").agg(F.count("*").alias("n"))
