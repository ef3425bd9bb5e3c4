"""Checks and projections of record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscape.functions.columns import dot, norm


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key: each task keeps n."""
    return rows.orderBy(key).limit(n)


def type_code(record_id: Column, prefix: str) -> Column:
    """The capital letters between a prefix and the number in `PREFIX-TYPE-number`; null where there are none."""
    return F.nullif(F.regexp_extract(record_id, rf"^{prefix}-([A-Z]+)-", 1), F.lit(""))


def recomposes(record_id: Column, prefix: str, code: Column, number: Column) -> Column:
    """Whether prefix, type and number make up the id, so that the id need not be stored."""
    return record_id.eqNullSafe(F.concat(F.lit(f"{prefix}-"), code, F.lit("-"), number))


def record_url(record_id: Column, base: str = "https://example.org/record") -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), record_id, F.lit("/"))


def mapped(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Values through a dictionary; those that it lacks are `default`."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, column), F.lit(default))


def short_title(title: Column, missing: str = "(untitled)", length: int = 48) -> Column:
    """The first characters of a title, or a placeholder."""
    return F.substring(F.coalesce(title, F.lit(missing)), 1, length)


# Characters that a region's name may have, and its length.
NAME_CHARACTERS = r"^[぀-ヿ㐀-鿿ｦ-ﾟͰ-ϿA-Za-z0-9・ー々〜～\-/&()（）\s]+$"
NAME_LENGTH = (4, 14)


def name_ok(name: Column) -> Column:
    """Whether a proposed name has allowed characters only and a length in bounds."""
    return F.coalesce(name.rlike(NAME_CHARACTERS) & F.char_length(name).between(*NAME_LENGTH), F.lit(False))


def aligned(key: str, *frames: DataFrame) -> DataFrame:
    """Tables side by side by key. A key that repeats, or that one of them lacks, is an error."""
    sizes = [f.agg(F.count("*").alias("n"), F.count_distinct(key).alias("k")).first() for f in frames]
    out = reduce(lambda a, b: a.join(b, key), frames)
    if any(s["n"] != s["k"] for s in sizes) or len({s["n"] for s in sizes}) != 1 or out.count() != sizes[0]["n"]:
        raise ValueError(f"the tables do not have the same {key} values, once each")
    return out


def same_order(old: DataFrame, new: DataFrame, key: str, place: str) -> DataFrame:
    """n_bad: keys that one side lacks or that stand at another place."""
    both = old.select(key, F.col(place).alias("_a")).join(new.select(key, F.col(place).alias("_b")), key, "full")
    return both.agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("n_bad"))


def dictionary(rows: DataFrame, *columns: str) -> DataFrame:
    """name, value, code: the distinct values of a few columns in order, numbered from 0."""
    from pyspark.sql import Window

    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("s")).select("s.*").where("value is not null").distinct()
    return long.withColumn("code", F.row_number().over(Window.partitionBy("name").orderBy("value")) - 1)


def norm_error(rows: DataFrame, vector: str) -> DataFrame:
    """n, worst: the largest distance of a vector's length from 1."""
    return rows.agg(F.count("*").alias("n"), F.max(F.abs(norm(F.col(vector)) - 1)).alias("worst"))


def similar_to(rows: DataFrame, key: str, vector: str, item, k: int = 16) -> DataFrame:
    """id, sim: the k rows most like one of them, itself included; ties: the smaller id."""
    own = rows.where(F.col(key) == item).select(vector).first()
    if own is None:
        return rows.select(F.col(key).alias("id"), F.lit(0.0).alias("sim")).limit(0)
    q = F.array(*(F.lit(float(x)) for x in own[0]))
    sim = F.round(dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q)), 12)
    return rows.select(F.col(key).alias("id"), sim.alias("sim")).orderBy(F.desc("sim"), "id").limit(k)


def merged(meta: DataFrame, key: str, *tables: DataFrame) -> DataFrame:
    """All rows of meta, with the columns of every table that has their key."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, meta)


def filtered(rows: DataFrame, hidden: dict[str, list[str]]) -> DataFrame:
    """Rows of which no column has a value that is switched off."""
    return reduce(lambda t, kv: t.where(~F.coalesce(F.col(kv[0]).cast("string").isin(kv[1]), F.lit(False))) if kv[1] else t, hidden.items(), rows)


def toggles(rows: DataFrame, hidden: dict[str, list[str]]) -> DataFrame:
    """facet, value, n, shown: the counts beside the switches of each facet, over all rows."""
    out = None
    for f, off in hidden.items():
        value = F.col(f).cast("string")
        n = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
        n = n.select(F.lit(f).alias("facet"), "value", "n", (~F.coalesce(F.col("value").isin(off), F.lit(False)) if off else F.lit(True)).alias("shown"))
        out = n if out is None else out.unionByName(n)
    return out


def set_parts(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, side: different keys that stand in both tables, in a only, or in b only; nulls are equal."""
    both = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return both.select(*keys, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "a").otherwise("b").alias("side"))
