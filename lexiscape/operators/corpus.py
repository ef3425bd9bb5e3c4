"""From parsed records to a text corpus, with its guards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CARRIED = ("award_number", "kaken_id", "title", "category", "review_sections", "shokubun_codes", "start_fy", "end_fy", "period_start_fy_raw", "old_award_numbers", "keywords", "n_members")


def kept(awards: DataFrame, first: int = 2019, last: int = 2025) -> DataFrame:
    """Records of the years (by the raw start year), with an abstract, not declined; a null status stays."""
    year = F.col("period_start_fy_raw" if "period_start_fy_raw" in awards.columns else "start_fy")
    return awards.where(year.between(first, last) & ~F.col("status_code").eqNullSafe("declined") & F.coalesce("abstract_initial", "abstract_achievement").isNotNull())


def text(title: Column, keywords: Column, abstract: Column, mark: str = "、") -> Column:
    """Title, keywords and abstract by line; nulls go, an empty keyword list leaves an empty line."""
    return F.concat_ws("\n", title, F.array_join(keywords, mark), abstract)


def build(awards: DataFrame) -> DataFrame:
    """The corpus: carried columns (those that exist) and text."""
    rows = kept(awards)
    carried = [c for c in CARRIED if c in awards.columns]
    return rows.select(*carried, text(F.col("title"), F.col("keywords"), F.coalesce("abstract_initial", "abstract_achievement")).alias("text"))


def token_counter(tokenizer) -> Callable[[Column], Column]:
    """A column function that counts a tokenizer's ids; tokenizer: a function without arguments that gives, in a task, one from texts to lists of ids."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ids = tokenizer()
        for b in batches:
            yield pd.Series([len(x) for x in ids(b.fillna("").tolist())], dtype="int32")

    return count


def token_count(column: Column) -> Column:
    """Words between white space; token_counter counts with a tokenizer instead."""
    return F.when(F.trim(column) == "", 0).otherwise(F.size(F.split(F.trim(column), r"\s+")))


def token_stats(rows: DataFrame, column: str = "n_tokens", limit: int = 8192) -> DataFrame:
    """min, median, p99 (linear), max, and how many exceed the limit."""
    return rows.agg(F.min(column).cast("long").alias("min"), F.percentile(column, 0.5).alias("median"), F.percentile(column, 0.99).alias("p99"), F.max(column).cast("long").alias("max"), F.count_if(F.col(column) > limit).alias("n_over"))


def year_jumps(rows: DataFrame, key: str, year: str, least: int = 500, factor: float = 2.0) -> DataFrame:
    """Years with at least `least` rows and over `factor` times the year just before."""
    w = Window.partitionBy(key).orderBy(year)
    n = rows.groupBy(key, year).agg(F.count("*").alias("n"))
    return n.select(key, year, "n", F.lag("n").over(w).alias("prev_n"), F.lag(year).over(w).alias("_py")).where((F.col("_py") == F.col(year) - 1) & (F.col("n") >= least) & (F.col("n") > factor * F.col("prev_n"))).drop("_py")


def drift(old: DataFrame, new: DataFrame, key: str = "award_number") -> DataFrame:
    """Rows whose text changed."""
    return new.alias("n").join(old.alias("o"), key).where("n.text <> o.text").select(key, F.col("o.text").alias("old_text"), F.col("n.text").alias("new_text"))


def same_keys(old: DataFrame, new: DataFrame, key: str = "award_number") -> bool:
    """Both have the same keys; physical order is no contract here."""
    return old.join(new, key, "left_anti").isEmpty() and new.join(old, key, "left_anti").isEmpty()


def keep_embedded_text(old: DataFrame, new: DataFrame, key: str = "award_number") -> DataFrame:
    """Rows of `new` with the text that was embedded before, where there is one."""
    return new.join(old.select(key, F.col("text").alias("_old")), key, "left").withColumn("text", F.coalesce("_old", "text")).drop("_old")


def any_substring(column: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(column, F.lit(w)) for w in words])


def topic(title: Column, body: Column, pattern: str, excluded: str, least: int = 2) -> Column:
    """Excluded phrases are erased; then a hit in the title or `least` hits in the body."""
    t, b = F.regexp_replace(title, excluded, ""), F.regexp_replace(body, excluded, "")
    return t.rlike(pattern) | (F.regexp_count(b, F.lit(pattern)) >= least)


def category_groups(rows: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """(group, row) for groups that may overlap."""
    return rows.withColumn("grp", F.explode(F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in groups.items())), lambda x: x.isNotNull())))


def year_spec(spec: str) -> list[int]:
    """`2018-2021,2023` as a list."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        lo, _, hi = part.partition("-")
        out += range(int(lo), int(hi or lo) + 1)
    return out
