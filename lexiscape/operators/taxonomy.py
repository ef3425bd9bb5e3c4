"""Three-level taxonomies and labels from sets of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERAL, NONE = "複数", "区分なし"


def labels(rows: DataFrame, sections: str, key: str, small: DataFrame, medium: DataFrame, default: str = NONE) -> DataFrame:
    """key, dai: the one broad code of a record's sections; several or none are named so.

    small: code, dai of 5-digit codes; medium: code, dai of medium codes; a section `大区分X` names its broad code.
    """
    one = rows.select(key, F.explode_outer(sections).alias("s")).select(
        key,
        F.nullif(F.regexp_extract("s", r"^小区分(\d{5})", 1), F.lit("")).alias("small"),
        F.nullif(F.regexp_extract("s", r"^中区分(\d+)", 1), F.lit("")).alias("medium"),
        F.nullif(F.regexp_extract("s", r"^大区分([A-K])", 1), F.lit("")).alias("large"),
    )
    one = one.join(small.select(F.col("code").alias("small"), F.col("dai").alias("d1")), "small", "left").join(medium.select(F.col("code").alias("medium"), F.col("dai").alias("d2")), "medium", "left")
    found = one.select(key, F.coalesce("large", "d2", "d1").alias("d")).groupBy(key).agg(F.collect_set("d").alias("d"))
    return found.select(key, F.when(F.size("d") == 1, F.get("d", F.lit(0))).when(F.size("d") > 1, F.lit(SEVERAL)).otherwise(F.lit(default)).alias("dai"))


def flattened(raw: DataFrame, schema: str, column: str = "xml") -> DataFrame:
    """dai_code, chu_code, chu_name, sho_code, sho_name from nested XML; level prefixes go, small codes have five digits."""
    t = raw.select(F.explode(F.from_xml(column, schema)["large"]).alias("d"))
    t = t.select(F.col("d._code").alias("dai_code"), F.explode("d.medium").alias("c"))
    t = t.select("dai_code", F.col("c._code").alias("chu_code"), F.regexp_replace("c.name", r"^中区分\d+[:：]?", "").alias("chu_name"), F.explode("c.small").alias("s"))
    return t.select("dai_code", "chu_code", "chu_name", F.col("s._code").alias("sho_code"), F.regexp_replace("s.name", r"^小区分\d+[:：]?", "").alias("sho_name")).where(F.col("sho_code").rlike(r"^\d{5}$"))


TAXONOMY = "large array<struct<_code:string, medium:array<struct<_code:string, name:string, small:array<struct<_code:string, name:string>>>>>>"


def memberships(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, n_memberships, memberships."""
    return rows.groupBy(key).agg(F.count("*").alias("n_memberships"), F.array_sort(F.collect_list(F.struct(*fields))).alias("memberships"))


# The revised broad divisions. Old letter to new where the middle division doesn't matter, and words that decide.
REVISED = {"A": "A", "E": "G", "F": "H", "G": "I", "H": "J", "I": "K", "J": "L", "K": "M"}
REVISED_BY_WORD = {"B": ((("素粒子", "天文"), "C"), ((), "B")), "C": ((("電気電子",), "E"), ((), "D")), "D": ((("材料工学",), "E"), (("原子力",), "D"), ((), "F"))}


def revised(old: Column, middle: Column) -> Column:
    """The new broad division of an old one and a middle division's name; `?` for others."""
    out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in REVISED.items() for x in kv)), old), F.lit("?"))
    for letter, rules in REVISED_BY_WORD.items():
        found = F.lit(rules[-1][1])
        for words, new in reversed(rules[:-1]):
            has = F.lit(False)
            for w in words:
                has = has | F.contains(F.coalesce(middle, F.lit("")), F.lit(w))
            found = F.when(has, new).otherwise(found)
        out = F.when(old == letter, found).otherwise(out)
    return out


def write_tidy(table: DataFrame, path: str, key: str, fields: list[str]) -> None:
    """A CSV of one row a code, and JSON lines of a code with its memberships."""
    table.orderBy(key).coalesce(1).write.mode("overwrite").csv(f"{path}/csv", header=True)  # a taxonomy: a row a code
    memberships(table, key, fields).orderBy(key).coalesce(1).write.mode("overwrite").json(f"{path}/json")
