"""Grant records in XML to rows, as column expressions over the XML reader's structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The part of the record schema that is read. An element with attributes is a struct with _VALUE.
RECORD = """
_id string, _projectType string, _awardNumber string,
parentAward struct<_id:string, title:array<struct<_VALUE:string, `_xml:lang`:string>>>,
summary array<struct<
  `_xml:lang`:string, title:string,
  awardNumber:array<struct<_awardNumber:string,_sequence:string,_participate:string,_VALUE:string>>,
  category:struct<_VALUE:string,_path:string,_niiCode:string>,
  review_section:array<struct<_VALUE:string,_sequence:string,_niiCode:string,_tableType:string>>,
  institution:array<struct<_VALUE:string,_niiCode:string>>,
  member:array<struct<_sequence:string,_eradCode:string,_role:string>>,
  projectStatus:struct<_fiscalYear:string,_statusCode:string>,
  keywordList:struct<keyword:array<string>>,
  paragraphList:array<struct<_type:string,_sequence:string,paragraph:array<struct<_VALUE:string,_sequence:string>>>>,
  periodOfAward:struct<_searchStartFiscalYear:string,_searchEndFiscalYear:string>>>
"""


def read(spark: SparkSession, path: str, limit_files: int | None = None) -> DataFrame:
    """All records under a folder, or those of its first files by name; source_file is each one's file."""
    paths = path
    if limit_files is not None:
        names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")  # names only: contents are pruned
        paths = [r["path"] for r in names.orderBy("path").limit(limit_files).collect()]
        if not paths:
            return awards(spark.createDataFrame([], " ".join(RECORD.split())))
    raw = spark.read.format("xml").option("rowTag", "grantAward").option("recursiveFileLookup", "true").schema(RECORD).load(paths)
    return awards(raw.withColumn("source_file", F.col("_metadata.file_path")))


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _text(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _paragraphs(summary: Column, kind: str) -> Column:
    own = _first(F.filter(summary["paragraphList"], lambda p: p["_type"] == kind))["paragraph"]
    return _text(F.array_join(F.transform(own, lambda x: F.trim(x["_VALUE"])), "\n"))


def _titled(titles: Column, lang: str, value: str) -> Column:
    return _first(F.filter(titles, lambda t: (t["_xml:lang"] == lang) & _text(t[value]).isNotNull()))[value]


def awards(raw: DataFrame) -> DataFrame:
    """The 23 columns of a record. A record without a summary is dropped."""
    s = F.col("s")
    rows = raw.withColumn("s", F.coalesce(_first(F.filter("summary", lambda x: x["_xml:lang"] == "ja")), _first(F.col("summary")))).where(s.isNotNull())
    if "source_file" not in raw.columns:
        rows = rows.withColumn("source_file", F.lit(None).cast("string"))
    number = lambda x: F.nullif(x, F.lit("")).cast("int")
    old = F.filter(s["awardNumber"], lambda a: ~a["_sequence"].eqNullSafe("1") & (F.coalesce(a["_awardNumber"], F.lit("")) != ""))
    raw_start = number(s["periodOfAward"]["_searchStartFiscalYear"])
    joined = F.transform(old, lambda a: F.nullif(F.regexp_extract(a["_participate"], r"\d{4}", 0), F.lit("")).cast("int"))
    none = F.array().cast("array<string>")
    sections = F.coalesce(F.filter(F.transform(s["review_section"], lambda x: F.trim(x["_VALUE"])), lambda x: x != ""), none)
    codes = F.filter(F.transform(sections, lambda x: F.regexp_extract(x, r"^小区分(\d{5}):", 1)), lambda x: x != "")
    category = s["category"]
    return rows.select(
        F.col("_awardNumber").alias("award_number"), F.col("_id").alias("kaken_id"),  # fixed value: the record format's name
        F.col("_projectType").alias("project_type"),
        F.coalesce(_text(s["title"]), _first(F.filter(F.transform("summary", lambda x: _text(x["title"])), lambda x: x.isNotNull()))).alias("title"),
        F.trim(category["_VALUE"]).alias("category"), category["_niiCode"].alias("category_code"), sections.alias("review_sections"), codes.alias("shokubun_codes"),
        _text(_first(s["institution"])["_VALUE"]).alias("institution"), _first(F.filter(s["member"], lambda m: m["_role"] == "principal_investigator"))["_eradCode"].alias("pi_erad"),
        F.coalesce(F.size(s["member"]), F.lit(0)).cast("int").alias("n_members"), s["projectStatus"]["_statusCode"].alias("status_code"),
        F.array_min(F.concat(F.array(raw_start), F.coalesce(joined, F.array().cast("array<int>")))).alias("start_fy"), number(s["periodOfAward"]["_searchEndFiscalYear"]).alias("end_fy"), raw_start.alias("period_start_fy_raw"),
        F.coalesce(F.transform(old, lambda a: a["_awardNumber"]), none).alias("old_award_numbers"),
        F.nullif(F.substring_index("parentAward._id", "-", -1), F.lit("")).alias("parent_award"),
        F.coalesce(_titled(F.col("parentAward.title"), "ja", "_VALUE"), _first(F.filter("parentAward.title", lambda t: _text(t["_VALUE"]).isNotNull()))["_VALUE"]).alias("parent_title"),
        _text(_first(F.filter("summary", lambda x: x["_xml:lang"] == "en"))["title"]).alias("title_en"),
        F.coalesce(F.filter(F.transform(s["keywordList"]["keyword"], lambda x: F.trim(x)), lambda x: x != ""), none).alias("keywords"),
        _paragraphs(s, "outline_of_research_initial").alias("abstract_initial"), _paragraphs(s, "outline_of_research_achievement").alias("abstract_achievement"), F.col("source_file"),
    )


def by_status(rows: DataFrame) -> DataFrame:
    """status_code, n: the most common first."""
    return rows.groupBy("status_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status_code")


def summary(rows: DataFrame) -> DataFrame:
    """Counts of the parsed table."""
    return rows.agg(F.count("*").alias("n"), F.count("abstract_initial").alias("with_abstract"), F.count_if(F.size("shokubun_codes") > 0).alias("with_codes"), F.count_if(F.col("start_fy") < F.col("period_start_fy_raw")).alias("corrected"), F.count("parent_award").alias("with_parent"), F.count("title_en").alias("with_english"))
