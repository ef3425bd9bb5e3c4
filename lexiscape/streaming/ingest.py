"""Incremental ingest of record pages and upserts by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from lexiscape.operators import parse


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """New XML pages of a folder, each read once under a checkpoint."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(folder)
    schema = StructType([StructField("grantAward", ArrayType(StructType.fromDDL(parse.RECORD)))])
    each = raw.select(F.explode(F.from_xml("value", schema)["grantAward"]).alias("r"), F.col("_metadata.file_path").alias("source_file"))
    return parse.awards(each.select("r.*", "source_file"))


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return current.unionByName(batch).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "award_number"):
    """Starts a query that appends rows with keys that the table lacks."""

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as e:  # the table's first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        new = batch.dropDuplicates([key])
        (new if known is None else new.join(known, key, "left_anti")).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window and kind; works on streams and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), kind, "n", "v")
