"""Sources, sinks and page naming."""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiscape.operators.mapserve import dense_id

PAGE_SIZES = (20, 50, 100, 200, 500)


def page_request(key: str, year: int, start: int = 1, size: int = 500) -> dict[str, str]:
    """Parameters of a page of records; sizes, starts and years out of range are refused."""
    if size not in PAGE_SIZES:
        raise ValueError(f"size must be one of {PAGE_SIZES}")
    if not 1 <= start <= 200_000:
        raise ValueError("start must lie in 1 to 200000")
    if year < 2018:
        raise ValueError("records start in 2018")
    return {"appid": key, "format": "xml", "year": str(year), "st": str(start), "rw": str(size)}


def page_path(folder: str, year: int, start: int, size: int) -> str:
    return f"{folder}/{year}/st{start:07d}_rw{size}.xml"


def page_total(page: bytes) -> int:
    """Records that a page's query has; an error page raises."""
    root = ET.fromstring(page)
    total = root.findtext(".//totalResults")
    if total is None:
        raise RuntimeError(f"no total: {root.findtext('.//reason') or root.tag}")
    return int(total)


def missing_pages(folder: str, year: int, total: int, size: int = 500) -> list[tuple[int, str]]:
    """Pages that are not there yet, in any store that Spark reaches; asking again after a stop resumes."""
    spark = SparkSession.getActiveSession()
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm(f"{folder}/{year}")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {f.getPath().getName() for f in store.listStatus(root)} if store.exists(root) else set()  # a name a page
    pages = [(s, page_path(folder, year, s, size)) for s in range(1, total + 1, size)]
    return [(s, p) for s, p in pages if os.path.basename(p) not in there]


def setting(name: str, spark: SparkSession | None = None, env_file: str = ".env") -> str | None:
    """A setting from Spark's configuration, the environment, or a file of NAME=value lines."""
    found = spark.conf.get(f"spark.lexiscape.{name}", None) if spark else None
    if found or os.environ.get(name):
        return found or os.environ[name]
    if os.path.exists(env_file):
        for line in open(env_file):
            if m := re.match(rf"\s*{re.escape(name)}\s*=\s*['\"]?([^'\"\n]*)", line):
                return m[1].strip()
    return None


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding)


def write_ranges(rows: DataFrame, key: str, path: str, parts: int = 4, split: str | None = None) -> None:
    """Contiguous key ranges, zstandard, in folders `part=i` or, for a split, `shard=split-i-of-N`; part i holds rows i * ceil(n / parts) and on."""
    step = -(-rows.count() // parts) or 1
    t = dense_id(rows, key).withColumn("part", F.floor(F.col("uid") / step).cast("int"))
    t = t.repartition(parts, "part").sortWithinPartitions("part", "uid").drop("uid")
    if split:
        t = t.withColumn("shard", F.format_string(f"{split}-%05d-of-{parts:05d}", "part")).drop("part")
    t.write.partitionBy("shard" if split else "part").option("compression", "zstd").mode("overwrite").parquet(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, such as dictionaries."""
    return spark.read.schema(schema).json(path, multiLine=True)


def packed_points(rows: DataFrame, axes: list[str], uid: str = "uid", size: int = 65_536) -> DataFrame:
    """page, n, body: per page of uids the axes as little-endian int16, then uids as uint32, then r, g, b bytes, each column whole."""

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            t = b.to_pydict()
            body = []
            for own in t["own"]:
                own = sorted(own, key=lambda x: x["uid"])
                cols = [np.array([x[a] for x in own], "<i2").tobytes() for a in axes]
                body.append(b"".join([*cols, np.array([x["uid"] for x in own], "<u4").tobytes(), *(np.array([x[c] for x in own], "u1").tobytes() for c in "rgb")]))
            yield pa.record_batch([pa.array(t["page"], pa.int64()), pa.array([len(x) for x in t["own"]], pa.int64()), pa.array(body, pa.binary())], names=["page", "n", "body"])

    own = F.collect_list(F.struct(F.col(uid).cast("long").alias("uid"), *(F.col(c).cast("int").alias(c) for c in (*axes, "r", "g", "b")))).alias("own")
    return rows.groupBy(F.floor(F.col(uid) / size).cast("long").alias("page")).agg(own).mapInArrow(each, "page long, n long, body binary")


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """A stage's table, made only if it isn't there yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
