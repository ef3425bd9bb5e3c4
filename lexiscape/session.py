"""Session builder and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver did, whatever their working directory."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, env.get("PYTHONPATH"))))
    return spark


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; partitions is the shuffle default."""
    b = (
        SparkSession.builder.master(master)
        .appName("lexiscape")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("LEXISCAPE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return importable(b.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexiscape-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_roots: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes every scratch folder that this driver has made; results that weren't read yet are lost."""
    while _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        _roots.append(self.root)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def table(self, df: DataFrame, path: str | None = None) -> DataFrame:
        path = path or self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
