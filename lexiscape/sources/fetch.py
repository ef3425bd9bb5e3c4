"""Record pages over HTTP as a Python data source: one partition a page."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiscape.sources.files import page_request, page_total

TRIES, WAIT = 3, 2.0


def fetched(url: str, opened: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """A page's bytes; of TRIES tries, each but the last waits twice as long as the one before (from WAIT seconds)."""
    opened = opened or (lambda u: urllib.request.urlopen(u, timeout=60).read())
    for i in range(TRIES):
        try:
            return opened(url)
        except OSError:
            if i == TRIES - 1:
                raise
            sleep(WAIT * 2**i)
    raise AssertionError


class PageSource(DataSource):
    """Options: base (address), key, year, total (records) or starts (first records of the pages, by commas), size, max_pages, delay (seconds). Rows: year, start, body."""

    @classmethod
    def name(cls) -> str:
        return "record_pages"

    def schema(self) -> str:
        return "year int, start int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(dict(self.options))


class Page(InputPartition):
    def __init__(self, start: int):
        self.start = start


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.size = int(options.get("size", 500))

    def partitions(self) -> list[Page]:
        if "starts" in self.options:
            return [Page(int(s)) for s in self.options["starts"].split(",")]
        total = int(self.options["total"])
        if total <= 0:
            raise ValueError("a year without records")
        starts = list(range(1, total + 1, self.size))
        return [Page(s) for s in starts[: int(self.options.get("max_pages", len(starts)))]]

    def read(self, partition: Page) -> Iterator[tuple]:
        year = int(self.options["year"])
        query = urllib.parse.urlencode(page_request(self.options.get("key", ""), year, partition.start, self.size))
        yield year, partition.start, fetched(f"{self.options['base']}?{query}").decode()
        time.sleep(float(self.options.get("delay", 0)))


#: Records that can be asked for: later ones have no page.
LAST = 200_000


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """year, start, body of the pages that are there."""
    return _files(spark, folder).select("year", "start", "body")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the time and name of each row's file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "year int, start int, body string, written timestamp, file string")
    t = spark.read.schema("start int, body string, year int").parquet(folder)
    return t.select("year", "start", "body", F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"))


def land_year(spark: SparkSession, base: str, folder: str, year: int, key: str = "", size: int = 500, max_pages: int | None = None, delay: float = 0.0, force: bool = False, batch: int = 64) -> int:
    """Fetches a year's pages that `folder` doesn't have yet, and returns how many records the year has.

    The first page says how many there are; none at all is an error. Pages are fetched in the tasks, `batch` of them a job, and each job's
    pages are committed to the folder (Parquet by year) before the next job begins, so that a run that is stopped or fails goes on with
    what is missing. `force` fetches all again; the newest copy of a page is the one that `pages` gives.
    """
    spark.dataSource.register(PageSource)

    def fetch(starts: list[int]) -> None:
        rows = spark.read.format("record_pages").options(base=base, key=key, year=str(year), size=str(size), delay=str(delay), starts=",".join(map(str, starts))).load()
        rows.write.mode("append").partitionBy("year").parquet(folder)

    def there() -> set[int]:
        return {r["start"] for r in landed(spark, folder).where(F.col("year") == year).select("start").distinct().collect()}  # a row a page

    if force or 1 not in there():
        fetch([1])
    total = page_total(pages(spark, folder).where((F.col("year") == year) & (F.col("start") == 1)).first()["body"].encode())
    if total <= 0:
        raise RuntimeError(f"{year} has no records: is the request right?")
    every = list(range(1, min(total, LAST) + 1, size))[:max_pages]
    have = {1} if force else there()
    left = [s for s in every if s not in have]
    for i in range(0, len(left), batch):
        fetch(left[i : i + batch])
    return total


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """year, start, body: of pages that were fetched again, the newest file's."""
    return _files(spark, folder).groupBy("year", "start").agg(F.max_by("body", F.struct("written", "file")).alias("body"))
