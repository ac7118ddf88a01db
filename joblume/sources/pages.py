"""Landed page snapshots: ``pages(page_id, url, html)``."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.operators.skew import BROADCAST_BYTES, measured, spread_join

FILTER_BITS = 1 << 26


def has_content(pages: DataFrame) -> DataFrame:
    """Pages with something in them; white space is something."""
    return pages.where(F.col("html").isNotNull() & (F.col("html") != ""))


class PageStore:
    """Landed snapshots, bucketed by (url, page_id): a join by both shuffles its other side alone.

    The store is files below ``path`` and is added to as snapshots land; a table
    of the session names them.  ``buckets`` is fixed when the store is made: its
    pages by what one task may read, since a bucket is read by one.
    """

    def __init__(self, path: str, buckets: int = 256):
        self.path, self.buckets = path.rstrip("/"), buckets
        self.name = f"pages_{md5(self.path.encode()).hexdigest()}"

    def _named(self, spark: SparkSession) -> str:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (page_id BIGINT, url STRING, html STRING) USING parquet "
                  f"CLUSTERED BY (url, page_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        return self.name

    def add(self, pages: DataFrame) -> None:
        name = self._named(pages.sparkSession)
        # a task per bucket, so that an addition has a file per bucket
        pages.select("page_id", "url", "html").repartition(self.buckets, "url", "page_id").write.insertInto(name)
        pages.sparkSession.catalog.refreshTable(name)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self._named(spark))


def fetch(pages: DataFrame | PageStore, wanted: DataFrame, reduce: Callable[[DataFrame], DataFrame] | None = None,
          broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """The latest snapshot of each wanted URL, with what else ``wanted`` has.

    ``wanted`` has each ``url`` once.  Which snapshot to take is settled on
    (url, page_id) alone, so that this pass does not read ``html``.  Then a
    list of wanted pages that is short, as measured, is broadcast and filters
    the scan; a long one is joined by both columns, which also spreads the
    copies of a page.  Before that join a bit filter, which is broadcast and of
    bounded size, takes unwanted pages out of the scan, so that their ``html``
    is not shuffled; what it lets through by chance the join takes out.

    ``reduce`` makes narrow rows of pages, row by row, keeping ``url`` and
    ``page_id``.  It is done on wanted pages only, unless most are wanted and
    they would have to be shuffled: then all are reduced first, and the shuffle
    is as narrow.

    Out of a ``PageStore`` ``html`` is never shuffled, however long the list:
    what is wanted is dealt out to its buckets, and pages stream by.
    """
    reduce = reduce or (lambda rows: rows)
    bucketed = isinstance(pages, PageStore)
    if bucketed:
        pages = pages.read(wanted.sparkSession)
    latest = (pages.select("url", "page_id").join(wanted.select("url"), "url", "left_semi")
              .groupBy("url").agg(F.max("page_id").alias("page_id")))
    if len(wanted.columns) > 1:
        latest = latest.join(wanted, "url")
    latest, size = measured(latest)
    place = ["url", "page_id"]
    # of a store's bucket what is wanted is made into a hash table, and its pages are not sorted
    strategy = "broadcast" if size <= broadcast_limit else "shuffle_hash" if bucketed else "merge"
    hinted = latest.hint(strategy)
    if strategy == "merge":
        n = latest.count()
        if n * 2 > pages.agg(F.approx_count_distinct("url")).first()[0]:
            return reduce(pages).join(hinted, place)
        pages = probably_in(pages, latest, place, n)
    chosen = reduce(pages.join(latest.select(*place).hint(strategy), place, "left_semi"))
    return chosen.join(hinted, place) if len(latest.columns) > 2 else chosen


def probably_in(rows: DataFrame, wanted: DataFrame, key: list[str], n: int) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among the ``n`` of ``wanted``.

    Eight bits a key, but no more than FILTER_BITS, in words of 32 that are
    broadcast: at most 2,097,152 rows of two numbers.
    """
    bits = min(FILTER_BITS, max(32, 8 * n))
    at = F.pmod(F.xxhash64(*key), F.lit(bits))
    words = (wanted.select(at.alias("_at")).groupBy(F.expr("_at div 32").alias("_word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_at % 32 AS INT))")).alias("_bits")))
    return (rows.withColumn("_at", at).withColumn("_word", F.expr("_at div 32"))
            .join(F.broadcast(words), "_word")
            .where("(shiftright(_bits, CAST(_at % 32 AS INT)) & 1) = 1").select(*rows.columns))


def lookup(urls: DataFrame, pages: DataFrame | PageStore,
           reduce: Callable[[DataFrame], DataFrame] | None = None, broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Every line of the list with its page, or what ``reduce`` makes of it; a URL without one has NULLs.

    A URL may fill a third of the list, so the join spreads hot ones.
    """
    found = fetch(pages, urls.select("url").distinct(), reduce, broadcast_limit)
    return spread_join(urls, found, "url", "left", ["line_no"])


def missing(urls: DataFrame, found: DataFrame) -> DataFrame:
    """Lines whose URL is not among those ``found``: the dead letters of the run."""
    return spread_join(urls, found.select("url").distinct(), "url", "left_anti", ["line_no"])
