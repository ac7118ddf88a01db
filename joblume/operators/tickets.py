"""Tickets: suppression of records whose search text lies inside a known title.

"Is this text contained in any title" is no equi-join, and comparing each
record with each title, or with all that share some letters, is quadratic.  But
every search text has the form ``left @ right``, and it lies in a title exactly
if, at some `` @ `` of the title, ``left`` ends what stands before and ``right``
begins what stands behind.  So:

1. records tell which lefts exist and how long the rights behind each are;
2. what stands before an anchor is matched with those lefts by the equality of
   a suffix;
3. each title writes down, for its matched lefts, the texts it contains, cut at
   lengths that exist.

What a title writes down is bounded by its own length, whatever the data, and
all that remains is an equality with the search text.  The answer is exact.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.functions.text import strip
from joblume.operators.records import ARRIVAL
from joblume.operators.skew import BROADCAST_BYTES, measured, spread_join
from joblume.session import checkpoint_root
from joblume.sinks.base import stored

# Fixed value: what stands between title and company.
ANCHOR = " @ "


def known_title(title: Column) -> Column:
    return strip(F.lower(title))


def ticket_title() -> Column:
    return F.concat(F.lit("["), "origem", F.lit("] "), "titulo", F.lit(ANCHOR), "empresa")


def search_text() -> Column:
    return strip(F.lower(F.concat("titulo", F.lit(ANCHOR), "empresa")))


def ticket_body() -> Column:
    return F.concat(F.lit("Empresa: "), "empresa", F.lit("\nLocal: "), "localizacao",
                    F.lit("\nLink: "), "link_inscricao")


def with_ticket_fields(items: DataFrame) -> DataFrame:
    return items.withColumns({"title": ticket_title(), "search": search_text(), "body": ticket_body()})


def contained(titles: DataFrame, searches: DataFrame, payload: list[str],
              broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Which ``search`` lies in which ``text``: rows (search, start, *payload), exact.

    ``titles`` has ``text`` and the payload; ``start`` is the place of the match.
    If the lefts of the searches are few, as measured, titles are not shuffled.
    """
    size = len(ANCHOR)
    # 1. lefts of the searches; a length set is bounded by the longest text
    left = F.substring_index("search", ANCHOR, 1)
    needles = (searches.where(F.col("search").contains(ANCHOR))
               .select(left.alias("needle"), (F.length("search") - F.length(left) - size).alias("_length"))
               .groupBy("needle").agg(F.collect_set("_length").alias("_lengths")))
    anchored = _anchored(titles, payload)
    needles, size_of_needles = measured(needles)
    if size_of_needles <= broadcast_limit:
        matched = (_suffixes(anchored, "before", "after", *payload, suffix="needle")
                   .join(F.broadcast(needles), "needle"))
    else:
        matched = _match_shuffled(anchored, needles, payload)
    # 3. the contained texts
    lengths = F.filter("_lengths", lambda n: n <= F.length("after"))
    return (matched.select(*payload, "needle", "after",
                           (F.length("before") - F.length("needle")).alias("start"),
                           F.explode(lengths).alias("_n"))
            .select(F.concat("needle", F.lit(ANCHOR), F.left("after", F.col("_n"))).alias("search"),
                    "start", *payload))


def _anchored(titles: DataFrame, payload: list[str]) -> DataFrame:
    """Both sides of every anchor of every title; there may be several, and they may overlap."""
    size = len(ANCHOR)
    first = F.instr("text", F.lit(ANCHOR))
    places = (F.when(F.locate(ANCHOR, F.substring(F.col("text"), first + 1, F.length("text"))) == 0, F.array(first))
              .otherwise(F.filter(F.sequence(F.lit(1), F.length("text")),
                                  lambda at: F.substring(F.col("text"), at, F.lit(size)) == ANCHOR)))
    return (titles.where(F.col("text").contains(ANCHOR))
            .select("text", *payload, F.explode(places).alias("_at"))
            .select(*payload,
                    F.left("text", F.col("_at") - 1).alias("before"),
                    F.substring(F.col("text"), F.col("_at") + size, F.length("text")).alias("after")))


def _suffixes(anchored: DataFrame, *columns: str, suffix: str) -> DataFrame:
    return (anchored.where(F.length("before") > 0)
            .select(*columns, F.explode(F.sequence(F.lit(1), F.length("before"))).alias("_n"))
            .withColumn(suffix, F.right("before", F.col("_n"))).drop("_n"))


def _match_shuffled(anchored: DataFrame, needles: DataFrame, payload: list[str]) -> DataFrame:
    """Step 2 for many lefts: by the distinct texts before an anchor.

    Short suffixes are hot, and so are common texts.  There are many suffixes,
    so two hashes stand for each until the texts are compared at the end.
    """
    suffixes = (_suffixes(anchored.select("before").distinct(), "before", suffix="_suffix")
                .select(F.xxhash64("before").alias("_before"), F.xxhash64("_suffix").alias("_needle")))
    hashed = needles.withColumn("_needle", F.xxhash64("needle"))
    pairs = (spread_join(suffixes, hashed, "_needle", "inner", ["_before"])
             .select("_before", "needle", "_lengths"))
    return (spread_join(anchored.withColumn("_before", F.xxhash64("before")), pairs, "_before", "inner",
                        ["after", *payload])
            .where(F.endswith("before", "needle")))


class TitleIndex:
    """Known titles, kept so that looking texts up shuffles the texts alone.

    A title has a row per anchor, per power of two that its part before the
    anchor is long and per power of two that the part behind is: the key is of
    the last, and the first, so many characters.  A search text has one such
    key, of the largest powers within its own parts, and lies in a title exactly
    if a row of that key ends and goes on with it.  The table is bucketed by key
    and slot; the slots split what very many titles have in common.

    It is made of files below ``path`` (a table of the session names them) and
    only added to.  ``batch_id`` tells the titles of a stream's batch, which a
    replay of that batch does not count as known.
    """

    BUCKETS = 64
    SLOTS = 8
    COLUMNS = "key BIGINT, slot INT, before STRING, after STRING, batch_id BIGINT"

    def __init__(self, path: str, buckets: int = BUCKETS, hidden: int | None = None):
        self.path, self.buckets, self.hidden = path.rstrip("/"), buckets, hidden
        self.name = f"titles_{md5(self.path.encode()).hexdigest()}"

    def without(self, batch_id: int | None) -> TitleIndex:
        return TitleIndex(self.path, self.buckets, batch_id)

    def table(self, spark: SparkSession) -> DataFrame:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
                  f"CLUSTERED BY (key, slot) INTO {self.buckets} BUCKETS LOCATION '{self.path}/titles'")
        rows = spark.table(self.name)
        return rows if self.hidden is None else rows.where(F.coalesce(F.col("batch_id") != self.hidden, F.lit(True)))

    def exists(self, spark: SparkSession) -> bool:
        return stored(spark, f"{self.path}/sizes") is not None

    def size(self, spark: SparkSession) -> int:
        """How many titles were added: from notes, a row per addition."""
        sizes = stored(spark, f"{self.path}/sizes")
        if sizes is None:
            return 0
        return sizes.where(F.coalesce(F.col("batch_id") != F.lit(self.hidden), F.lit(True))) \
            .agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def add(self, titles: DataFrame, batch_id: int | None = None) -> None:
        spark, titles = titles.sparkSession, titles.where(F.col("title").isNotNull())
        texts = titles.select(known_title(F.col("title")).alias("text"))

        def powers(side):
            return F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.length(side))).cast("int")),
                               lambda p: F.pow(F.lit(2), p).cast("int"))

        rows = (_anchored(texts, []).where((F.length("before") > 0) & (F.length("after") > 0))
                .select("*", F.explode(powers("before")).alias("k")).select("*", F.explode(powers("after")).alias("m"))
                .select(_anchor_key(F.right("before", F.col("k")), F.left("after", F.col("m"))).alias("key"),
                        F.pmod(F.xxhash64("before", "after"), F.lit(self.SLOTS)).cast("int").alias("slot"),
                        "before", "after", F.lit(batch_id).cast("long").alias("batch_id")))
        self.table(spark)
        # a task per bucket, so that an addition has a file per bucket
        rows.repartition(self.buckets, "key", "slot").write.insertInto(self.name)
        # counted by itself: where no title has an anchor, or there is none, Spark leaves the titles out of the plan above
        note = spark.createDataFrame([(titles.count(), batch_id)], "n long, batch_id long")
        note.coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")
        spark.catalog.refreshTable(self.name)

    def containing(self, searches: DataFrame) -> DataFrame:
        """Those ``search`` texts that lie in a known title, each once."""
        left = F.substring_index("search", ANCHOR, 1)
        right = F.substring(F.col("search"), F.length(left) + len(ANCHOR) + 1, F.length("search"))

        def power(side):
            return F.pow(F.lit(2), F.floor(F.log2(F.length(side)))).cast("int")

        parts = (searches.where(F.col("search").contains(ANCHOR)).select("search").distinct()
                 .select("search", left.alias("_left"), right.alias("_right"))
                 .where((F.length("_left") > 0) & (F.length("_right") > 0))
                 .select("*", _anchor_key(F.right("_left", power("_left")), F.left("_right", power("_right"))).alias("key"),
                         F.explode(F.sequence(F.lit(0), F.lit(self.SLOTS - 1))).alias("slot")))
        # the texts are made into hash tables, bucket by bucket, and titles stream by
        return (self.table(searches.sparkSession).join(parts.hint("shuffle_hash"), ["key", "slot"])
                .where(F.endswith("before", "_left") & F.startswith("after", "_right")).select("search").distinct())


def _anchor_key(suffix: Column, prefix: Column) -> Column:
    return F.xxhash64(F.length(suffix), suffix, F.length(prefix), prefix)


def drop_known(items: DataFrame, known: DataFrame | TitleIndex, broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Leaves out records whose search text lies in a title of the history.

    Records have both fields, as after ``records.finalize``.  The history is a
    table of titles, which is shuffled if the records' texts are too many to be
    broadcast, or an index, which never is.
    """
    items = items.withColumn("search", search_text())
    if isinstance(known, TitleIndex):
        inside = known.containing(items.select("search"))
    else:
        titles = known.select(known_title(F.col("title")).alias("text"))
        inside = contained(titles, items.select("search"), [], broadcast_limit).select("search").distinct()
    return items.join(inside.hint("merge"), "search", "left_anti").drop("search")


def drop_repeats(items: DataFrame, order: list[str] | None = None,
                 broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Leaves out records whose search text lies in the title of an earlier accepted one.

    A text inside the search text of *any* earlier record is out: if that record
    is itself out, what it lies in holds this text too.  Only a match that
    begins in the ``[origin] `` of a title depends on whether that title was
    accepted; such records are settled in rounds, earliest first.
    """
    order = order or ARRIVAL
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    checkpoint_root(items.sparkSession)
    # read four times below
    items = items.withColumns({"search": search_text(), "_place": place}).checkpoint()
    bodies = items.select(F.col("search").alias("text"), "_place")
    earliest = (contained(bodies, items.select("search"), ["_place"], broadcast_limit)
                .groupBy("search").agg(F.min("_place").alias("_first")))
    # each search text lies in itself, so the first is at the latest its own place
    still = (items.join(earliest.hint("merge"), "search", "left")
             .where(F.col("_first").isNull() | (F.col("_first") >= F.col("_place"))).drop("_first"))

    brackets = F.col("search").contains("]")
    odd_origin = F.lower("origem").contains(ANCHOR)
    if items.where(brackets | odd_origin).isEmpty():
        return still.drop("search", "_place")

    still = still.checkpoint()
    prefix = F.length(F.concat(F.lit("["), F.lower("origem"), F.lit("]")))
    titles = still.select(known_title(ticket_title()).alias("text"), F.col("_place").alias("_by"),
                          prefix.alias("_prefix"), odd_origin.alias("_odd"))
    payload = ["_by", "_prefix"]
    inside = (contained(titles, still.where(brackets).select("search"), payload, broadcast_limit)
              .union(contained(titles.where("_odd"), still.select("search"), payload, broadcast_limit))
              .where(F.col("start") < F.col("_prefix")).select("search", "_by").distinct())
    edges = (still.select("search", "_place").join(inside.hint("merge"), "search")
             .where(F.col("_by") < F.col("_place")).select("_place", "_by"))
    dropped = _settle(edges)
    return still.join(dropped, "_place", "left_anti").drop("search", "_place")


def _settle(edges: DataFrame) -> DataFrame:
    """Places that are out, given who (`_place`) is out if whom (`_by`) is in.

    An edge from a record without edges of its own is final.  Each round settles
    at least the earliest open record; a chain is as long as brackets nest.
    """
    edges = edges.checkpoint()
    dropped = edges.select("_place").limit(0)
    while not edges.isEmpty():
        open_places = edges.select(F.col("_place").alias("_by")).distinct()
        out = edges.join(open_places, "_by", "left_anti").select("_place").distinct()
        edges = (edges.join(out, "_place", "left_anti")
                 .join(out.select(F.col("_place").alias("_by")), "_by", "left_anti").checkpoint())
        dropped = dropped.union(out).checkpoint()
    return dropped
