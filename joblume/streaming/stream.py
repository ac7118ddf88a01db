"""The same rules on arriving data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.functions.recency import MAX_AGE_HOURS, is_recent, iso_moment, now_column
from joblume.session import apply_rules, scratch_path
from joblume.sinks.base import PLACED, Sink, fan_out, store
from joblume.streaming.state import first_by_order

PAGES_SCHEMA = "page_id long, url string, html string"


def read_stream(spark: SparkSession, folder: str, schema: str, files: str = "*.parquet",
                files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they land in a folder."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", files)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def dedupe_stream(items: DataFrame, key: str = "item_key", event_time: str | None = None,
                  delay: str = f"{MAX_AGE_HOURS} hours") -> DataFrame:
    """Each key passes once.

    Without ``event_time`` it is once and for all, and the state keeps every
    key (on disk, with the RocksDB state store); with it, once within the delay,
    and the state stays bounded.
    """
    if event_time is None:
        return items.dropDuplicates([key])
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def recent_stream(cards: DataFrame, key: str, now: datetime | str | Column, **recency) -> DataFrame:
    """Fresh cards, each key once.

    The filter against ``now`` decides; the watermark only bounds the state.  It
    follows the latest time seen, so times after ``now`` are held back to it:
    what then is an hour beyond the 36, as Spark drops what equals the
    watermark, is stale.
    """
    moment, at = iso_moment(F.col("datetime_attr"), recency.get("convert_offset", False)), now_column(now)
    has_time = F.col("datetime_attr").isNotNull() | F.col("time_text").isNotNull()
    fresh = cards.where(is_recent(has_time, F.col("datetime_attr"), F.col("time_text"), now, **recency))
    seen = F.least(F.coalesce(moment, at), at).cast("string")
    timed = fresh.withColumn("_seen", F.concat(seen, F.lit("+00:00")).cast("timestamp"))
    return dedupe_stream(timed, key, "_seen", f"{MAX_AGE_HOURS + 1} hours").drop("_seen")


def start_fan_out(items: DataFrame, sinks: Sequence[Sink], niche: str, checkpoint: str,
                  order: list[str] | None = None, work_dir: str | None = None,
                  finish: Callable[[DataFrame], DataFrame] | None = None, trigger: dict | None = None,
                  ttl_hours: float | None = None):
    """Each micro-batch to all sinks; a batch that is replayed replaces its own output.

    With ``order`` give all records, repeats included: of equal keys the first
    in that order passes, by state (``first_by_order``), and nothing that was
    stored is read again.  A record that turns out to be earlier than one that
    passed in an earlier batch is stored as well; what passed is noted in
    ``places_of(checkpoint)``, and ``current`` reads a store without what was
    replaced.  ``finish`` makes the final records.  A sink that failed is told
    at the end of the batch, after the others wrote, so that the batch is tried
    again.

    ``trigger`` is as for ``writeStream.trigger``; without it the stream ends
    with what there is.
    """
    folder, places = work_dir or scratch_path(items.sparkSession, "stream"), places_of(checkpoint)
    if order:
        apply_rules(items.sparkSession)
        items = first_by_order(items, "item_key", order, ttl_hours) \
            .withColumn("item_place", F.struct(*order)).drop("replaces")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{folder}/batch"
        batch.write.mode("overwrite").parquet(path)
        landed = spark.read.parquet(path)
        if order:
            store(landed.select(*PLACED), places, batch_id)
        status = fan_out(finish(landed) if finish else landed, sinks, niche, batch_id)
        failed = status.where(F.col("error").isNotNull()).collect()   # one row per sink
        if failed:
            raise RuntimeError("; ".join(f"{row.sink}: {row.error}" for row in failed))

    return (items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def places_of(checkpoint: str) -> str:
    """Where a stream notes the places of what passed: beside its checkpoint."""
    return f"{checkpoint.rstrip('/')}-places"


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").option("path", f"{out}/data")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
