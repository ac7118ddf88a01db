"""The outbox of tickets to open; what reads it talks to the ticket service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from joblume.operators.tickets import BROADCAST_BYTES, TitleIndex, drop_known, drop_repeats, with_ticket_fields
from joblume.session import checkpoint_root
from joblume.sinks.base import store, stored


def new_tickets(items: DataFrame, known: DataFrame | TitleIndex | None, order: list[str] | None = None,
                broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """(title, body) of the records no known or earlier title contains."""
    if known is not None:
        items = drop_known(items, known, broadcast_limit)
    return with_ticket_fields(drop_repeats(items, order)).select("title", "body")


class TicketOutbox:
    """Takes adverts only.  What lies in the outbox already counts as known, as do ``known`` titles.

    With ``index``, a folder, the titles are kept in an index that each write
    adds its own to, so that the history is neither shuffled nor read whole;
    ``known`` titles go in with the first write.  ``seen`` tells of the last
    write how many titles were known and how many records were suppressed.
    """

    def __init__(self, path: str, known: DataFrame | None = None, order: list[str] | None = None,
                 index: str | None = None, buckets: int = TitleIndex.BUCKETS):
        self.path, self.known, self.order = path, known, order
        self.index = TitleIndex(index, buckets) if index else None
        self.seen: dict[str, int] = {}

    def titles(self, spark: SparkSession, batch_id: int | None) -> DataFrame | None:
        sent = stored(spark, self.path)
        if sent is None:
            return self.known
        if batch_id is not None and "batch_id" in sent.columns:
            sent = sent.where(sent.batch_id != batch_id)
        sent = sent.select("title")
        return sent if self.known is None else self.known.select("title").unionByName(sent)

    def write(self, items: DataFrame, niche: str, batch_id: int | None = None) -> None:
        if niche != "jobs":
            return
        spark = items.sparkSession
        given, left = Observation("given"), Observation("left")
        count = F.count(F.lit(1)).alias("n")
        if self.index is not None:
            if self.known is not None and not self.index.exists(spark):
                self.index.add(self.known.select("title"))
            history = self.index.without(batch_id)
            n_known = history.size(spark)
        else:
            history = self.titles(spark, batch_id)
            # without records the history is left out of the plan, and an observation of it would see nothing
            n_known = 0 if history is None else history.count()
        checkpoint_root(spark)
        items = items.observe(given, count).checkpoint()
        tickets = new_tickets(items, history, self.order).observe(left, count)
        store(tickets, self.path, batch_id)
        if self.index is not None:
            part = self.path if batch_id is None else f"{self.path.rstrip('/')}/batch_id={batch_id}"
            sent = stored(spark, part)
            if sent is not None:
                self.index.add(sent.select("title"), batch_id)
        self.seen = {"n_known": n_known, "n_suppressed": given.get.get("n", 0) - left.get.get("n", 0)}
