"""From listing pages to the advert links to follow, and to their batches.

Two shapes of the same rules.  In the run a page's cards are one array in its
row, bounded by the page, so links are picked inside the row and nothing is
shuffled.  Where cards lie flat in a table, one row each, a listing can be of
any size, and the rules become aggregates and chunked numbering.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblume.functions.recency import is_recent
from joblume.operators.skew import first_per_key, number_within

# Fixed value: links per extraction request.
BATCH_SIZE = 5


def is_absolute(href: Column) -> Column:
    """Non-empty and with ``http`` anywhere in it."""
    return F.coalesce(href.contains("http"), F.lit(False))


# -- cards as an array per page

def card_links(cards: Column, now: datetime | str | Column, **recency) -> Column:
    """Links of the fresh cards, each at its first fresh place."""
    def keep(card):
        return is_absolute(card["href"]) & is_recent(
            card["has_time"], card["datetime_attr"], card["time_text"], now, **recency)
    return F.array_distinct(F.transform(F.filter(cards, keep), lambda card: card["href"]))


def with_links(pages: DataFrame, cards: Column, anchors: Column, now: datetime | str | Column,
               recency_on_fallback: bool = False, **recency) -> DataFrame:
    """Adds ``links``: from a page's cards or, if none survives, from all its anchors.

    The anchors are not tested for freshness, so a page of stale cards hands its
    links in again; ``recency_on_fallback`` keeps out those of stale cards.
    """
    others = F.array_distinct(F.filter(anchors, is_absolute))
    if recency_on_fallback:
        others = F.array_except(others, F.transform(cards, lambda card: card["href"]))
    fresh = F.col("_fresh")
    return (pages.withColumn("_fresh", card_links(cards, now, **recency))
            .withColumn("links", F.when(F.size(fresh) > 0, fresh).otherwise(others)).drop("_fresh"))


def follows_links(n_links: Column) -> Column:
    """A page with several links is a listing; with one or none it is itself the advert."""
    return n_links > 1


def explode_links(pages: DataFrame, keys: list[str], batch_size: int = BATCH_SIZE) -> DataFrame:
    """One row per link with its place and batch; the place in the array is the number."""
    return (pages.select(*keys, F.posexplode("links").alias("pos", "href"))
            .withColumn("batch_no", F.expr(f"pos div {batch_size}")))


# -- cards as rows

def fresh_cards(cards: DataFrame, now: datetime | str | Column, **recency) -> DataFrame:
    """Rows with an absolute link that are fresh; a row without both time fields has no tag."""
    has_time = (F.col("has_time") if "has_time" in cards.columns
                else F.col("datetime_attr").isNotNull() | F.col("time_text").isNotNull())
    return cards.where(is_absolute(F.col("href"))
                       & is_recent(has_time, F.col("datetime_attr"), F.col("time_text"), now, **recency))


def distinct_links(cards: DataFrame, listing: str = "listing_id") -> DataFrame:
    """Each link of a listing once, at its first place (give fresh cards only)."""
    return first_per_key(cards, [listing, "href"], ["pos"])


def assign_batches(links: DataFrame, listing: str = "listing_id",
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """Cut each listing's links, in order, into batches of ``batch_size``."""
    numbered = number_within(links, [listing], "pos", "link_no")
    return numbered.withColumn("batch_no", F.expr(f"link_no div {batch_size}"))
