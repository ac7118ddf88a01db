"""Titles of tickets that exist already, landed page by page from the remote list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.operators.tickets import known_title

LISTING_TYPE = "page_no long, nodes array<struct<content: struct<title: string>>>"


def scan_titles(listing: DataFrame) -> DataFrame:
    """(page_no, nodes) to the set of known titles.

    A page that failed (NULL nodes) ends the scan; what was read before it stays.
    """
    failed = listing.where(F.col("nodes").isNull()).agg(F.min("page_no").alias("page_no"))
    read = listing.where(F.col("page_no") < F.coalesce(failed.scalar(), F.lit(2**63 - 1)))
    return (read.select(F.explode("nodes").alias("node"))
            .select(F.col("node.content.title").alias("title"))
            .where(F.col("title").isNotNull() & (F.col("title") != ""))
            .select(known_title(F.col("title")).alias("title")).distinct())
