"""The whole job: URL list and page snapshots to stored records.

Four tables are landed on the way, in the shared folder: what was read off the
listing pages (so HTML is parsed once), the requests, the replies with the records
parsed from them (so all sinks see the same), and the final records (which each
sink reads).  A lost executor repeats tasks, never a finished stage.  Replies are
kept in a ledger: what was asked once, in this run or another, is not asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from joblume.functions.text import CONFIGURED_CHAR_LIMIT
from joblume.operators import batches, links, records, replies
from joblume.plans.specs import JOBS, SchemaSpec
from joblume.plans.ledger import ReplyLedger
from joblume.session import apply_rules, scratch_path
from joblume.sinks.base import Sink, fan_out
from joblume.sources import pages as page_source
from joblume.sources.url_list import first_lines

KEYS = ["url_no", "batch_no"]


@dataclass
class Run:
    """What a run leaves: tables to read, all lazy but the landed ones."""
    listings: DataFrame
    replies: DataFrame
    quarantine: DataFrame
    items: DataFrame
    counters: DataFrame
    dead_letters: DataFrame
    status: DataFrame | None = None
    seen: dict[str, int] = field(default_factory=dict)


def land(frame: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder}/{name}"
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.parquet(path)


def read_listings(urls: DataFrame, pages: DataFrame, now, format: str = "markdown",
                  char_limit: int = CONFIGURED_CHAR_LIMIT, **link_rules) -> DataFrame:
    """(url_no, url, n_lines, links, own_text, parse_error): links to follow, or the text of a page that is the advert."""
    page = F.col("page")

    def reduce(rows):
        found = links.with_links(batches.with_page(page_source.has_content(rows), format),
                                 page["cards"], page["anchors"], now, **link_rules)
        own = F.when(~links.follows_links(F.size("links")),
                     batches.route_text(F.col("html"), batches.clean_text(page, char_limit)))
        return found.select("url", "page_id", "links", own.alias("own_text"),
                            page["parse_error"].alias("parse_error"))

    return page_source.fetch(pages, first_lines(urls), reduce)


def batch_requests(listings: DataFrame, pages: DataFrame, format: str = "markdown",
                   char_limit: int = CONFIGURED_CHAR_LIMIT, batch_size: int = links.BATCH_SIZE) -> DataFrame:
    """(url_no, batch_no, url, text): batches of linked adverts, and single-advert pages."""
    listed = listings.where(links.follows_links(F.size("links")))
    linked = links.explode_links(listed, ["url_no", "url"], batch_size)
    wanted = linked.select(F.col("href").alias("url")).distinct()

    def reduce(rows):       # an empty page is an empty text, no miss
        text = batches.clean_text(F.col("page"), char_limit)
        return batches.with_page(rows, format).select("url", "page_id", text.alias("clean_text"),
                                                      F.col("page.parse_error").alias("parse_error"))

    cleaned = (page_source.fetch(pages, wanted, reduce)
               .select(F.col("url").alias("href"), "clean_text", "parse_error"))
    joined = batches.join_details(linked, cleaned, keep_missing=True, row_id=["url_no", "pos"])
    followed = (batches.batch_texts(joined, ["url_no", "url"])
                .select(*KEYS, "url", F.col("batch_text").alias("text"), "n_links", "n_unread"))
    own = (listings.where(F.col("own_text").isNotNull())
           .select("url_no", F.lit(0).cast("bigint").alias("batch_no"), "url", F.col("own_text").alias("text"),
                   F.size("links").cast("bigint").alias("n_links"),
                   F.when(F.col("parse_error").isNotNull(), 1).otherwise(0).cast("bigint").alias("n_unread")))
    return followed.unionByName(own)


def lost_details(listings: DataFrame, pages: DataFrame, batch_size: int = links.BATCH_SIZE) -> DataFrame:
    """(url_no, url, pos, href): linked pages of landed ``listings`` that have no snapshot.  Reads no ``html``."""
    listed = listings.where(links.follows_links(F.size("links")))
    linked = links.explode_links(listed, ["url_no", "url"], batch_size).select("url_no", "url", "pos", "href")
    return batches.missing_details(linked, pages.select(F.col("url").alias("href")).distinct())


def count_batches(parsed: DataFrame) -> DataFrame:
    """The numbers a run reports, per URL; ``n_unread`` where the replies tell it: linked pages that could not be read."""
    unread = [F.sum("n_unread").alias("n_unread")] if "n_unread" in parsed.columns else []
    def counted(condition):
        return F.count(F.when(condition, 1))
    return (parsed.groupBy("url_no", F.col("url").alias("source_url"))
            .agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_links").alias("n_links"),
                 F.coalesce(F.sum(F.when(F.size("records") > 0, F.size("records"))), F.lit(0)).alias("n_records"),
                 counted(F.size("records") == 0).alias("n_empty"),
                 counted(F.col("reason") == "no reply").alias("n_failed"),
                 counted(F.col("reason").isNotNull() & (F.col("reason") != "no reply")).alias("n_invalid"), *unread))


def final_records(parsed: DataFrame, folder: str, spec: SchemaSpec = JOBS,
                  stored: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The final records of parsed replies (url_no, batch_no, url, records), landed, and what was seen on the way.

    Counted while they are landed, without another pass: ``n_records`` found,
    ``n_repeats`` of them skipped, ``n_stored`` known from earlier runs,
    ``n_blank`` without a required field, ``n_items`` left.
    """
    marks = {name: Observation(name) for name in ("found", "unique", "new", "final")}

    def counted(frame, name):
        return frame.observe(marks[name], F.count(F.lit(1)).alias("n"))

    found = counted(replies.explode_records(parsed.withColumn("source_url", F.col("url")), [*KEYS, "source_url"]), "found")
    unique = counted(records.dedupe_first(found, key_parts=spec.key), "unique")
    new = counted(unique if stored is None else records.drop_stored(unique, stored), "new")
    final = records.require_fields(new, spec.required)
    if spec.niche == "jobs":
        final = records.repair(final)
    items = land(counted(final, "final"), folder, "items")
    n = {name: mark.get.get("n", 0) for name, mark in marks.items()}
    return items, {"n_records": n["found"], "n_repeats": n["found"] - n["unique"], "n_stored": n["unique"] - n["new"],
                   "n_blank": n["new"] - n["final"], "n_items": n["final"]}


def run(spark: SparkSession, urls: DataFrame, pages: DataFrame, now: datetime | str,
        extractor: Callable[[str, str], str], sinks: Sequence[Sink] = (), work_dir: str | None = None,
        spec: SchemaSpec = JOBS, format: str = "markdown", char_limit: int = CONFIGURED_CHAR_LIMIT,
        batch_size: int = links.BATCH_SIZE, per_record: bool = False,
        stored: DataFrame | None = None, call_partitions: int | None = None, ledger: str | None = None,
        attempts: int = batches.ATTEMPTS, wait: tuple[float, float] = batches.WAIT, **link_rules) -> Run:
    """Visits ``urls`` (line_no, url) in ``pages`` and hands the records to the sinks.

    ``stored`` (item_key) leaves out what earlier runs stored; without it a
    second run stores everything again.  ``call_partitions`` is how many tasks
    call the extractor, where its pace and not the data's size should tell;
    ``attempts`` and ``wait`` are those of ``call_extractor``.  ``ledger`` is
    the folder of replies that runs share: a request that it answers makes no
    call, and one whose call failed is sent again by the next run.  Without it
    the replies of this run alone are kept, below its folder.
    """
    apply_rules(spark)
    for sink in sinks:
        if hasattr(sink, "reset"):
            sink.reset(spark)
    folder = work_dir or scratch_path(spark, "run")
    listings = land(read_listings(urls, pages, now, format, char_limit, **link_rules), folder, "listings")
    texts = batch_requests(listings, pages, format, char_limit, batch_size)
    requests = land(batches.build_requests(texts, "text", spec.niche), folder, "requests")
    kept = ReplyLedger(ledger or f"{folder}/ledger")
    answered = kept.answer(requests, extractor, "text", folder, call_partitions, attempts, wait)
    columns = [*KEYS, "url", "n_links", "n_unread", "response", "call_error"]
    parsed = land(replies.parse_replies(answered.select(*columns), spec, per_record), folder, "replies")
    items, seen = final_records(parsed, folder, spec, stored)
    status = fan_out(items, sinks, spec.niche) if sinks else None
    for sink in sinks:
        seen |= getattr(sink, "seen", {})
    return Run(listings=listings, replies=parsed, quarantine=replies.quarantine(parsed), items=items,
               counters=count_batches(parsed), dead_letters=page_source.missing(urls, listings), status=status, seen=seen)
