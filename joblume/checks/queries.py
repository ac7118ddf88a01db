"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from joblume.checks import fixtures as fx
from joblume.functions import recency, text
from joblume.operators import batches, links, records, replies, tickets
from joblume.operators.skew import dense_rank_by
from joblume.plans import run as plan
from joblume.plans.ledger import ReplyLedger
from joblume.plans.specs import HARDWARE, JOBS
from joblume.session import scratch_path
from joblume.sinks.base import current, fan_out, store
from joblume.sinks.jobs_table import JobsTable, joined_list
from joblume.sinks.notes import NoteTable, note_filename, render_notes
from joblume.sinks.tickets import TicketOutbox
from joblume.sources import pages as page_source
from joblume.sources.title_pages import land_title_pages, read_title_pages
from joblume.sources.titles import scan_titles
from joblume.sources.url_list import first_lines, parse_lines
from joblume.streaming import stream
from joblume.streaming.state import first_by_order, settled

POS = ["pos"]


def _pages(spark, sf):
    return fx.table(spark, sf, "pages")


def _urls(spark, sf):
    return parse_lines(fx.fixture(spark, sf, fx.URLS))


def _cards(spark, sf):
    return fx.fixture(spark, sf, fx.CARDS)


def _links(spark, sf):
    return links.distinct_links(links.fresh_cards(_cards(spark, sf), fx.NOW))


def _listing(spark, sf):
    return batches.with_page(fx.listing_pages(spark, sf), "text")


def _clean(spark, sf):
    return (batches.with_page(_pages(spark, sf), "text")
            .select("page_id", "url", batches.clean_text(F.col("page")).alias("clean_text"),
                    F.col("page.main_selector").alias("main_selector")))


def _final(spark, sf):
    return records.finalize(fx.items(spark, sf), POS)


# -- sources

def url_list_scan(spark, sf):
    return _urls(spark, sf)


def _snapshots(spark, sf):
    """A store of three snapshots of each URL, landed in two additions."""
    store = page_source.PageStore(scratch_path(spark, "pages"), buckets=8)
    snapshots = fx.fixture(spark, sf, fx.SNAPSHOTS)
    for third in (True, False):
        store.add(snapshots.where((F.col("page_id") % 3 == 2) == third))
    return store


def page_snapshot_lookup(spark, sf):
    def reduce(rows):
        return rows.select("url", "page_id", F.length("html").cast("bigint").alias("n_chars"), F.md5("html").alias("digest"))
    # as if the list were too long to be broadcast
    return page_source.lookup(_urls(spark, sf), _snapshots(spark, sf), reduce, broadcast_limit=0)


def missing_pages(spark, sf):
    urls = _urls(spark, sf)
    found = page_source.has_content(page_source.fetch(_pages(spark, sf), urls.select("url").distinct()))
    return page_source.missing(urls, found).select("line_no", "url")


def url_first_lines(spark, sf):
    return first_lines(_urls(spark, sf)).select("url", "url_no", "n_lines")


def existing_titles_scan(spark, sf):
    path = scratch_path(spark, "titles")
    land_title_pages(fx.title_pages(spark, sf), path)
    return scan_titles(read_title_pages(spark, path))


def response_scan(spark, sf):
    path = scratch_path(spark, "replies")
    fx.replies(spark, sf).write.parquet(path)
    from joblume.sources.replies import read_replies
    return read_replies(spark, path)


# -- filters

def empty_content_filter(spark, sf):
    return page_source.has_content(_pages(spark, sf)).select("page_id")


def recency_absolute(spark, sf):
    times = fx.fixture(spark, sf, fx.TIMES)
    moment = recency.iso_moment(F.col("datetime_attr"))
    return times.select("event_id", moment.isNotNull().alias("readable"),
                        recency.is_recent_moment(moment, recency.now_column(fx.NOW)).alias("fresh"))


def recency_relative(spark, sf):
    times = fx.fixture(spark, sf, fx.TIMES)
    return times.select("event_id", recency.is_recent_text(F.col("time_text")).alias("fresh"))


def recency_filter(spark, sf):
    times = fx.fixture(spark, sf, fx.TIMES)
    return times.where(recency.is_recent(F.lit(True), F.col("datetime_attr"), F.col("time_text"), fx.NOW)) \
        .select("event_id")


def absolute_link_filter(spark, sf):
    return _cards(spark, sf).where(links.is_absolute(F.col("href"))).select("listing_id", "pos", "href")


def required_fields_filter(spark, sf):
    return records.require_fields(fx.items(spark, sf)).select("pos", "titulo", "empresa")


def empty_result_guard(spark, sf):
    parsed = replies.parse_replies(fx.replies(spark, sf))
    return replies.has_records(parsed).select("batch_id", F.size("records").cast("bigint").alias("n_records"))


def text_route(spark, sf):
    def routed(rows, kind, key, text):
        html = rows.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("html"))
        ready = html.withColumn("ready", batches.is_ready_text(F.col("html")))
        read = batches.with_page(ready.where(~F.col("ready")), "text")
        return ready.where("ready").select("kind", "id", "ready", F.col("html").alias("text")).unionByName(
            read.select("kind", "id", "ready", batches.route_text(F.col("html"), batches.clean_text(F.col("page"))).alias("text")))
    return routed(_pages(spark, sf), "page", "page_id", "html").unionByName(
        routed(fx.fixture(spark, sf, fx.ROUTED), "document", "doc_id", "text"))


# -- page to records

def card_explode(spark, sf):
    return (_listing(spark, sf).select(F.col("page_id").alias("listing_id"), F.explode("page.cards").alias("card"))
            .select("listing_id", F.col("card.pos").cast("bigint").alias("pos"), "card.href"))


def card_link_select(spark, sf):
    return card_explode(spark, sf).where(links.is_absolute(F.col("href")))


def card_time_select(spark, sf):
    return (_listing(spark, sf).select(F.col("page_id").alias("listing_id"), F.explode("page.cards").alias("card"))
            .select("listing_id", F.col("card.pos").cast("bigint").alias("pos"), "card.has_time",
                    "card.datetime_attr", "card.time_text"))


def link_fallback(spark, sf):
    found = links.with_links(_listing(spark, sf), F.col("page.cards"), F.col("page.anchors"), fx.NOW)
    return (found.select(F.col("page_id").alias("listing_id"), F.posexplode("links").alias("pos", "href"))
            .select("listing_id", F.col("pos").cast("bigint").alias("pos"), "href"))


def boilerplate_prune(spark, sf):
    # without a main element the whole page is kept, less the removed elements
    bare = _pages(spark, sf).withColumn("html", F.regexp_replace("html", "</?article>", ""))
    return (batches.with_page(bare, "text")
            .select("page_id", batches.clean_text(F.col("page")).alias("clean_text")))


def main_content_select(spark, sf):
    return _clean(spark, sf).select("page_id", "main_selector")


def card_text_project(spark, sf):
    return _listing(spark, sf).select(F.col("page_id").alias("listing_id"),
                                      batches.clean_text(F.col("page")).alias("clean_text"))


def markdown_render(spark, sf):
    return (batches.with_page(_pages(spark, sf), "markdown")
            .select("page_id", batches.clean_text(F.col("page")).alias("clean_text")))


def line_compact(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", text.line_compact(F.col("text")).alias("compact"))


def text_truncate(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.truncate(F.col("text"), text.CONFIGURED_CHAR_LIMIT).alias("configured"),
        text.truncate(F.col("text"), text.DEFAULT_CHAR_LIMIT).alias("standard"))


def page_clean(spark, sf):
    return _clean(spark, sf).select("page_id", "clean_text")


def row_isolation(spark, sf):
    pages = _pages(spark, sf).select("page_id", "html")
    broken = pages.select("page_id", F.concat(F.lit("<![oops "), "html").alias("html"))
    absent = pages.select("page_id", F.lit(None).cast("string").alias("html"))
    mixed = (pages.withColumn("kind", F.lit("good")).unionByName(broken.withColumn("kind", F.lit("broken")))
             .unionByName(absent.withColumn("kind", F.lit("absent"))))
    return (batches.with_page(mixed, "text")
            .select("page_id", "kind", F.col("page.parse_error").isNull().alias("ok"),
                    F.length(batches.clean_text(F.col("page"))).cast("bigint").alias("n_chars")))


# -- distinct, dedupe, joins

def link_distinct(spark, sf):
    return _links(spark, sf).select("listing_id", "pos", "href")


def listing_route(spark, sf):
    found = links.with_links(_listing(spark, sf), F.col("page.cards"), F.col("page.anchors"), fx.NOW)
    return (found.select(F.col("page_id").alias("listing_id"), F.size("links").cast("bigint").alias("n_links"))
            .withColumn("follows", links.follows_links(F.col("n_links"))))


def detail_join(spark, sf):
    details = _pages(spark, sf).select(F.col("url").alias("href"), "page_id")
    return batches.join_details(_links(spark, sf).select("listing_id", "pos", "href"), details)


def missing_details(spark, sf):
    details = _pages(spark, sf).select(F.col("url").alias("href"))
    return batches.missing_details(_links(spark, sf).select("listing_id", "pos", "href"), details)


def item_key(spark, sf):
    return fx.items(spark, sf).select("pos", records.item_key().alias("item_key"))


def item_dedupe_first(spark, sf):
    return records.dedupe_first(fx.items(spark, sf), POS).select("item_key", "pos", "titulo", "empresa")


def ticket_history_anti(spark, sf):
    index = tickets.TitleIndex(scratch_path(spark, "history"), buckets=8)
    known = fx.fixture(spark, sf, fx.TITLES).where("title <> ''").select("p_partkey", "title")
    for half in (0, 1):     # the history grows by additions
        index.add(known.where(F.col("p_partkey") % 2 == half))
    return tickets.drop_known(_final(spark, sf), index).select("pos", "titulo", "empresa")


def ticket_self_suppress(spark, sf):
    return tickets.drop_repeats(_final(spark, sf), POS).select("pos", "titulo", "empresa")


def cross_run_anti(spark, sf):
    return records.drop_stored(_final(spark, sf), fx.fixture(spark, sf, fx.STORED)).select("item_key", "pos")


# -- batches and requests

def batch_assign(spark, sf):
    return links.assign_batches(_links(spark, sf)).select("listing_id", "pos", "link_no", "batch_no")


def batch_text(spark, sf):
    assigned = links.assign_batches(_links(spark, sf)).select("listing_id", "batch_no", "pos", "href")
    assigned = plan.land(assigned, scratch_path(spark, "batches"), "links")

    def reduce(rows):
        text = batches.clean_text(F.col("page")).alias("clean_text")
        return batches.with_page(rows, "text").select("url", "page_id", text)

    cleaned = page_source.fetch(_snapshots(spark, sf), assigned.select(F.col("href").alias("url")).distinct(), reduce, 0) \
        .select(F.col("url").alias("href"), "clean_text")
    joined = batches.join_details(assigned, cleaned, keep_missing=True, row_id=["listing_id", "pos"])
    return batches.batch_texts(joined, ["listing_id"])


def request_build(spark, sf):
    requests = batches.build_requests(fx.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return requests.select("doc_id", "model", F.col("messages")[0]["role"].alias("first_role"),
                           F.col("messages")[0]["content"].alias("system"),
                           F.col("messages")[1]["role"].alias("second_role"),
                           F.col("messages")[1]["content"].alias("content"),
                           "temperature", F.col("max_output_tokens").cast("bigint").alias("max_output_tokens"))


def run_counters(spark, sf):
    path = scratch_path(spark, "counted")
    items, seen, parsed = _counted_run(spark, sf, path)
    outbox = TicketOutbox(f"{path}/outbox", fx.fixture(spark, sf, fx.TITLES).where("title <> ''").select("title"))
    outbox.write(items, "jobs")
    per_url = plan.count_batches(parsed)
    names = [c for c in per_url.columns if c.startswith("n_")]
    per_url = per_url.select("source_url", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names])).alias("c")).select("source_url", "c.*")
    counts = list((seen | outbox.seen).items())
    return per_url.unionByName(spark.createDataFrame([(None, *c) for c in counts], per_url.schema))


def _counted_run(spark, sf, path):
    """Replies of the listings' batches, by turns, and the records that the run makes of them."""
    listed = links.assign_batches(_links(spark, sf)).groupBy("listing_id", "batch_no").agg(F.count(F.lit(1)).alias("n_links"))
    listed = plan.land(listed, path, "listed")
    numbered = dense_rank_by(listed, ["listing_id", "batch_no"], "turn").drop("batch_no")
    urls = _pages(spark, sf).select(F.col("page_id").alias("listing_id"), "url")
    parsed = (replies.parse_replies(fx.replies(spark, sf))
              .withColumn("turn", F.col("batch_id") % listed.count()).join(numbered, "turn").join(urls, "listing_id")
              .select(F.col("listing_id").alias("url_no"), F.col("batch_id").alias("batch_no"), "url", "n_links",
                      "records", "reason"))
    parsed = plan.land(parsed, path, "parsed")
    items, seen = plan.final_records(parsed, path)
    return items, seen, parsed


# -- replies

def response_parse(spark, sf):
    parsed = replies.parse_replies(fx.replies(spark, sf))
    return parsed.select("batch_id", F.col("records").isNotNull().alias("valid"),
                         F.coalesce(F.size("records"), F.lit(0)).cast("bigint").alias("n_records"))


def requisitos_normalise(spark, sf):
    reply = replies.parse_json(F.col("response"))
    listed = F.explode(F.try_variant_get(reply, "$.vagas", "array<variant>"))
    ok, values = replies.text_list(F.col("value"))
    return (fx.replies(spark, sf).select("batch_id", listed.alias("record"))
            .select("batch_id", F.try_variant_get("record", "$.link_inscricao", "string").alias("link"),
                    F.try_variant_get("record", "$.requisitos", "variant").alias("value"))
            .select("batch_id", "link", F.coalesce(F.col("value").isNotNull() & ok, F.lit(False)).alias("valid"),
                    F.when(F.col("value").isNotNull() & ok, joined_list(values)).alias("requisitos")))


def batch_quarantine(spark, sf):
    rejected = replies.quarantine(replies.parse_replies(fx.replies(spark, sf)))
    return rejected.select("batch_id", "reason")


def items_explode(spark, sf):
    parsed = replies.parse_replies(fx.replies(spark, sf)).withColumn("source_url", F.lit("https://list.example/"))
    return (replies.explode_records(parsed, ["batch_id", "source_url"])
            .select("batch_id", "source_url", F.col("pos").cast("bigint").alias("pos"), "titulo", "empresa",
                    "salario", joined_list(F.col("requisitos")).alias("requisitos"), "link_inscricao"))


def hardware_normalise(spark, sf):
    parsed = replies.parse_replies(fx.hardware_replies(spark, sf), HARDWARE)
    first = F.get(F.col("records"), F.lit(0))
    return parsed.select("batch_id", F.col("records").isNotNull().alias("valid"),
                         *[first[f.name].alias(f.name) for f in HARDWARE.fields])


def hardware_explode(spark, sf):
    parsed = replies.parse_replies(fx.hardware_replies(spark, sf), HARDWARE)
    return replies.explode_records(parsed, ["batch_id"]).select("batch_id", "produto", "preco_vista", "em_estoque")


# -- repair

def site_name(spark, sf):
    return _pages(spark, sf).select("page_id", text.site_name(F.col("url")).alias("site"))


def link_repair(spark, sf):
    return fx.items(spark, sf).select(
        "pos", records.repaired_link(F.col("link_inscricao"), F.col("source_url")).alias("link_inscricao"))


def origin_fill(spark, sf):
    return fx.items(spark, sf).select(
        "pos", records.filled_origin(F.col("origem"), F.col("source_url")).alias("origem"))


def item_finalize(spark, sf):
    return _final(spark, sf).select("pos", "item_key", "titulo", "empresa", "origem", "link_inscricao", "source_url")


# -- other projections

def safe_name(spark, sf):
    return fx.items(spark, sf).select("pos", text.safe_name(F.concat("titulo", F.lit(" (é½/_) "), "empresa")).alias("safe"))


def note_filename_query(spark, sf):
    name = note_filename(F.col("titulo"), "jobs", recency.now_column(fx.NOW), [F.col("pos")])
    return fx.items(spark, sf).select("pos", name.alias("filename"))


def note_render(spark, sf):
    return render_notes(_final(spark, sf), "jobs", fx.NOW, POS).select("path", "content")


def ticket_fields(spark, sf):
    return tickets.with_ticket_fields(_final(spark, sf)).select("pos", "title", "search", "body")


def requisitos_join(spark, sf):
    return fx.items(spark, sf).select("pos", joined_list(F.col("requisitos")).alias("requisitos"))


# -- sinks

def note_sink(spark, sf):
    path = scratch_path(spark, "notes")
    sink = NoteTable(path, fx.NOW, POS)
    sink.reset(spark)
    sink.write(_final(spark, sf), "jobs")
    return spark.read.parquet(path).select("niche", "path", "content")


JOB_RULES = {"place": "localizacao IS NOT NULL", "pay": "salario NOT IN ('13', '14')"}


def _stored_jobs(spark, sink):
    text = F.col("extraido_em").cast("string").alias("extraido_em")
    columns = ["titulo", "empresa", "localizacao", "origem", "salario", "requisitos", "link_inscricao", text]
    kept = spark.read.parquet(sink.path).select("id", *columns, F.lit(None).cast("string").alias("reason"))
    aside = spark.read.parquet(sink.rejects).select(F.lit(None).cast("long").alias("id"), *columns, "reason")
    return kept.unionByName(aside)


def jobs_table_sink(spark, sf):
    sink = JobsTable(scratch_path(spark, "jobs"), fx.NOW, order=POS, constraints=JOB_RULES)
    some = F.when(F.col("pos") % 41 != 0, F.col("localizacao"))     # rows that the store refuses
    final = _final(spark, sf).withColumn("localizacao", some)
    sink.write(final, "jobs")
    sink.write(final, "jobs")       # a second run stores everything again
    return _stored_jobs(spark, sink)


def ticket_outbox_sink(spark, sf):
    path = scratch_path(spark, "outbox")
    known = fx.fixture(spark, sf, fx.TITLES).where("title <> ''").select("title")
    sink = TicketOutbox(path, known, POS, index=f"{path}-index", buckets=8)
    final = _final(spark, sf)
    sink.write(final, "jobs")
    sink.write(final, "jobs")       # all that was sent is known the second time
    return spark.read.parquet(path)


def output_reset(spark, sf):
    path = scratch_path(spark, "reset")
    notes, jobs = NoteTable(f"{path}/notes", fx.NOW, POS), JobsTable(f"{path}/jobs", fx.NOW)
    final = _final(spark, sf)
    notes.write(final, "jobs")
    jobs.write(final, "jobs")
    notes.reset(spark)
    count = F.count(F.lit(1)).alias("n_rows")
    return (spark.read.parquet(notes.path).agg(count).withColumn("store", F.lit("notes"))
            .unionByName(spark.read.parquet(jobs.path).agg(count).withColumn("store", F.lit("jobs"))))


class BrokenSink:
    """A sink that always fails."""

    def write(self, items, niche, batch_id=None):
        raise OSError("out of order")


def fan_out_query(spark, sf):
    path = scratch_path(spark, "fan-out")
    items = plan.land(_final(spark, sf), path, "items")
    sinks = [NoteTable(f"{path}/notes", fx.NOW, POS), BrokenSink(), TicketOutbox(f"{path}/outbox", None, POS),
             JobsTable(f"{path}/jobs", fx.NOW)]
    status = fan_out(items, sinks, "jobs")
    written = None
    for name, folder in (("NoteTable", "notes"), ("TicketOutbox", "outbox"), ("JobsTable", "jobs")):
        one = spark.read.parquet(f"{path}/{folder}").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("sink", F.lit(name))
        written = one if written is None else written.unionByName(one)
    return status.join(written, "sink", "left").select("sink", F.col("error").isNull().alias("ok"), "n_rows")


def sink_protocol(spark, sf):
    """A store of one's own, registered by name: two-phase files, once written and once failed in a task."""
    from joblume.sinks.note_files import NoteFiles

    class Files:
        def __init__(self, folder, broken=False):
            self.folder, self.broken = folder, broken

        def write(self, items, niche, batch_id=None):
            lines = F.transform(F.array_sort(F.collect_list("item_key")), lambda key: F.concat(key, F.lit(f" {niche}")))
            rows = (items.groupBy(F.expr("pos div 500").alias("part")).agg(F.array_join(lines, "\n").alias("content"))
                    .withColumn("path", F.concat("part", F.lit(".txt"))))
            if self.broken:     # one of the files cannot be written
                rows = rows.withColumn("content", F.when(F.col("part") == 0, F.raise_error(F.lit("broken"))).otherwise(
                    F.col("content")))
            spark.dataSource.register(NoteFiles)
            rows.write.format("note_files").option("folder", self.folder).mode("append").save()

    path = scratch_path(spark, "files")
    local = re.sub("^file:/*", "/", path)
    status = fan_out(plan.land(_final(spark, sf), path, "items"), [Files(f"{local}/good"), Files(f"{local}/bad", True)], "jobs")
    good = spark.read.text(f"{path}/good").select(F.col("value").alias("content"))
    return good.crossJoin(F.broadcast(status.agg(F.count("error").alias("n_failed"))))


# -- streams

def _scrambled(frame, by, folder, parts=3):
    """A table as parts that land out of order, the first of them twice; returns how many files a part has, about.

    Each task writes files of its own, so that none reads the whole table.
    """
    order = [*reversed(range(parts)), 0]
    for part in order:
        frame.where(F.pmod(by, F.lit(parts)) == part).write.mode("append").parquet(folder)
    return -(-len(frame.sparkSession.read.parquet(folder).inputFiles()) // len(order))


def stream_page_dedupe(spark, sf):
    path = scratch_path(spark, "pages")
    files = _scrambled(_pages(spark, sf), F.col("page_id"), path)
    pages = stream.read_stream(spark, path, stream.PAGES_SCHEMA, files_per_trigger=files)
    clean = batches.clean_text(F.col("page"))
    items = (batches.with_page(pages, "text")
             .select("page_id", "url", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("n_chars"),
                     F.left(clean, F.lit(1)).alias("titulo"), text.site_name(F.col("url")).alias("empresa"))
             .withColumn("item_key", records.item_key()))
    passed = stream.drain(first_by_order(items, "item_key", ["page_id"]), "dedupe")
    return settled(passed, "item_key", ["page_id"])


def stream_recency(spark, sf):
    schema = fx.table(spark, sf, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    events = stream.read_stream(spark, sf, schema, "events.parquet")
    cards = spark.sql(fx.TIMES, events=events)
    return stream.drain(stream.recent_stream(cards, "event_id", fx.NOW).select("event_id"), "recency")


def stream_fan_out(spark, sf):
    path = scratch_path(spark, "stream-fan-out")
    files = _scrambled(fx.replies(spark, sf), F.col("batch_id"), f"{path}/landed")
    arriving = stream.read_stream(spark, f"{path}/landed", "batch_id long, response string", files_per_trigger=files)
    parsed = replies.parse_replies(arriving).withColumn("source_url", F.lit("https://list.example/"))
    items = replies.explode_records(parsed, ["batch_id", "source_url"]).withColumn("item_key", records.item_key())
    order = ["batch_id", "pos"]
    outbox = TicketOutbox(f"{path}/outbox", None, order, index=f"{path}/index", buckets=8)
    sinks = [NoteTable(f"{path}/notes", fx.NOW, order), outbox, JobsTable(f"{path}/jobs", fx.NOW, order=order)]
    stream.start_fan_out(items, sinks, "jobs", f"{path}/checkpoint", order, f"{path}/work",
                         lambda first: records.repair(records.require_fields(first))).awaitTermination()
    places = stream.places_of(f"{path}/checkpoint")
    jobs, notes = current(spark, f"{path}/jobs", places), current(spark, f"{path}/notes", places)
    ids = spark.read.parquet(f"{path}/jobs").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"),
                                                 F.max("id").alias("last"))
    dense = ids.select(((F.col("n") == F.col("ids")) & (F.col("n") == F.col("last"))).alias("gapless"))
    # the outbox is read back as well: every record lies in a ticket
    sent = tickets.drop_known(jobs, spark.read.parquet(f"{path}/outbox").select("title")).agg(
        F.count(F.lit(1)).alias("n_unsent"))
    listed = (jobs.withColumn("item_key", records.item_key())
              .join(notes.select(F.substring_index("content", "\n# ", -1).alias("head"), "content", "path"),
                    F.expr("head = concat(titulo, ' @ ', empresa)")))
    return listed.select("item_key", "titulo", "empresa", "localizacao", "origem", "salario", "requisitos",
                         "link_inscricao", F.col("extraido_em").cast("string").alias("extraido_em"), "path", "content") \
        .crossJoin(F.broadcast(dense)).crossJoin(F.broadcast(sent))


# -- extension surface

def schema_spec(spark, sf):
    jobs = replies.parse_replies(fx.replies(spark, sf), JOBS)
    hardware = replies.parse_replies(fx.hardware_replies(spark, sf), HARDWARE)

    def counted(parsed, niche):
        return parsed.agg(F.count("records").alias("n_valid"), F.count("reason").alias("n_rejected")) \
            .withColumn("niche", F.lit(niche))
    return counted(jobs, "jobs").unionByName(counted(hardware, "hardware"))


def extractor_seam(spark, sf):
    path = scratch_path(spark, "seam")
    texts = _clean(spark, sf).select(F.col("page_id").alias("url_no"), F.lit(0).cast("long").alias("batch_no"), "clean_text")
    requests = plan.land(batches.build_requests(texts, "clean_text"), path, "requests")
    ledger = ReplyLedger(f"{path}/ledger")
    ledger.answer(requests, fx.echo_extractor, "clean_text", f"{path}/first")

    def nobody(system, text):
        raise ValueError("asked again")
    # a second run over the same pages makes no call
    answered = ledger.answer(requests, nobody, "clean_text", f"{path}/second")
    found = replies.explode_records(replies.parse_replies(answered), ["url_no"])
    return found.select(F.col("url_no").alias("page_id"), "titulo", "empresa", F.col("salario").alias("digest"),
                        F.size("requisitos").cast("bigint").alias("n_requisitos"))


def whole_run(spark, sf):
    urls, pages = fx.job_site(spark, sf)
    done = plan.run(spark, urls, pages, fx.NOW, fx.echo_extractor, format="text")
    return done.items.select("url_no", "batch_no", F.col("pos").cast("bigint").alias("pos"), "source_url", "item_key", "titulo",
                             "empresa", "localizacao", "origem", F.col("salario").alias("digest"),
                             joined_list(F.col("requisitos")).alias("requisitos"), "link_inscricao")


def queries() -> dict:
    names = [
        url_list_scan, page_snapshot_lookup, missing_pages, url_first_lines, existing_titles_scan, response_scan,
        empty_content_filter, recency_absolute, recency_relative, recency_filter, absolute_link_filter,
        required_fields_filter, empty_result_guard, text_route,
        card_explode, card_link_select, card_time_select, link_fallback, boilerplate_prune, main_content_select,
        card_text_project, markdown_render, line_compact, text_truncate, page_clean, row_isolation,
        link_distinct, listing_route, detail_join, missing_details, item_key, item_dedupe_first,
        ticket_history_anti, ticket_self_suppress, cross_run_anti,
        batch_assign, batch_text, request_build, run_counters,
        response_parse, requisitos_normalise, batch_quarantine, items_explode, hardware_normalise, hardware_explode,
        site_name, link_repair, origin_fill, item_finalize,
        safe_name, note_render, ticket_fields, requisitos_join,
        note_sink, jobs_table_sink, ticket_outbox_sink, output_reset, sink_protocol,
        stream_page_dedupe, stream_recency, stream_fan_out,
        schema_spec, extractor_seam, whole_run,
    ]
    named = {query.__name__: query for query in names}
    return named | {"note_filename": note_filename_query, "fan_out": fan_out_query}
