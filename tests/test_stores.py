"""Stores: rows set aside, dense ids, batches written once, two-phase files, bucketed pages and titles."""

import os
import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from joblume.operators import tickets
from joblume.operators.batches import build_requests
from joblume.operators.skew import dense_rank_by
from joblume.plans.ledger import ReplyLedger
from joblume.sinks.base import BatchInDoubt, BatchLedger
from joblume.sinks.jobs_table import JobsTable
from joblume.sinks.note_files import NoteFiles
from joblume.sinks.notes import NoteFolder
from joblume.sinks.tickets import TicketOutbox
from joblume.sources import pages as page_source
from joblume.sources.title_pages import land_title_pages, read_title_pages
from joblume.sources.titles import scan_titles

NOW = datetime(2024, 1, 15, 12)
SCHEMA = ("url_no long, batch_no long, pos long, titulo string, empresa string, localizacao string, origem string, "
          "salario string, requisitos array<string>, link_inscricao string")


def items(spark, n, place="SP"):
    return spark.createDataFrame([(0, i // 5, i % 5, f"Dev {i}", "Acme", place, "Web", str(i), ["x"], "http://a")
                                  for i in range(n)], SCHEMA)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# -- rows that a store refuses

def test_rows_that_break_a_rule_are_set_aside_and_the_others_stored(spark, tmp_path):
    sink = JobsTable(str(tmp_path / "jobs"), NOW, constraints={"place": "localizacao IS NOT NULL", "pay": "CAST(salario AS INT) < 8"})
    frame = items(spark, 10).withColumn("localizacao", F.when(F.col("pos") != 2, F.col("localizacao")))
    frame = frame.withColumn("salario", F.when(F.col("salario") == "4", None).otherwise(F.col("salario")))
    sink.write(frame, "jobs")
    kept = spark.read.parquet(sink.path).orderBy("id").collect()
    assert [r.titulo for r in kept] == ["Dev 0", "Dev 1", "Dev 3", "Dev 5", "Dev 6"] and [r.id for r in kept] == [1, 2, 3, 4, 5]
    aside = {r.titulo: r.reason for r in spark.read.parquet(sink.rejects).collect()}
    # what cannot be told is refused too
    assert aside == {"Dev 2": "place", "Dev 4": "pay", "Dev 7": "place", "Dev 8": "pay", "Dev 9": "pay"}


def test_long_values_are_stored_as_they_are(spark, tmp_path):
    sink = JobsTable(str(tmp_path / "jobs"), NOW, constraints={"title": "titulo IS NOT NULL"})
    sink.write(items(spark, 1).withColumn("titulo", F.repeat(F.lit("x"), 5000)), "jobs")
    assert len(spark.read.parquet(sink.path).first().titulo) == 5000 and spark.read.parquet(sink.rejects).count() == 0


def test_rules_need_a_place_for_what_breaks_them():
    with pytest.raises(ValueError):
        JobsTable(format="jdbc", constraints={"a": "true"})


# -- keys

def test_ids_go_on_without_a_gap_in_order_of_arrival(spark, tmp_path):
    sink = JobsTable(str(tmp_path / "jobs"), NOW)
    for n in (23, 0, 40):
        sink.write(items(spark, n).orderBy(F.rand(1)).repartition(7), "jobs")
    rows = spark.read.parquet(sink.path).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 64))
    assert [r.titulo for r in rows] == [f"Dev {i}" for i in [*range(23), *range(40)]]


def test_a_table_from_before_ids_were_noted_is_gone_on_with(spark, tmp_path):
    spark.range(7, 9).withColumnRenamed("id", "id").write.parquet(str(tmp_path / "jobs"))
    assert JobsTable(str(tmp_path / "jobs"), NOW).last_id(spark, None) == 8


def test_a_replayed_batch_gives_the_same_ids(spark, tmp_path):
    sink = JobsTable(str(tmp_path / "jobs"), NOW)
    for batch_id in (0, 1, 1, 2, 2):
        sink.write(items(spark, 4), "jobs", batch_id)
    rows = spark.read.parquet(sink.path).collect()
    assert sorted((r.batch_id, r.id) for r in rows) == [(b, 4 * b + i) for b in range(3) for i in range(1, 5)]


def test_dense_ranks_against_sorting(spark):
    r = random.Random(3)
    values = r.sample(range(10_000), 500)
    frame = spark.createDataFrame([(v % 7, v) for v in values], "a long, b long").repartition(5)
    got = {(x.a, x.b): x.n for x in dense_rank_by(frame, ["a", "b"], "n", 100).collect()}
    assert got == {key: 100 + i for i, key in enumerate(sorted((v % 7, v) for v in values))}


# -- batches in a store without a path

class Recording(DataSource):
    """Notes each commit in a folder."""

    @classmethod
    def name(cls):
        return "recording"

    def writer(self, schema, overwrite):
        return _RecordingWriter(self.options["folder"])


class _RecordingWriter(DataSourceWriter):
    def __init__(self, folder):
        self.folder = folder

    def write(self, rows):
        message = WriterCommitMessage()
        message.n = sum(1 for _ in rows)
        return message

    def commit(self, messages):
        with open(os.path.join(self.folder, "log"), "a") as log:
            log.write(f"{sum(m.n for m in messages if m)}\n")

    def abort(self, messages):
        pass


def recording(spark, tmp_path, ledger):
    import sys

    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Recording)
    return JobsTable(now=NOW, format="recording", ledger=ledger, folder=str(tmp_path))


def test_each_batch_has_one_effect(spark, tmp_path):
    sink = recording(spark, tmp_path, BatchLedger(str(tmp_path / "ledger")))
    for batch_id in (0, 0, 1, 1, 0, 2):
        sink.write(items(spark, 3 + batch_id), "jobs", batch_id)
    assert (tmp_path / "log").read_text().split() == ["3", "4", "5"]
    sink.write(items(spark, 9), "jobs")     # no batch of a stream
    assert (tmp_path / "log").read_text().split()[-1] == "9"


def test_a_batch_in_doubt_stops_unless_the_store_has_nothing_of_it(spark, tmp_path):
    ledger = BatchLedger(str(tmp_path / "ledger"))
    ledger.mark(spark, "begun", 4)
    with pytest.raises(BatchInDoubt):
        recording(spark, tmp_path, ledger).write(items(spark, 1), "jobs", 4)
    with pytest.raises(BatchInDoubt):
        recording(spark, tmp_path, BatchLedger(ledger.path, lambda batch_id: True)).write(items(spark, 1), "jobs", 4)
    assert not (tmp_path / "log").exists()
    recording(spark, tmp_path, BatchLedger(ledger.path, lambda batch_id: False)).write(items(spark, 1), "jobs", 4)
    assert (tmp_path / "log").read_text() == "1\n"


def test_a_stream_without_path_and_ledger_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="ledger"):
        recording(spark, tmp_path, None).write(items(spark, 1), "jobs", 0)


# -- two-phase files

def test_a_sink_that_fails_in_one_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(NoteFiles)
    rows = spark.range(40).repartition(4).select(
        F.concat("id", F.lit(".md")).alias("path"),
        F.when(F.col("id") == 17, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="no"):
        rows.write.format("note_files").option("folder", str(tmp_path)).mode("append").save()
    assert os.listdir(tmp_path) == []


def test_a_note_that_cannot_be_written_leaves_the_folder_as_it_was(spark, tmp_path):
    NoteFolder(str(tmp_path), NOW).write(items(spark, 3), "jobs")
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(Exception):
        NoteFolder(str(tmp_path), NOW, order=["titulo"]).write(
            items(spark, 8).withColumn("titulo", F.when(F.col("pos") == 4, F.repeat(F.lit("x"), 400)).otherwise("y/z")), "jobs")
    assert sorted(os.listdir(tmp_path)) == before and len(before) == 3


# -- pages

def store_of(spark, tmp_path, versions=3, n=60):
    store = page_source.PageStore(str(tmp_path / "pages"), buckets=4)
    for k in range(versions):   # the newest does not land last
        version = (k + 1) % versions
        store.add(spark.createDataFrame([(i * 10 + version, f"http://u{i}", f"<p>{i} v{version}</p>") for i in range(n)],
                                        "page_id long, url string, html string"))
    return store


@pytest.mark.parametrize("limit", [0, 10**9])
def test_the_latest_of_three_snapshots_comes_out_of_the_store(spark, tmp_path, limit):
    store = store_of(spark, tmp_path)
    wanted = spark.createDataFrame([(f"http://u{i}", i) for i in [*range(0, 60, 7), 99]], "url string, no long")
    found = page_source.fetch(store, wanted, broadcast_limit=limit).collect()
    assert sorted((r.no, r.page_id, r.html) for r in found) == [(i, i * 10 + 2, f"<p>{i} v2</p>") for i in range(0, 60, 7)]


def test_html_is_never_exchanged_out_of_the_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(page_source, "FILTER_BITS", 32)     # a filter would be full
    store = store_of(spark, tmp_path)
    wanted = spark.createDataFrame([(f"http://u{i}",) for i in range(55)], "url string")
    found = page_source.fetch(store, wanted, lambda rows: rows.withColumn("n", F.length("html")), broadcast_limit=0)
    plan = plan_of(found)
    scan = next(line for line in plan.split("\n") if "FileScan" in line and "html" in line)
    assert "Bucketed: true" in scan and found.count() == 55
    # the way from the scan of html up to the root has no exchange: exchanges stand on branches of their own
    depth = len(re.match(r"[ :+\-*()0-9]*", scan)[0])
    above = plan.split("\n")[:plan.split("\n").index(scan)]
    for line in reversed(above):
        indent = len(re.match(r"[ :+\-*()0-9]*", line)[0])
        if indent < depth:
            depth = indent
            assert "Exchange" not in line, plan
    assert "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan


# -- titles

def test_the_stored_history_is_never_exchanged(spark, tmp_path):
    index = tickets.TitleIndex(str(tmp_path / "index"), buckets=4)
    for some in (["[Web] Dev @ Acme Inc", "[x] senior dev @ acme"], ["Ops @ Beta", None, "no anchor"]):
        index.add(spark.createDataFrame([(t,) for t in some], "title string"))
    assert index.size(spark) == 4 and index.exists(spark)
    records = items(spark, 3).withColumn("titulo", F.element_at(F.array(F.lit("Dev"), F.lit("Dba"), F.lit("ops")), (F.col("pos") + 1).cast("int")))
    frame = tickets.drop_known(records, index)
    plan = plan_of(index.containing(records.select(tickets.search_text().alias("search"))))
    for line in plan.split("\n"):
        if "Exchange" in line:
            assert "before" not in line and "after" not in line
    scan = plan.split("\n").index(next(x for x in plan.split("\n") if "FileScan" in x))
    depth = len(re.match(r"[ :+\-*()0-9]*", plan.split("\n")[scan])[0])
    joined = False
    for line in reversed(plan.split("\n")[:scan]):
        indent = len(re.match(r"[ :+\-*()0-9]*", line)[0])
        if indent < depth:
            depth = indent
            joined = joined or "HashJoin" in line
            assert joined or "Exchange" not in line, plan   # below the join nothing of the history moves
    assert sorted(r.titulo for r in frame.collect()) == ["Dba", "ops"]


def test_index_against_plain_containment(spark, tmp_path):
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab @") for _ in range(r.randrange(1, 7)))
    titles = [f"[{word()}] {word()} @ {word()}{r.choice(['', ' @ b'])}" for _ in range(300)]
    some = [(f"x{word()}".strip(), f"{word()}y".strip()) for _ in range(100)] + [("a", "b"), ("b", "a"), ("ab", "ba")]
    some += [(t.split(" @ ")[0][-r.randrange(1, 6):].strip() or "q", t.split(" @ ")[1][:r.randrange(1, 5)].strip() or "q")
             for t in titles[:150]]
    records = spark.createDataFrame([(0, 0, i, a, b, "", "w", "", [], "http://a") for i, (a, b) in enumerate(some)], SCHEMA)
    index = tickets.TitleIndex(str(tmp_path / "index"), buckets=4)
    index.add(spark.createDataFrame([(t,) for t in titles], "title string"))
    known = [t.lower().strip() for t in titles]
    expected = sorted(i for i, (a, b) in enumerate(some) if not any(f"{a} @ {b}".lower().strip() in t for t in known))
    assert sorted(r.pos for r in tickets.drop_known(records, index).collect()) == expected
    assert 0 < len(expected) < len(some)


def test_outbox_with_an_index_is_the_outbox_without(spark, tmp_path):
    known = spark.createDataFrame([("[Web] Dev 1 @ Acme",), (None,)], "title string")
    plain, indexed = TicketOutbox(str(tmp_path / "a"), known), TicketOutbox(str(tmp_path / "b"), known, index=str(tmp_path / "i"))
    for batch_id, n in ((0, 3), (1, 5), (1, 5), (2, 7)):
        for sink in (plain, indexed):
            sink.write(items(spark, n), "jobs", batch_id)
    read = lambda sink: sorted((r.batch_id, r.title) for r in spark.read.parquet(sink.path).collect())
    assert read(plain) == read(indexed) and len(read(plain)) == 6
    # "dev 1 @ acme" is known; items 0, 2 and 3 to 6 are sent, each once
    assert plain.seen == {"n_known": 6, "n_suppressed": 5} and indexed.seen["n_suppressed"] == 5


def test_titles_of_which_nothing_reaches_the_index(spark, tmp_path):
    # Spark leaves out what it finds to be empty, and what was observed there with it
    index = tickets.TitleIndex(str(tmp_path / "index"), buckets=2)
    for number, titles in enumerate((["no anchor", "nor here", None], [])):
        path = str(tmp_path / f"titles{number}")
        spark.createDataFrame([(t,) for t in titles], "title string").write.parquet(path)
        index.add(spark.read.parquet(path))
    assert index.size(spark) == 2
    # the second write sends nothing, and the third has no records
    for name in ("with", "without"):
        sink = TicketOutbox(str(tmp_path / name), index=str(tmp_path / f"{name}-index") if name == "with" else None, buckets=2)
        for batch_id, n in ((0, 2), (1, 2), (2, 0)):
            sink.write(items(spark, n), "jobs", batch_id)
        assert spark.read.parquet(sink.path).count() == 2 and sink.seen == {"n_known": 2, "n_suppressed": 0}


# -- title pages

def page(*titles, next_page=None):
    nodes = ", ".join("null" if t is None else f'{{"content": {{"title": "{t}"}}}}' for t in titles)
    return f'{{"nodes": [{nodes}], "next_page": {"null" if next_page is None else next_page}}}'


@pytest.mark.parametrize("pages, expected", [
    ({0: page("A ", None, next_page=1), 1: page("b", next_page=2), 2: page("c")}, ["a", "b", "c"]),
    ({0: page("a", next_page=1), 1: '{"nodes": [{"con', 2: page("c")}, ["a"]),           # broken off
    ({0: page("a", next_page=1), 1: '{"errors": []}', 2: page("c")}, ["a"]),            # an answer without nodes
    ({0: page("a", next_page=1), 2: page("c")}, ["a"]),                                 # never landed
    ({0: page("a"), 1: page("b")}, ["a"]),                                              # the list ends at page 0
    ({0: "no JSON", 1: page("b")}, []), ({}, []),
])
def test_the_scan_ends_at_the_first_failing_page(spark, tmp_path, pages, expected):
    path = str(tmp_path / "pages")
    frame = spark.createDataFrame(list(pages.items()), "page_no long, body string")
    land_title_pages(frame, path)
    os.makedirs(path, exist_ok=True)
    assert sorted(r.title for r in scan_titles(read_title_pages(spark, path)).collect()) == expected


# -- replies that were paid for

def test_no_request_is_sent_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    counter = str(calls)

    def model(system, text):
        import os as system_os
        import uuid
        open(system_os.path.join(counter, uuid.uuid4().hex), "w").close()
        if "fail" in text and not system_os.path.exists(system_os.path.join(counter, "mended")):
            raise RuntimeError("busy")
        return f"reply to {text}"

    def ask(texts, run):
        frame = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "url_no long, batch_no long, text string")
        return sorted((r.url_no, r.response, r.call_error) for r in ReplyLedger(str(tmp_path / "ledger")).answer(
            build_requests(frame, "text"), model, "text", str(tmp_path / f"run{run}"), attempts=1).collect())

    made = lambda: len([x for x in os.listdir(counter) if x != "mended"])
    first = ask(["a", "b", "a", "fail", ""], 1)
    assert made() == 4      # equal requests are sent once
    assert [r for _, r, _ in first] == ["reply to a", "reply to b", "reply to a", None, "reply to "]
    assert first[3][2] == "RuntimeError: busy"
    assert [r for _, r, _ in ask(["b", "a"], 2)] == ["reply to b", "reply to a"] and made() == 4
    (calls / "mended").touch()
    assert ask(["fail", "c"], 3) == [(0, "reply to fail", None), (1, "reply to c", None)] and made() == 6
