import json
from datetime import datetime

from pyspark.sql import functions as F

from joblume.operators import records, replies
from joblume.sinks.base import current
from joblume.sinks.jobs_table import JobsTable
from joblume.sinks.notes import NoteTable
from joblume.streaming import stream
from joblume.streaming.state import first_by_order, settled

NOW = datetime(2024, 1, 15, 12)
REPLIES = "batch_id long, response string"


def reply(batch_id, *titles):
    return batch_id, json.dumps({"vagas": [
        {"titulo": t, "empresa": "Acme", "localizacao": "", "origem": "x", "salario": "", "requisitos": None, "link_inscricao": "http://x"}
        for t in titles]})


def arriving(spark, folder):
    parsed = replies.parse_replies(stream.read_stream(spark, folder, REPLIES, files_per_trigger=1))
    found = replies.explode_records(parsed.withColumn("source_url", F.lit("http://s")), ["batch_id", "source_url"])
    return found.withColumn("item_key", records.item_key())


def test_keys_pass_once_across_batches_and_restarts(spark, tmp_path):
    folder, jobs = str(tmp_path / "in"), JobsTable(str(tmp_path / "jobs"), NOW)

    def land(rows):
        spark.createDataFrame(rows, REPLIES).coalesce(1).write.mode("append").parquet(folder)

    def go():
        stream.start_fan_out(arriving(spark, folder), [jobs], "jobs", str(tmp_path / "cp"), ["batch_id", "pos"],
                             str(tmp_path / "work")).awaitTermination()
        return sorted(r.titulo for r in spark.read.parquet(jobs.path).collect())

    land([reply(1, "a", "b", "A")])
    land([reply(2, "b", "c")])
    assert [t.lower() for t in go()] == ["a", "b", "c"]
    land([reply(3, "C", "d")])
    assert [t.lower() for t in go()] == ["a", "b", "c", "d"]
    batch = replies.explode_records(replies.parse_replies(spark.read.schema(REPLIES).parquet(folder)), ["batch_id"])
    keys = {r[0] for r in batch.select(records.item_key()).collect()}
    assert keys == {r[0] for r in spark.read.parquet(jobs.path).select(records.item_key()).collect()}


def test_late_earlier_and_replayed_records_end_as_in_a_batch(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    jobs, notes = JobsTable(str(tmp_path / "jobs"), NOW, order=["batch_id", "pos"]), NoteTable(str(tmp_path / "notes"), NOW, ["batch_id", "pos"])
    order = ["batch_id", "pos"]

    def go(*batches):
        for rows in batches:
            spark.createDataFrame(rows, REPLIES).coalesce(1).write.mode("append").parquet(folder)
        stream.start_fan_out(arriving(spark, folder), [jobs, notes], "jobs", checkpoint, order, str(tmp_path / "work"),
                             lambda first: records.require_fields(first)).awaitTermination()

    go([reply(5, "a", "B")], [reply(7, "C")])
    go([reply(5, "a", "B")])                    # replayed
    go([reply(2, "A", " ")], [reply(6, "c")])   # earlier than what passed
    go([reply(9, "a", "b", "D")])               # later
    all_items = replies.explode_records(replies.parse_replies(spark.read.schema(REPLIES).parquet(folder)), ["batch_id"])
    batch = records.require_fields(records.dedupe_first(all_items, order)).select("titulo", "batch_id", "pos")
    expected = sorted(tuple(r) for r in batch.collect())
    assert expected == [("A", 2, 0), ("B", 5, 1), ("D", 9, 2), ("c", 6, 0)]
    places = stream.places_of(checkpoint)
    assert sorted(r.titulo for r in current(spark, jobs.path, places).collect()) == ["A", "B", "D", "c"]
    kept = current(spark, notes.path, places).collect()
    assert sorted(r.path.split("_000000_")[1] for r in kept) == ["2_0.md", "5_1.md", "6_0.md", "9_2.md"]
    # ids have no gap, the replaced rows' included
    assert sorted(r.id for r in spark.read.parquet(jobs.path).collect()) == [1, 2, 3, 4, 5, 6]


def test_a_blank_record_that_turns_out_first_takes_its_key_away(spark, tmp_path):
    rows = [("k", 5, "later"), ("k", 1, ""), ("m", 2, "x")]
    folder = str(tmp_path / "in")
    for row in rows:
        spark.createDataFrame([row], "item_key string, n long, titulo string").coalesce(1).write.mode("append").parquet(folder)
    arrived = stream.read_stream(spark, folder, "item_key string, n long, titulo string", files_per_trigger=1)
    passed = stream.drain(first_by_order(arrived, "item_key", ["n"], ttl_hours=1), "passed")
    assert sorted((r.item_key, r.n, r.titulo) for r in settled(passed, "item_key", ["n"]).collect()) == [("k", 1, ""), ("m", 2, "x")]


def test_parts_that_arrive_are_not_written_by_one_task(spark, tmp_path):
    from joblume.checks.queries import _scrambled
    folder, rows = str(tmp_path / "in"), [(i, "x" * i) for i in range(60)]
    files = _scrambled(spark.createDataFrame(rows, "page_id long, html string").repartition(4, "page_id"), F.col("page_id"), folder)
    assert files == 4
    landed = spark.read.parquet(folder)
    assert len(landed.inputFiles()) == 16
    assert sorted(map(tuple, landed.collect())) == sorted(rows + [row for row in rows if row[0] % 3 == 0])


def test_no_batch_reads_what_passed_before(spark, tmp_path, monkeypatch):
    from joblume.sinks import base
    read = []
    monkeypatch.setattr(base, "stored", lambda session, path: read.append(path))
    spark.createDataFrame([reply(1, "a")], REPLIES).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream.start_fan_out(arriving(spark, str(tmp_path / "in")), [NoteTable(str(tmp_path / "notes"), NOW, ["pos"])], "jobs",
                         str(tmp_path / "cp"), ["batch_id", "pos"]).awaitTermination()
    assert read == [] and spark.read.parquet(stream.places_of(str(tmp_path / "cp"))).count() == 1


def test_failing_sink_fails_the_stream_after_the_others_wrote(spark, tmp_path):
    class Broken:
        def write(self, items, niche, batch_id=None):
            raise OSError("full")

    spark.createDataFrame([reply(1, "a")], REPLIES).coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs = JobsTable(str(tmp_path / "jobs"), NOW)

    def go(sinks):
        stream.start_fan_out(stream.dedupe_stream(arriving(spark, str(tmp_path / "in"))), sinks, "jobs", str(tmp_path / "cp"),
                             work_dir=str(tmp_path / "work")).awaitTermination()
    try:
        go([Broken(), jobs])
        raise AssertionError("no failure told")
    except Exception as failure:
        assert "OSError: full" in str(failure)
    assert spark.read.parquet(jobs.path).count() == 1
    go([jobs])      # the batch is tried again and replaces itself
    assert spark.read.parquet(jobs.path).count() == 1


def test_recency_stream_drops_nothing_fresh(spark, tmp_path):
    folder = str(tmp_path / "cards")
    schema = "event_id long, datetime_attr string, time_text string"
    files = [[(1, "2030-01-01", "x"), (2, "2024-01-15", "x")], [(3, "2024-01-14", "x"), (4, "2024-01-10", "x"), (1, "2030-01-01", "x")],
             [(5, None, "2 days"), (6, None, "1 day"), (7, None, None), (8, "2024-01-14T00:00:00", "x")]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    cards = stream.read_stream(spark, folder, schema, files_per_trigger=1)
    out = stream.drain(stream.recent_stream(cards, "event_id", NOW), "t")
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3, 6, 7, 8]
