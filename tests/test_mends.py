"""What large or unlucky runs meet: many hot keys, failing calls, stores that cannot be replayed."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from joblume.operators import batches, records, replies, skew
from joblume.sinks.base import current, fan_out, store, stored
from joblume.sinks.jobs_table import JobsTable
from joblume.sources import pages as page_source
from joblume.streaming import stream

NOW = datetime(2024, 1, 15, 12)


@pytest.mark.parametrize("text,good", [
    ('{"vagas": []}', True), ('{"vagas": []},0] trailing rubbish', False), ('{"vagas": []},1]', False),
    ('{"vagas": []}]', False), ('0],[{"vagas": []}', False), ('{"vagas": []} ', True), ('{"vagas": []},', False)])
def test_nothing_may_follow_a_reply(spark, text, good):
    parsed = replies.parse_replies(spark.createDataFrame([(1, text)], "batch_id long, response string"))
    assert (parsed.first().reason is None) == good


def test_every_hot_key_gets_its_slots(spark):
    keys, per_key = 1500, 640
    left = spark.range(keys * per_key).select("id", F.concat(F.lit("k"), F.col("id") % keys).alias("k"))
    right = spark.range(keys).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v"))
    joined = skew.spread_join(left, right, "k", "inner", ["id"], rows_per_slot=60)
    assert joined.count() == keys * per_key
    assert joined.where("k <> concat('k', v)").isEmpty()


def request_rows(spark, n=3):
    return batches.build_requests(spark.range(n).select(F.col("id").alias("page_id"),
                                                        F.col("id").cast("string").alias("text")), "text")


def test_a_call_that_fails_twice_is_answered(spark, tmp_path):
    folder = str(tmp_path)

    def flaky(system, text):
        import os
        path = f"{folder}/{text}"
        tries = 1 + (os.path.getsize(path) if os.path.exists(path) else 0)
        with open(path, "a") as file:
            file.write("x")
        if tries < 3:
            raise OSError("429")
        return text

    answered = batches.call_extractor(request_rows(spark), flaky, ["page_id"], "text", wait=(0.0, 0.0)).collect()
    assert sorted((r.page_id, r.response, r.call_error) for r in answered) == [(i, str(i), None) for i in range(3)]


def test_final_errors_are_not_tried_again_and_can_be_resubmitted(spark, tmp_path):
    folder = str(tmp_path)

    def refused(system, text):
        with open(f"{folder}/{text}", "a") as file:
            file.write("x")
        if text == "1":
            raise ValueError("bad request")
        return text

    requests = request_rows(spark)
    answered = spark.createDataFrame(batches.call_extractor(requests, refused, ["page_id"], "text").collect(),
                                     "page_id long, response string, call_error string")
    assert (tmp_path / "1").read_text() == "x"
    again = batches.unanswered(requests, answered, ["page_id"])
    assert [r.page_id for r in again.collect()] == [1]


def test_a_long_error_comes_back_whole(spark):
    class Broken:
        def write(self, items, niche, batch_id=None):
            raise OSError("x" * 5000)
    assert len(fan_out(spark.range(1), [Broken()], "jobs").first().error) == 5009


def test_a_stream_into_a_store_without_a_path_is_refused(spark):
    items = spark.createDataFrame([("a", "b", "c", "d", "e", ["f"], "g")],
                                  "titulo string, empresa string, localizacao string, origem string, salario string, "
                                  "requisitos array<string>, link_inscricao string")
    with pytest.raises(ValueError, match="needs a store with a path"):
        JobsTable(now=NOW, format="jdbc", url="jdbc:none", dbtable="jobs").write(items, "jobs", batch_id=7)


def test_only_an_absent_store_is_no_store(spark, tmp_path):
    assert stored(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        stored(spark, str(tmp_path / "bad"))
    store(spark.range(3), str(tmp_path / "good"), None)
    assert stored(spark, str(tmp_path / "good")).count() == 3


def test_a_stream_keeps_the_record_the_batch_keeps(spark, tmp_path):
    def reply(batch_id, salary):
        return batch_id, json.dumps({"vagas": [{"titulo": "T", "empresa": "Acme", "localizacao": "", "origem": "x",
                                                "salario": salary, "requisitos": None, "link_inscricao": "http://x"}]})

    folder, schema = str(tmp_path / "in"), "batch_id long, response string"

    def go():
        arriving = replies.parse_replies(stream.read_stream(spark, folder, schema))
        found = replies.explode_records(arriving.withColumn("source_url", F.lit("http://s")), ["batch_id", "source_url"])
        stream.start_fan_out(found.withColumn("item_key", records.item_key()), [jobs], "jobs", str(tmp_path / "cp"),
                             ["batch_id", "pos"], str(tmp_path / "work"), records.require_fields).awaitTermination()
        return [r.salario for r in current(spark, jobs.path, stream.places_of(str(tmp_path / "cp"))).collect()]

    jobs = JobsTable(str(tmp_path / "jobs"), NOW, order=["batch_id", "pos"])
    spark.createDataFrame([reply(2, "second"), reply(1, "first")], schema).coalesce(1).write.parquet(folder)
    assert go() == ["first"]
    spark.createDataFrame([reply(3, "later")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert go() == ["first"]
    spark.createDataFrame([reply(0, "late, but earlier")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert go() == ["late, but earlier"]


def test_a_long_list_filters_the_scan_before_the_shuffle(spark):
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), F.col("id") % 10_000).alias("url"),
                                       F.concat(F.lit("html "), F.col("id")).alias("html"))
    wanted = spark.range(100).select(F.concat(F.lit("u"), F.col("id") * 7).alias("url"))
    latest = wanted.join(pages, "url").groupBy("url").agg(F.max("page_id").alias("page_id"))
    passed = page_source.probably_in(pages, latest, ["url", "page_id"], 100)
    assert 100 <= passed.count() < 5000
    found = page_source.fetch(pages, wanted, broadcast_limit=0)
    assert sorted((r.url, r.page_id, r.html) for r in found.collect()) == sorted(
        (f"u{7 * i}", 7 * i + 10_000, f"html {7 * i + 10_000}") for i in range(100))
