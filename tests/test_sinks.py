import os
from datetime import datetime

import pytest

from joblume.sinks.base import fan_out
from joblume.sinks.jobs_table import JobsTable
from joblume.sinks.notes import NoteFolder, NoteTable, render_notes
from joblume.sinks.tickets import TicketOutbox

NOW = datetime(2024, 1, 15, 12, 0, 0, 5)
SCHEMA = ("url_no long, batch_no long, pos long, titulo string, empresa string, localizacao string, origem string, "
          "salario string, requisitos array<string>, link_inscricao string")


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(0, 0, 0, "Dev (Jr)", "Acme", "SP", "Web", "10: \"x\"", ["Python", "FastAPI", "SQL"], "http://a"),
                                  (0, 0, 1, "Ops", "Acme", "RJ", "Web", "", [], "http://b")], SCHEMA)


NOTE = """---
titulo: Dev (Jr)
empresa: Acme
localizacao: SP
origem: Web
salario: 10: "x"
link_inscricao: http://a
extraido_em: 2024-01-15T12:00:00.000005
nicho: jobs
---

# Dev (Jr) @ Acme"""


def test_note(spark, items):
    rows = render_notes(items, "jobs", NOW).orderBy("path").collect()
    assert rows[0].path == "jobs_Dev_Jr_20240115_120000_000005_0_0_0.md"
    assert rows[0].content == NOTE
    quoted = render_notes(items, "jobs", NOW, yaml_quote=True).orderBy("path").first().content
    assert 'salario: "10: \\"x\\""' in quoted


def test_hardware_note_and_missing_fields(spark):
    frame = spark.createDataFrame([(1, "GPU", "M", 12000000.0, 0.0, "L", True)],
                                  "pos int, produto string, marca string, preco_vista double, preco_parcelado double, loja string, em_estoque boolean")
    row = render_notes(frame, "hardware", datetime(2024, 1, 1), ["pos"]).first()
    assert row.content == ("---\nproduto: GPU\nmarca: M\npreco_vista: 12000000.0\npreco_parcelado: 0.0\nloja: L\nem_estoque: True\n"
                           "extraido_em: 2024-01-01T00:00:00\nnicho: hardware\n---\n\n# GPU @ ")
    bare = render_notes(frame.select("pos"), "jobs", datetime(2024, 1, 1), ["pos"]).first()
    assert bare.path == "jobs_item_20240101_000000_000000_1.md" and bare.content.endswith("# item @ empresa")


def test_note_folder(spark, items, tmp_path):
    (tmp_path / "kept").mkdir()
    (tmp_path / "old.md").write_text("x")
    sink = NoteFolder(str(tmp_path), NOW)
    sink.reset()
    assert os.listdir(tmp_path) == ["kept"]
    sink.write(items, "jobs")
    assert (tmp_path / "jobs_Dev_Jr_20240115_120000_000005_0_0_0.md").read_text() == NOTE
    assert len(os.listdir(tmp_path)) == 3


def test_jobs_table_appends_with_new_ids(spark, items, tmp_path):
    sink = JobsTable(str(tmp_path / "jobs"), NOW)
    sink.write(items, "jobs")
    first = spark.read.parquet(sink.path).orderBy("id").collect()
    sink.write(items, "hardware")       # the niche makes no difference
    rows = spark.read.parquet(sink.path).orderBy("id").collect()
    assert len({r.id for r in rows}) == 4 and {r.id for r in first} <= {r.id for r in rows}
    assert rows[2].id > rows[1].id and first[0].requisitos == "Python, FastAPI, SQL"
    assert first[0].extraido_em == NOW and spark.read.parquet(sink.path).columns == [
        "id", "titulo", "empresa", "localizacao", "origem", "salario", "requisitos", "link_inscricao", "extraido_em"]


def test_replayed_batch_replaces_itself(spark, items, tmp_path):
    jobs, notes = JobsTable(str(tmp_path / "jobs"), NOW), NoteTable(str(tmp_path / "notes"), NOW)
    outbox = TicketOutbox(str(tmp_path / "outbox"))
    for batch_id in (0, 1, 1):
        for sink in (jobs, notes, outbox):
            sink.write(items, "jobs", batch_id)
    assert spark.read.parquet(jobs.path).count() == 4 and spark.read.parquet(notes.path).count() == 4
    assert spark.read.parquet(jobs.path).select("id").distinct().count() == 4
    assert spark.read.parquet(outbox.path).count() == 2     # all known in the second batch


def test_reset_empties_notes(spark, items, tmp_path):
    sink = NoteTable(str(tmp_path / "notes"), NOW)
    sink.write(items, "jobs")
    sink.reset(spark)
    assert spark.read.parquet(sink.path).count() == 0


def test_outbox_takes_jobs_only(spark, items, tmp_path):
    sink = TicketOutbox(str(tmp_path / "o"), spark.createDataFrame([("[X] OPS @ acme inc",)], "title string"))
    sink.write(items, "hardware")
    assert not (tmp_path / "o").exists()
    sink.write(items, "jobs")
    assert [r.title for r in spark.read.parquet(sink.path).collect()] == ["[Web] Dev (Jr) @ Acme"]


def test_one_failing_sink_does_not_stop_the_others(spark, items, tmp_path):
    class Broken:
        def write(self, items, niche, batch_id=None):
            raise OSError("full")

    jobs = JobsTable(str(tmp_path / "jobs"), NOW)
    status = fan_out(items, [Broken(), jobs], "jobs").orderBy("sink_no").collect()
    assert [(r.sink, r.error) for r in status] == [("Broken", "OSError: full"), ("JobsTable", None)]
    assert spark.read.parquet(jobs.path).count() == 2
