import json
import sys

import pytest
from pyspark import cloudpickle

from joblume.plans.run import lost_details, run
from joblume.plans.specs import HARDWARE
from joblume.sinks.jobs_table import JobsTable
from joblume.sinks.notes import NoteTable
from joblume.sinks.tickets import TicketOutbox

NOW = "2024-01-15 12:00:00"
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def card(href, time="2024-01-15"):
    return f'<li><a class="base-card__full-link" href="{href}">x</a><time datetime="{time}">t</time></li>'


def detail(title):
    return f"<html><body><nav>menu</nav><main><h1>{title}</h1><p>text of {title}</p></main></body></html>"


PAGES = [
    (1, "https://www.board.com/list", "<ul>" + "".join(card(f"https://x/job/{i}") for i in range(1, 8)) + card("https://x/job/9", "2023-01-01") + "</ul>"),
    *[(10 + i, f"https://x/job/{i}", detail(f"Job {i}")) for i in range(1, 7)],     # number 7 is missing
    (19, "https://x/job/9", detail("Stale")),
    (30, "https://single.org/p", detail("Single") + card("https://x/job/1")),
    (40, "https://plain.net/t", "no markup here"),
    (50, "https://empty.net/", ""),
    (55, "https://hollow.net/", "<ul>" + card("https://gone/job/3") + card("https://void/job/1") + "</ul>"),
    (56, "https://void/job/1", ""),
    (60, "https://bad.net/", detail("Bad reply")),
    (70, "https://dead.net/", "<ul>" + card("https://gone/job/1") + card("https://gone/job/2") + "</ul>"),
]


def extractor(system, text):
    if "Bad reply" in text:
        return '{"vagas": [{"titulo": 1}]}'
    if "no markup" in text:
        raise TimeoutError("slow")
    titles = [line[2:] for line in text.splitlines() if line.startswith("# ")]
    if text.startswith("URL: https://void"):
        assert text == "URL: https://void/job/1\n"
        titles = ["Void"]
    return json.dumps({"vagas": [{"titulo": t, "empresa": "Acme", "localizacao": "", "origem": "", "salario": "",
                                  "requisitos": "Python", "link_inscricao": "apply"} for t in titles]})


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    listed = [p[1] for p in PAGES if "/job/" not in p[1]] + ["https://nowhere.net/", "https://www.board.com/list"]
    urls = spark.createDataFrame(list(enumerate(listed)), "line_no long, url string")
    sinks = [NoteTable(f"{folder}/notes", NOW), TicketOutbox(f"{folder}/outbox"), JobsTable(f"{folder}/jobs", NOW)]
    return run(spark, urls, pages, NOW, extractor, sinks, work_dir=f"{folder}/work", wait=(0.0, 0.0)), folder, urls, pages


def test_items(done):
    items = {r.titulo: r for r in done[0].items.collect()}
    assert set(items) == {f"Job {i}" for i in range(1, 7)} | {"Single", "Void"}
    job = items["Job 1"]
    assert (job.origem, job.link_inscricao, job.requisitos, job.source_url) == \
        ("Board", "https://www.board.com/apply", ["Python"], "https://www.board.com/list")
    assert items["Single"].origem == "Single" and (items["Job 6"].batch_no, items["Job 6"].pos) == (1, 0)


def test_counters_and_losses(done):
    counters = {r.source_url: r for r in done[0].counters.collect()}
    board = counters["https://www.board.com/list"]
    assert (board.n_links, board.n_batches, board.n_records, board.n_empty, board.n_invalid) == (7, 2, 6, 0, 0)
    assert counters["https://bad.net/"].n_invalid == 1 and (counters["https://plain.net/t"].n_failed, counters["https://plain.net/t"].n_empty) == (1, 0)
    dead = counters["https://dead.net/"]       # all pages gone: an empty text, still submitted
    assert (dead.n_batches, dead.n_links, dead.n_empty) == (1, 2, 1)
    lost = lost_details(done[0].listings, done[3]).collect()
    assert len([r for r in lost if r.url == "https://dead.net/"]) == 2
    assert sorted(r.url for r in done[0].dead_letters.collect()) == ["https://empty.net/", "https://nowhere.net/"]
    assert [r.url for r in done[0].quarantine.collect()] == ["https://bad.net/"]
    failed = done[0].replies.where("call_error is not null").collect()
    assert [(r.url, r.call_error) for r in failed] == [("https://plain.net/t", "TimeoutError: slow")]


def test_stores(spark, done):
    run_, folder, *_ = done
    assert [r.error for r in run_.status.collect()] == [None] * 3
    for store in ("jobs", "notes", "outbox"):
        assert spark.read.parquet(f"{folder}/{store}").count() == 8


def test_second_run_with_stored_keys_finds_nothing_new(spark, done):
    run_, _, urls, pages = done
    again = run(spark, urls, pages, NOW, extractor, stored=run_.items.select("item_key"))
    assert again.items.count() == 0


def test_a_second_run_over_the_same_pages_makes_no_call(spark, done, tmp_path):
    _, _, urls, pages = done
    urls = urls.where("url <> 'https://plain.net/t'")       # there the model fails
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(calls)

    def counting(system, text):
        import os
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return extractor(system, text)

    ledger = str(tmp_path / "ledger")
    first = run(spark, urls, pages, NOW, counting, ledger=ledger)
    made = len(list(calls.iterdir()))
    again = run(spark, urls, pages, NOW, counting, ledger=ledger)
    assert made > 0 and len(list(calls.iterdir())) == made
    assert sorted(r.titulo for r in again.items.collect()) == sorted(r.titulo for r in first.items.collect())


def test_what_the_run_has_seen(done):
    seen = done[0].seen
    assert seen["n_items"] == 8 and seen["n_records"] == 8 + seen["n_repeats"] + seen["n_blank"] and seen["n_stored"] == 0
    assert seen["n_known"] >= 0 and seen["n_suppressed"] == 0


def test_empty_list_still_resets_notes(spark, done, tmp_path):
    _, _, urls, pages = done
    notes = NoteTable(str(tmp_path / "notes"), NOW)
    spark.createDataFrame([("jobs", "p", "c")], "niche string, path string, content string").write.parquet(notes.path)
    run(spark, urls.limit(0), pages, NOW, extractor, [notes])
    assert spark.read.parquet(notes.path).count() == 0


def test_other_niche(spark):
    pages = spark.createDataFrame([(1, "http://shop/p", detail("GPU"))], "page_id long, url string, html string")
    urls = spark.createDataFrame([(1, "http://shop/p")], "line_no long, url string")
    found = run(spark, urls, pages, NOW, lambda system, text: '{"produtos": [{"produto": "GPU", "preco_vista": "1.5"}, {}]}',
                spec=HARDWARE, call_partitions=2).items.orderBy("pos").collect()
    assert [(r.produto, r.preco_vista, r.loja) for r in found] == \
        [("GPU", 1.5, "Loja não identificada"), ("Não informado", 0.0, "Loja não identificada")]


def test_command(spark, tmp_path, monkeypatch):
    from joblume.__main__ import main
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "urls.txt").write_text("# list\nhttps://www.board.com/list\n\nhttps://nowhere.net/\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "echo_titles.py").write_text(
        "def reply(system, text):\n"
        "    import json\n"
        "    return json.dumps({'vagas': [dict(titulo=l[2:], empresa='E', localizacao='', origem='', salario='', requisitos=[],\n"
        "        link_inscricao='') for l in text.splitlines() if l.startswith('# ')]})\n")
    import echo_titles
    cloudpickle.register_pickle_by_value(echo_titles)
    main(["--urls", str(tmp_path / "urls.txt"), "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out"),
          "--extractor", "echo_titles:reply", "--now", NOW, "--char-limit", "9000", "--batch-size", "2",
          "--rule", "titles=titulo <> 'Job 3'"])
    stored = spark.read.parquet(str(tmp_path / "out/jobs")).orderBy("id").collect()
    assert [r.id for r in stored] == [1, 2, 3, 4, 5] and "Job 3" not in {r.titulo for r in stored}
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "out/jobs-rejects")).collect()] == ["titles"]
    assert spark.read.parquet(str(tmp_path / "out/counters")).first().n_batches == 4
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out/dead_letters")).collect()] == ["https://nowhere.net/"]
