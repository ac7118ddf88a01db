"""The stages on a small corpus, each against what it must do to its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def corpus(spark, documents, odd, tmp_path_factory):
    r = random.Random(9)

    def prose(n):
        return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"{r.choice('bdkmt')}{r.choice('aeiou')}" * 2
                        + r.choice(["ing", "ed", "ly", ""]) + r.choice("abcdefgh") * r.randrange(3) for _ in range(n))

    items = [(i, prose(30)) for i in range(5)]
    rows = [(100 + i, prose(r.randrange(30, 120)), "en", f"s{i % 3}") for i in range(60)]
    leaked = {100, 110, 120}
    rows = [(i, t + " " + items[i % 5][1] if i in leaked else t, lang, s) for i, t, lang, s in rows]
    copies = [(200 + k, rows[20][1] + " end" * (k % 2), "en", "s0") for k in range(10)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    all_rows = rows + copies + odd + [rows[30]]
    documents(all_rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, all_rows, leaked


def test_every_stage(spark, corpus):
    folder, rows, leaked = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, folder)
        if name != "sharding":
            assert out.columns == docs.columns
        docs = cp.land(out, name)
        kept[name] = Counter(str(x.doc_id) for x in docs.collect())
    clean = {str(i) for i in range(100, 160)}
    assert clean <= set(kept["language_id"]) and kept["language_id"]["130"] == 2
    assert {"1", "2", "3", "9", "11"} & set(kept["language_id"]) == set()
    near = kept["near_duplicates"]
    assert {str(200 + k) for k in range(10)} & set(near) == set() and clean <= set(near) and near["130"] == 1
    assert clean - set(kept["decontamination"]) == {str(i) for i in leaked}
    assert all(n <= 2 * kept["decontamination"][i] for i, n in kept["source_mix"].items()) and kept["source_mix"].total() > 60
    assert kept["sharding"] == kept["source_mix"]


def test_run_gives_the_last_stage(spark, corpus):
    out = cp.run(spark, corpus[0])
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 0


def test_the_mix_takes_whole_rows_by_their_share(spark, documents):
    rows = [(i, "w " * 10, None, "a" if i < 30 else "b") for i in range(60)] + [(0, "w " * 10, None, "a")] * 2
    out = cp.mix(spark, documents(rows), "")
    counts = Counter((x.doc_id, x.source) for x in out.collect())
    # of 620 words the first source weighs 3 of 4 and stops at twice its 320, the second takes the rest
    assert sum(n for (_, s), n in counts.items() if s == "a") == 64
    assert sum(n for (_, s), n in counts.items() if s == "b") == 29
    assert counts[0, "a"] == 6


def test_empty_tables(spark, documents, corpus):
    for _, stage in cp.STAGES:
        assert stage(spark, documents([]), corpus[0]).count() == 0
