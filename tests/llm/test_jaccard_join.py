import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from joblume.llm import jaccard_join
from joblume.llm.components import components
from joblume.llm.jaccard_join import RareFirst, near_duplicate_classes, prefix_length

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(rows):
    keys = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    sets = {k: shingles(k[1]) for k in keys}
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(keys, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        k = (2**63 - 1 if i is None else i, t or "")
        root = find(k)[0]
        out.append((str(i), len(sets[k]), None if root == 2**63 - 1 else root))
    return sorted(out, key=str)


def test_shared_counts_against_sets(monkeypatch):
    monkeypatch.setattr(jaccard_join, "_COLUMNS", 7)
    r = np.random.default_rng(1)
    left, right = ([np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(n)] for n in (9, 12))
    for a, b in ((left, right), (left, left), (left, []), ([np.empty(0, np.uint64)], right)):
        got = jaccard_join.shared_counts(a, b)
        # what a set shares with itself is not asked for
        assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b) if x is not y)


def test_a_cell_of_many_short_sets_is_counted_in_slices(monkeypatch):
    monkeypatch.setattr(jaccard_join, "SLICE_COUNTS", 500)
    monkeypatch.setattr(jaccard_join, "DENSE_VALUES", 300)
    r = np.random.default_rng(3)
    sets = [np.setdiff1d(np.arange(16), r.integers(0, 16, r.integers(0, 12))).astype(np.uint64) + np.uint64(i % 5 * 9)
            for i in range(150)]
    sizes = []
    counted = jaccard_join.shared_slices
    monkeypatch.setattr(jaccard_join, "shared_slices", lambda *sides: (sizes.append(c.size) or (i, c) for i, c in counted(*sides)))
    for low, high in ((0, 0), (0, 1)):
        block = [i % (high + 1) for i in range(len(sets))]
        rows = pa.table({"sig": pa.array(range(len(sets))), "block": pa.array(block), "low": pa.array([low] * len(sets)),
                         "high": pa.array([high] * len(sets)), "shingles": pa.array([x.tobytes() for x in sets])})
        got = jaccard_join._link_cell(rows)
        parent = list(range(len(sets)))
        for i, j in combinations(range(len(sets)), 2):
            shared, total = len(np.intersect1d(sets[i], sets[j])), len(sets[i]) + len(sets[j])
            if (low == high or block[i] != block[j]) and 100 * shared >= 75 * (total - shared) and parent[i] != parent[j]:
                old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
                parent = [new if x == old else x for x in parent]
        assert dict(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == {
            i: x for i, x in enumerate(parent) if i != x} and got.num_rows > 20
    assert len(sizes) > 10 and max(sizes) <= 500


@pytest.mark.parametrize("long, cell", [(8, 2000), (3, 500)])
def test_a_large_group_that_no_centre_joins(documents, monkeypatch, long, cell):
    # copies with so many edits that most pairs are not similar, but chains of similar ones are there
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", cell)
    monkeypatch.setattr(jaccard_join, "STAR_ROUNDS", 1)
    r = random.Random(long)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(r.randrange(0, 4)):
            copy[r.randrange(60)] = r.choice([f"x{i}", f"y{r.randrange(5)}"])
        rows.append((i, " ".join(copy[r.randrange(8):60 - r.randrange(8)])))
    got = sorted(((str(x.doc_id), x.n_shingles, x.component_id)
                  for x in near_duplicate_classes(documents(rows)).collect()), key=str)
    assert got == brute_force(rows) and len({g[2] for g in got}) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, odd, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "LONG", 5 * seed)
    monkeypatch.setattr(jaccard_join, "CELL_BYTES", 1000)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 100)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    monkeypatch.setattr(jaccard_join, "OFTEN", 2 + 2 * seed)
    r = random.Random(seed)
    rows, ids = list(odd), iter(r.sample(range(100, 1000), 200))
    passage = [f"p{i}" for i in range(40)]
    for _ in range(10):
        base = [f"w{r.randrange(500)}" for _ in range(r.randrange(3, 60))]
        if r.random() < 0.4:
            base = passage + base
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.randrange(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(["X", "y", f"z{r.randrange(9)}"])
            if r.random() < 0.3:
                copy = copy[r.randrange(4):]
            rows.append((next(ids), " ".join(copy)))
    got = sorted(((str(x.doc_id), x.n_shingles, x.component_id)
                  for x in near_duplicate_classes(documents(rows)).collect()), key=str)
    assert got == brute_force(rows)


def test_empty_table(documents):
    assert near_duplicate_classes(documents([])).count() == 0


def test_copies_in_several_batches_are_one_entry():
    # one node in three batches, and with another one at shingle 7; 9 is a frequent shingle
    def packed(*entries):
        return jaccard_join._pack(np.array(list(entries), jaccard_join._ENTRY))
    rest = [packed((5, 1, 8, 0), (7, 1, 8, 1))] * 3 + [packed((7, 2, 8, 0))]
    often = [packed((9, 1, 8, 2))] * 3
    rows = pa.table({"frequent": [False] * 4 + [True] * 3, "entries": pa.array(rest + often, pa.binary())})
    found = jaccard_join._shared_lists(rows)
    assert sorted(zip(found["shingle"].to_pylist(), found["sig"].to_pylist())) == [(7, 1), (7, 2), (9, 1)]


def test_similar_sets_share_a_prefix_in_any_order():
    r = np.random.default_rng(2)
    pool = np.sort(r.integers(0, 2**63, 300, dtype=np.uint64))
    order = RareFirst(pool[::3], r.integers(1, 9, 100))
    found = 0
    for _ in range(300):
        a = r.choice(pool, 40, replace=False)
        b = np.concatenate([a[:35], r.choice(pool, 5)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 4 * both >= 3 * (len(a) + len(b) - both):
            found += 1
            assert len(np.intersect1d(order.prefix(a)[0], order.prefix(b)[0]))
    assert found > 50 and prefix_length(1) == 1 and prefix_length(4) == 3 and prefix_length(8) == 5


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)],
                                   [(i, i + 1) for i in range(40)] + [(100, 70), (70, 101)]])
def test_components(spark, edges):
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    expected = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                expected[a] = expected[b] = min(expected[a], expected[b])
    assert got == expected


def test_texts_of_one_crc_under_a_null_id_are_two_documents(documents):
    import zlib
    seen, pair, r = {}, None, random.Random(0)
    while pair is None:
        text = " ".join(f"{r.randrange(10**6)}" for _ in range(25))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        pair = (other, text) if other != text else None
    rows = [(None, pair[0]), (None, pair[1])]
    assert near_duplicate_classes(documents(rows)).count() == 2
    import corpus_pipeline as cp
    assert sorted(x.text for x in cp.near_duplicates(None, documents(rows), "").collect()) == sorted(pair)


def _peak(job):
    """MB that numpy held at most while ``job`` ran, besides what was there."""
    import tracemalloc
    tracemalloc.start()
    try:
        out = job()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_bucket_is_settled_within_little_more_than_its_entries():
    r = np.random.default_rng(3)
    entries = np.zeros(400_000, jaccard_join._ENTRY)
    entries["shingle"], entries["sig"] = r.integers(0, 2**64, len(entries), np.uint64), r.integers(0, 2**62, len(entries))
    entries["shingle"][:100] = entries["shingle"][100:200]
    packs = [jaccard_join._pack(x) for x in np.array_split(entries, 20)]
    rows = pa.table({"frequent": [False] * 20, "entries": pa.array(packs, pa.binary())})
    found, peak = _peak(lambda: jaccard_join._shared_lists(rows))
    assert found.num_rows == 200
    assert peak < 2 * entries.nbytes / 1e6


def test_a_batch_is_surveyed_and_packed_within_a_few_times_its_sets():
    r = random.Random(4)
    text = [" ".join(f"{r.randrange(10**6)}" for _ in range(500)) for _ in range(1200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text)))] * 3 + [pa.array(text)], ["_id", "_tag", "_tag2", "text"])
    mb = len(text) * 496 * 8 / 1e6
    out, peak = _peak(lambda: sum(x.num_rows for x in jaccard_join._survey(5)(iter([batch]))))
    assert out == len(text) and peak < 4 * mb

    class Shared:
        value = np.empty(0, np.uint64), np.empty(0, np.int64)
    out, peak = _peak(lambda: sum(x.num_rows for x in jaccard_join._postings(5, 8, Shared)(iter([batch]))))
    assert out == 8 and peak < 5 * mb


def test_frequent_shingles_are_counted_exactly():
    r = np.random.default_rng(5)
    for sizes in ((), (0,), (1,), (2, 1), (40,) * 30):
        sets = [np.unique(r.integers(0, 60, n).astype(np.uint64)) for n in sizes]
        values, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
        some = counts >= jaccard_join.OFTEN
        got = jaccard_join._frequent(sets)
        assert got[0].tolist() == values[some].tolist() and got[1].tolist() == counts[some].tolist()
