import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from joblume.llm import balanced_shards
from joblume.llm.balanced_shards import balance_shards, difference


def check(rows, got, shards):
    assert sorted(str(x.doc_id) for x in got) == sorted(str(r[0]) for r in rows)
    groups, slots, bytes_ = defaultdict(set), defaultdict(list), defaultdict(int)
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((x.size, x.text_crc32) for x in got) == want
    for x in got:
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < shards
        groups[x.size, x.text_crc32].add(x.shard)
        slots[x.shard].append(x.slot)
        bytes_[x.shard] += x.size
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [bytes_[s] for s in range(shards)]


@pytest.mark.parametrize("chunk", [7, 20_000])
def test_shards_are_even_and_groups_whole(documents, odd, monkeypatch, chunk):
    monkeypatch.setattr(balanced_shards, "CHUNK_GROUPS", chunk)
    monkeypatch.setattr(balanced_shards, "FAN_IN", 3)
    monkeypatch.setattr(balanced_shards, "ROWS_PER_RUN", 10)
    r = random.Random(6)
    rows = [(i, "t" * r.randrange(1, 400) + str(r.randrange(60))) for i in range(300)] + odd
    rows = [x for x in rows if len(x[1] or "") < 2000]
    sums = check(rows, balance_shards(documents(rows), 5).collect(), 5)
    assert max(sums) - min(sums) < 0.03 * sum(sums) / 5


def test_a_group_above_the_share_stays_whole(documents):
    rows = [(i, "same text " * 20) for i in range(50)] + [(100 + i, f"other {i}") for i in range(50)]
    sums = check(rows, balance_shards(documents(rows), 4).collect(), 4)
    assert max(sums) == 50 * 216 and max(sorted(sums)[:3]) - min(sums) <= 30


def test_empty_table(documents):
    assert balance_shards(documents([])).count() == 0


def test_differencing_beats_greedy_filling():
    r = np.random.default_rng(1)
    values = r.integers(1000, 100_000, 300)
    sums = np.zeros((300, 8), np.int64)
    sums[:, 0] = values
    ends, totals = difference(sums)
    placed = np.zeros(8, np.int64)
    np.add.at(placed, ends[:, 0], values)
    greedy = np.zeros(8, np.int64)
    for v in sorted(values.tolist(), reverse=True):
        greedy[greedy.argmin()] += v
    assert sorted(placed) == sorted(totals) and np.ptp(placed) < np.ptp(greedy)
