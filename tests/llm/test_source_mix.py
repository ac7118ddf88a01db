import random
from collections import Counter, defaultdict

import pytest

from joblume.llm.source_mix import mix_sources, source_targets, split_quotas


def water_fill(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, fixed = set(names), {}
    budget = share * sum(sizes.values())
    while free:
        level = (budget - sum(fixed.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            break
        fixed |= {s: most * sizes[s] for s in over}
        free -= over
    return {s: fixed.get(s, level * weight[s]) for s in names}


def rows_of(seed, n=300):
    r = random.Random(seed)
    sources = ["b", "a", "é", "Z", None, "empty", "big"]
    rows = []
    for i in range(n):
        source = "big" if r.random() < 0.4 else r.choice(sources)
        words = 0 if source == "empty" else r.choice([0, 1, 5, 40, 200])
        rows.append((i, "x y\t" * (words // 2) + "z" * (words % 2), None, source))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_what_is_taken(documents, odd, seed):
    rows = rows_of(seed) + [(*x, None, "odd") for x in odd]
    got = mix_sources(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    targets = water_fill(sizes, (3, 1, 2), 1.5, 2)
    taken = Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(targets[x.source])
        assert 0 <= x.taken <= 2 * x.size and x.taken == sum(d.words for d in x.draws)
        assert abs(x.copies * x.size - x.taken) <= x.size / 2
        taken[x.source] += x.taken
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    again = sorted(map(str, mix_sources(documents(rows)).collect()))
    assert again == sorted(map(str, got))


def test_output_shards_get_disjoint_draws(documents):
    got = mix_sources(documents(rows_of(3)), shards=4).collect()
    per_shard = Counter()
    for x in got:
        assert len({(d["pass"],) for d in x.draws}) == len(x.draws)
        for d in x.draws:
            per_shard[d.shard] += d.words
    assert set(per_shard) == {0, 1, 2, 3}


def test_the_tree_keeps_quotas_and_halves(spark):
    quotas = {"a": 100, "b": 7, "c": 0, "d": 1}
    frame = spark.createDataFrame(list(quotas.items()), "_source string, quota long")
    dealt, shards = defaultdict(Counter), 8
    for x in split_quotas(frame, shards).collect():
        dealt[x.shard][x._source] += x.quota
    assert {s: sum(d[s] for d in dealt.values()) for s in quotas} == quotas
    totals = [sum(dealt[s].values()) for s in range(shards)]
    assert max(totals) - min(totals) <= 1


def test_hypergeometric_mean(spark):
    # over many nodes of one kind the draws must average to the share
    frame = spark.createDataFrame([(f"s{i:03}", 4) for i in range(200)], "_source string, quota long")
    got = Counter(x.quota for x in split_quotas(frame, 2).where("shard = 0").collect())
    assert sum(q * n for q, n in got.items()) == 400 and len(got) == 5


def test_empty_and_wordless(documents):
    assert mix_sources(documents([])).count() == 0
    assert [(x.taken, x.target) for x in mix_sources(documents([(1, None), (2, " ")])).collect()] == [(0, 0.0)] * 2


def test_targets_of_one_source(spark):
    frame = spark.createDataFrame([("a", 10), ("a", 30)], "_source string, size long")
    assert source_targets(frame).select("source_size", "target").collect() == [(40, 60.0)]
