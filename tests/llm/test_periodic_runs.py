import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from joblume.llm import periodic_runs
from joblume.llm.periodic_runs import collapse_runs
from joblume.llm.queries import op13_periodic_runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[:len(words) - q])


def brute_force(words, repeats=4, shortest=6):
    """All runs, by trying every period and every maximal stretch."""
    found, n = [], len(words)
    for q in range(1, n // repeats + 1):
        start = 0
        while start < n - q:
            stop = start + q
            while stop < n and words[stop] == words[stop - q]:
                stop += 1
            if stop - start >= max(shortest, repeats * q) and smallest_period(words[start:stop]) == q:
                found.append((start, stop - start, q))
            start = max(start + 1, stop - q + 1)
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def cases():
    r = random.Random(11)
    texts = ["a " * 40, "a b " * 20 + "c " * 9 + "a b " * 7, "x " + "a b c " * 4 + "a b d", "a a b " * 12 + "a a a a a a a",
             "a b a b a b a", "a b a b a b a b", "a a a a a", "a a a a a a", "p " + "a x y a x z " + "a x y " * 5 + "q"]
    for k in (1, 2, 3, 5):
        texts += [" ".join(r.choice("abcde"[:k]) for _ in range(r.randrange(120))) for _ in range(60)]
    for _ in range(60):  # periodic stretches with a flaw, side by side
        words = []
        for _ in range(r.randrange(1, 5)):
            unit = [r.choice("abc") for _ in range(r.randrange(1, 9))]
            words += unit * r.randrange(1, 8) + unit[:r.randrange(len(unit))]
            if r.random() < 0.3:
                words[r.randrange(len(words))] = "z"
        texts.append(" ".join(words))
    return texts


def found_in(documents, texts):
    got = {r.doc_id: r for r in collapse_runs(documents(list(enumerate(texts)))).collect()}
    return [[tuple(x) for x in got[i].runs] for i in range(len(texts))], [got[i].kept_text for i in range(len(texts))]


@pytest.mark.parametrize("places", [2_000_000, 50])
def test_runs_against_brute_force(documents, monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "PLACES", places)
    texts = cases()
    batch = [periodic_runs.word_codes(t.encode().split(), {}) for t in texts]
    owner, place, lag = periodic_runs._progressions(
        np.concatenate(batch), np.cumsum([0, *map(len, batch)]), 4)
    for i, t in enumerate(texts):
        own = owner == i
        got = periodic_runs.diagonal_runs(batch[i], place[own].tolist(), lag[own].tolist())
        assert got == brute_force(t.split()), t
    runs, kept = found_in(documents, texts)
    for t, r, k in zip(texts, runs, kept, strict=True):
        gone = {i for s, n, q in r for i in range(s + q, s + n)}
        assert r == brute_force(t.split()) and k.split() == [w for i, w in enumerate(t.split()) if i not in gone]


def test_a_long_text_of_one_word_or_one_pattern_is_quick(documents):
    texts = ["w " * 200_000, " ".join(f"p{i % 777}" for i in range(200_000)), "a b " * 60_000 + "c d e " * 60_000]
    runs, _ = found_in(documents, texts)
    assert runs == [[(0, 200_000, 1)], [(0, 200_000, 777)], [(0, 120_000, 2), (120_000, 180_000, 3)]]


def contract(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_force(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (str(doc_id), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_the_contract(spark, documents, odd, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(150)))) for i in range(300)]
    rows += [(300 + i, t) for i, t in enumerate(cases()[:120])] + [x for x in odd if x[0] != 6]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(((str(g[0]), *g[1:]) for g in got), key=str) == sorted((contract(*row) for row in rows), key=str)
    assert sum(g[1] > 0 for g in got) > 60


def test_empty_table(documents):
    assert collapse_runs(documents([])).count() == 0


def test_fewer_than_three_periods_are_refused(documents):
    with pytest.raises(ValueError):
        collapse_runs(documents([]), repeats=2)
