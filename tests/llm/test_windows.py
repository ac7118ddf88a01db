import hashlib
import random
import re

import numpy as np
import pytest

from joblume.llm import first_seen
from joblume.llm.common import hash_words, window_hashes
from joblume.llm.line_dedup import remove_repeated_lines, split_lines
from joblume.llm.substring_dedup import remove_repeated_substrings


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(first_seen, "BUCKET_WINDOWS", 300)
    monkeypatch.setattr(first_seen, "GROUP_BYTES", 2000)


def brute_force(rows, split, length, joiner, norm=lambda x: x):
    """By (id, text): a window goes if its sequence starts earlier in a document of smaller id, or in its own."""
    documents = sorted({(2**63 - 1 if i is None else i, t or "") for i, t in rows})
    firsts, per = {}, {}
    for i, t in documents:
        units = [norm(x) for x in split(t)]
        own = {}
        for s in range(len(units) - length + 1):
            own.setdefault(tuple(units[s:s + length]), s)
        per[i, t] = (units, own)
        for window in own:
            firsts[window] = min(firsts.get(window, i), i)
    out = {}
    for (i, t), (units, own) in per.items():
        gone = [False] * len(units)
        for s in range(len(units) - length + 1):
            window = tuple(units[s:s + length])
            if firsts[window] < i or own[window] < s:
                gone[s:s + length] = [True] * length
        kept = [x for x, g in zip(split(t), gone, strict=True) if not g]
        out[i, t] = (len(units), sum(gone), hashlib.sha256(joiner.join(kept).encode()).hexdigest())
    return sorted((str(i), *out[2**63 - 1 if i is None else i, t or ""]) for i, t in rows)


def result(frame, size):
    return sorted((str(r.doc_id), r[size], r.n_removed, r.kept_sha256) for r in
                  frame.select("doc_id", size, "n_removed", "kept_sha256").collect())


def corpus():
    r = random.Random(3)
    passages = [[f"p{k}_{j}" for j in range(r.randrange(18, 70))] for k in range(6)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts += r.choice(passages) if r.random() < 0.4 else [f"w{r.randrange(400)}" for _ in range(r.randrange(40))]
        rows.append((r.randrange(200), r.choice([" ", "\n", "  "]).join(parts)))
    return rows


def test_substrings_against_brute_force(documents, odd):
    rows = corpus() + odd
    got = result(remove_repeated_substrings(documents(rows)), "n_words")
    assert got == brute_force(rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20, " ")


def test_removed_intervals_are_maximal(documents):
    text = " ".join(f"a{i}" for i in range(30))
    got = remove_repeated_substrings(documents([(1, text), (2, "x " + text + " y")])).orderBy("doc_id").collect()
    assert [(x.start, x.stop) for x in got[1].removed] == [(1, 31)] and got[1].kept_text == "x y"
    assert got[0].removed == []


def test_lines_against_brute_force(documents, odd):
    r = random.Random(5)
    rows = [(i, "\n".join(r.choice(["alpha", " alpha", "beta", "", "g\r", f"u{r.randrange(30)}"])
                          for _ in range(r.randrange(14)))) for i in range(80)] + odd
    got = result(remove_repeated_lines(documents(rows)), "n_lines")
    assert got == brute_force(rows, split_lines, 3, "\n", lambda x: x.strip(" \t\r\n"))


def test_empty_tables(documents):
    assert remove_repeated_substrings(documents([])).count() == 0
    assert remove_repeated_lines(documents([])).count() == 0


@pytest.mark.parametrize("length", [1, 3, 5, 8, 20])
def test_window_hash_is_the_polynomial(length):
    words = np.random.default_rng(1).integers(0, 2**63, 50, dtype=np.uint64)
    got = window_hashes(words, length, 12345)
    for i in range(50 - length + 1):
        assert int(got[i]) == sum(int(words[i + j]) * pow(12345, j, 2**64) for j in range(length)) % 2**64


def test_a_word_hashes_alike_wherever_it_stands():
    raw = b"one two  one\ttwoone two"
    hashes, begins = hash_words(np.frombuffer(raw, np.uint8), np.array([0, 17, len(raw)]))
    # texts "one two  one\ttwo" + "o" is cut at 17: the word at the cut is two words
    assert hashes[0] == hashes[2] and begins.tolist()[0] == 0 and len(hashes) == begins[-1]


@pytest.mark.parametrize("values", [[], [0], [254, 255, 256, 1000, 0, 510]])
def test_gaps_come_back(values):
    packed = first_seen.gaps_to_bytes(np.array(values, np.int64))
    assert first_seen.gaps_from_bytes(packed).tolist() == values


def test_documents_of_one_id_are_told_apart_by_more_than_a_crc(documents):
    # two texts of one CRC-32, found by trying words
    import zlib
    seen, pair = {}, None
    r = random.Random(0)
    while pair is None:
        text = " ".join(f"{r.randrange(10**6)}" for _ in range(25))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        pair = (other, text) if other != text else None
    rows = [(None, pair[0]), (None, pair[1]), (None, pair[0] + " tail " + pair[0])]
    assert result(remove_repeated_substrings(documents(rows)), "n_words") == brute_force(
        rows, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t), 20, " ")


def test_long_words_and_lines_that_differ_far_apart(documents):
    long = ["x" + "a" * 65_535 + "y", "y" + "a" * 65_535 + "x", "x" + "a" * 65_535 + "x"]
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{lead} {w}") for i, w in enumerate(long)]
    assert [r[2] for r in result(remove_repeated_substrings(documents(rows)), "n_words")] == [0, 0, 0]
    rows = [(i, f"one\ntwo\n{w}") for i, w in enumerate(long)]
    assert [r[2] for r in result(remove_repeated_lines(documents(rows)), "n_lines")] == [0, 0, 0]


@pytest.mark.parametrize("piece", [5, 64, 1 << 22])
def test_hashes_do_not_depend_on_the_pieces(monkeypatch, piece):
    from joblume.llm import common, line_dedup
    monkeypatch.setattr(common, "CUT_BYTES", piece)
    monkeypatch.setattr(line_dedup, "CUT_BYTES", piece)
    r = random.Random(8)
    texts = [bytes(r.choice(b"  ab\n\r") for _ in range(r.randrange(50))) for _ in range(100)] + [b"w" * 300, b""]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for hashes, begins, units in (
            (*hash_words(raw, offsets), [t.split() for t in texts]),
            (*line_dedup._line_hashes(raw, offsets), [[x.strip(b" \r") for x in t.split(b"\n")][:-1 if t[-1:] in (b"", b"\n") else None]
                                                      for t in texts])):
        assert np.diff(begins).tolist() == [len(u) for u in units]
        known = {}
        for unit, value in zip([u for us in units for u in us], hashes.tolist(), strict=True):
            assert known.setdefault(unit, value) == value
        assert len(set(known.values())) == len(known)


def test_a_text_of_fifty_megabytes_keeps_memory_flat():
    import tracemalloc
    raw = np.frombuffer(b"some words of a long text and 1 " * 1_600_000, np.uint8)
    tracemalloc.start()
    words, begins = hash_words(raw, np.array([0, len(raw)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(words) == begins[1] == 8 * 1_600_000 and peak < 700e6
