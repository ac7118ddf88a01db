"""Periodic run detection: a sparse diagonal DP over each document's words.

A diagonal is a lag: word j matches on it if the word ``lag`` places earlier is
the same.  What is kept is one match length per open lag.  Each word's earlier
occurrences open lags and increment the open ones; a diagonal ends at the first
word that differs, and if it has matched long enough it emits its run at once.

Not every earlier occurrence opens a lag, or a frequent word would open one for
each place it has.  A match of 3q words at lag q passes three places that are
multiples of q, so only occurrences at multiples of their own lag can open it:
n/1 + n/2 + n/3 + ... comparisons, of which numpy finds those that count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import runs as regroup

REPEATS = 4  # a run has its period so often at least
SHORTEST = 6  # words of a run at least
BATCH_BYTES = 4 * 1024 * 1024
PLACES = 2_000_000  # multiples of lags that are looked at together
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_codes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = known.setdefault
    return np.fromiter((number(w, len(known)) for w in words), np.int64, len(words))


def _progressions(codes: np.ndarray, begins: np.ndarray, repeats: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, lag) of words at multiples of a lag that the words one, two, ... lags earlier are equal to.

    ``repeats`` equal words in steps of the lag, the last at ``place``; by text and place.
    """
    sizes = np.diff(begins)
    lags = sizes // repeats
    found = []
    text = np.repeat(np.arange(len(sizes)), lags)
    lag = np.arange(len(text)) - np.repeat(np.cumsum(lags) - lags, lags) + 1
    last = (sizes[text] - 1) // lag  # the largest multiple in the text
    count = last - (repeats - 1) + 1
    text, lag, count = text[count > 0], lag[count > 0], count[count > 0]
    cuts = np.searchsorted(np.cumsum(count), np.arange(PLACES, int(count.sum()) + PLACES, PLACES), side="left") + 1
    start = 0
    for stop in np.unique(np.minimum(cuts, len(count))).tolist():
        n = count[start:stop]
        step = np.repeat(lag[start:stop], n)
        times = np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n) + repeats - 1
        place = step * times
        at = place + np.repeat(begins[text[start:stop]], n)
        owner = np.repeat(text[start:stop], n)
        for _ in range(repeats - 1):
            same = codes[at] == codes[at - step]
            at, step, place, owner = at[same] - step[same], step[same], place[same], owner[same]
        found.append((owner, place, step))
        start = stop
    owner, place, step = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3
    order = np.lexsort((step, place, owner))
    return owner[order], place[order], step[order]


def _primitive(codes: np.ndarray, start: int, stop: int, period: int) -> bool:
    """Whether no divisor of the period is a period too; smaller periods of so long a run divide it."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            smaller = period // factor
            if np.array_equal(codes[start + smaller:stop], codes[start:stop - smaller]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def diagonal_runs(codes: np.ndarray, places: list[int], lags: list[int], repeats: int = REPEATS,
                  shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period, from the openings in order of place."""
    words = codes.tolist()
    n = len(words)
    found: list[tuple[int, int, int]] = []
    lengths: dict[int, int] = {}  # of the open lags: words matched up to ``at``
    at = -1
    opening = 0

    def end(lag: int, stop: int) -> None:
        length = lengths.pop(lag) + lag
        if length >= max(shortest, repeats * lag) and _primitive(codes, stop - length, stop, lag):
            found.append((stop - length, length, lag))

    while opening < len(places) or lengths:
        at = at + 1 if lengths else places[opening]
        if at == n:
            for lag in list(lengths):
                end(lag, n)
            break
        word = words[at]
        for lag in list(lengths):
            if words[at - lag] == word:
                lengths[lag] += 1
            else:
                end(lag, at)
        while opening < len(places) and places[opening] == at:
            lag = lags[opening]
            opening += 1
            if lag in lengths:
                continue
            # inside a run of a divisor this lag only repeats that run
            if any(lag % d == 0 and m >= lag for d, m in lengths.items()):
                continue
            first = at
            while first > lag and words[first - 1] == words[first - 1 - lag]:
                first -= 1
            if at - first >= (repeats - 2) * lag:  # else these places lie on no diagonal that is long enough
                lengths[lag] = at - first + 1
    found.sort(key=lambda run: (run[0], run[2]))
    return found


def _collapse(repeats: int, shortest: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()),
                                                     ("period", pa.int64())]))), ("kept_text", pa.string())])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in regroup(batches, BATCH_BYTES):
            known: dict[bytes, int] = {}
            texts = [text.encode().split() for text in rows["text"].to_pylist()]
            codes = [word_codes(words, known) for words in texts]
            begins = np.cumsum([0, *map(len, texts)])
            owner, place, lag = _progressions(np.concatenate([np.empty(0, np.int64), *codes]), begins, repeats)
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
            out = []
            for i, words in enumerate(texts):
                a, b = cuts[i], cuts[i + 1]
                found = diagonal_runs(codes[i], place[a:b].tolist(), lag[a:b].tolist(), repeats, shortest) if b > a else []
                kept = words
                if found:
                    gone = np.zeros(len(words), bool)
                    for start, length, period in found:
                        gone[start + period:start + length] = True
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), [dict(zip(("start", "length", "period"), run, strict=True)) for run in found],
                            b" ".join(kept).decode()))
            columns = [rows["doc_id"].combine_chunks(), *zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                                             schema=schema)
    return collapse


def collapse_runs(docs: DataFrame, repeats: int = REPEATS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period) and kept_text, one row per row of ``docs``.

    A run is a stretch of words of smallest period q, at least ``repeats`` (3 or
    more) times q and ``shortest`` long, that cannot be longer on either side.
    ``runs`` has all, by start, then period; they may overlap.  kept_text has
    the words, one blank between, that no run contains after its first q ones.

    A null, empty or blank text has no words, no runs, and keeps "".  A null
    doc_id stays null; a repeated row gives its result each time; an empty table
    gives an empty table; other columns are not read.  Nothing is shuffled: a
    text is read whole by one task, with a few hundred bytes of memory a word.
    """
    if repeats < 3:
        raise ValueError("a run has three periods at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(
        _collapse(repeats, shortest), f"doc_id long, n_words long, runs {RUNS}, kept_text string")
