"""Substring dedup: Rabin-Karp hashes of every 20-word window, counted over the corpus."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from joblume.llm.common import hash_words, mix, window_hashes
from joblume.llm.first_seen import covered, cut_later_windows, intervals

WINDOW = 20
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
BYTES_PER_WORD = 6.0


def word_windows(length: int):
    """All windows of ``length`` words, in texts that lie one behind the other."""
    def windows(raw, offsets):
        words, begins = hash_words(raw, offsets)
        counts = np.maximum(np.diff(begins) - length + 1, 0)
        at = np.arange(int(counts.sum())) + np.repeat(begins[:-1] - (np.cumsum(counts) - counts), counts)
        return (window_hashes(words, length, BASES[0])[at],
                mix(window_hashes(mix(words ^ np.uint64(BASES[1])), length, BASES[1])[at]), counts)
    return windows


def _cut(length: int):
    def cut(text, starts):
        words = text.encode().split()
        kept, spans = words, []
        if starts is not None:
            gone = covered(starts, length, len(words))
            spans, kept = intervals(gone), [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(kept)
        return (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode(), spans)
    return cut


def remove_repeated_substrings(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """Removes each word that lies in a ``length``-word window which occurs earlier.

    Returns doc_id, n_words, n_removed, kept_sha256, kept_text (kept words with
    one blank between) and ``removed``, the maximal intervals of word positions
    taken out, one row per row of ``docs``.

    Earlier is a smaller doc_id, or a smaller start in the same document; the
    windows are those of the input.  A null or empty text has no words; a
    doc_id of null counts as the largest; a row that repeats doc_id and text is
    the same document again and gets the same result; rows that share a doc_id
    but not a text are not earlier than each other.  An empty table gives an
    empty table, other columns are not read.  Windows are equal if 64 bits of
    hash and the bucket, from an independent hash, are.
    """
    return cut_later_windows(docs, word_windows(length), BYTES_PER_WORD, _cut(length), "n_words")
