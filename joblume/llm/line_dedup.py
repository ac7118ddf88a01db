"""Line dedup: windows of three consecutive lines that occur earlier are taken out."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from joblume.llm.common import CUT_BYTES, mix, powers, window_hashes
from joblume.llm.first_seen import covered, cut_later_windows, intervals

LINES = 3
BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
BYTES_PER_LINE = 64.0
_KEYS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0xC2B2AE3D27D4EB4F


def _line_hashes(raw, offsets):
    """Hash of every line, blanks around it left out, and where each text's lines begin.

    A long text is gone through in pieces that end with a line.
    """
    first, hashes, start = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while start < len(raw):
        stop = min(start + CUT_BYTES, len(raw))
        while stop < len(raw) and raw[stop - 1] != 10:
            feed = np.flatnonzero(raw[stop:stop + CUT_BYTES] == 10)
            stop = stop + int(feed[0]) + 1 if len(feed) else min(stop + CUT_BYTES, len(raw))
        inside = offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, stop)]
        found, lines = _hash_piece(raw[start:stop], inside - start)
        first.append(found + start)
        hashes.append(lines)
        start = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(first), offsets)


def _hash_piece(raw, cuts):
    # a text without a last line break ends its last line at its end
    first = np.unique(np.concatenate([[0], cuts, np.flatnonzero(raw[:-1] == 10) + 1]))
    blank = (raw == 32) | (raw == 9) | (raw == 13) | (raw == 10)
    place = np.arange(len(raw))
    line = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(raw))))
    begin = np.minimum.reduceat(np.where(blank, len(raw), place), first)
    end = np.maximum.reduceat(np.where(blank, -1, place), first)
    inside = (place >= begin[line]) & (place <= end[line])
    keyed = np.where(inside, (_KEYS[raw] + np.uint64(1)) * powers(np.maximum(place - begin[line], 0), _BASE), np.uint64(0))
    sizes = np.maximum(end - begin + 1, 0).astype(np.uint64)
    return first, mix(np.add.reduceat(keyed, first) + mix(sizes))


def line_windows(length: int):
    def windows(raw, offsets):
        lines, begins = _line_hashes(raw, offsets)
        counts = np.maximum(np.diff(begins) - length + 1, 0)
        at = np.arange(int(counts.sum())) + np.repeat(begins[:-1] - (np.cumsum(counts) - counts), counts)
        return (window_hashes(lines, length, BASES[0])[at],
                mix(window_hashes(mix(lines ^ np.uint64(BASES[1])), length, BASES[1])[at]), counts)
    return windows


def split_lines(text: str) -> list[str]:
    """Lines as the windows count them: a break at the very end begins no further line."""
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _cut(length: int):
    def cut(text, starts):
        lines = split_lines(text)
        kept, spans = lines, []
        if starts is not None:
            gone = covered(starts, length, len(lines))
            spans, kept = intervals(gone), [x for x, g in zip(lines, gone.tolist(), strict=True) if not g]
        joined = "\n".join(kept)
        return len(lines), len(lines) - len(kept), hashlib.sha256(joined.encode()).hexdigest(), joined, spans
    return cut


def remove_repeated_lines(docs: DataFrame, length: int = LINES) -> DataFrame:
    """Removes each line that lies in a window of ``length`` lines which occurs earlier.

    Lines end at line feeds and are compared without blanks, tabs and carriage
    returns around them; a line of blanks alone is a line.  Returns doc_id,
    n_lines, n_removed, kept_sha256, kept_text (kept lines as they were, with
    line feeds between) and ``removed``, the merged intervals of line positions,
    one row per row of ``docs``.

    Earlier is a smaller doc_id, or a smaller start in the same document.  A
    null or empty text has no lines, one of fewer lines than a window keeps
    them; a doc_id of null counts as the largest; a repeated row gets the same
    result; different texts under one doc_id are not earlier than each other;
    an empty table gives an empty table; other columns are not read.
    """
    return cut_later_windows(docs, line_windows(length), BYTES_PER_LINE, _cut(length), "n_lines")
