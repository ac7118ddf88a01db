"""What the corpus operators share: words, word hashes, landed tables, columns that cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.session import scratch_path

# Words are runs of anything but these ASCII blanks; bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = 2**63 - 1  # stands in for a doc_id that is null, and so orders it last

_rng = np.random.Generator(np.random.PCG64(20240115))
_BYTE_KEYS = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE_KEYS[_IS_BLANK] = 0
BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16
_POWERS: dict[int, np.ndarray] = {}
CUT_BYTES = 4 * 1024 * 1024  # a longer buffer is hashed in pieces, cut at blanks
# what tells documents apart: a doc_id, and two independent 64-bit hashes of the text
KEY = ["_id", "_tag", "_tag2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def land(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written below the shared checkpoint folder and read back: lineage ends here."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Spark hands tasks ``rows`` rows at a time at most from now on: whole texts of 10,000 rows are large."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def identified(docs: DataFrame, *extra: Column) -> DataFrame:
    """(_id, _tag, _tag2, text): the key of a document and its text, null as "".

    A document is a doc_id with a text: rows that repeat both are one document,
    rows that share the doc_id alone are told apart by two 64-bit hashes of the
    text.  The first one has the doc_id in it, so that it spreads copies too.
    """
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(id_.alias("_id"), F.xxhash64(id_, text).alias("_tag"),
                       F.xxhash64(F.lit(BASE >> 2), text).alias("_tag2"), text.alias("text"), *extra)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls, not copied."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0]:ends[-1]] if len(ends) else raw, ends - (ends[0] if len(ends) else 0)


def powers(places: np.ndarray, base: int = BASE) -> np.ndarray:
    """``base`` to the power of each place, modulo 2^64: never the same twice in a row of 2^62."""
    if base not in _POWERS:
        _POWERS[base] = np.multiply.accumulate(np.full(_BLOCK, base, np.uint64))
    low = _POWERS[base][places & (_BLOCK - 1)]
    blocks = int(places.max(initial=0)) >> 16
    if not blocks:
        return low
    high = np.array([pow(base, _BLOCK * k, 2**64) for k in range(blocks + 1)], np.uint64)
    return low * high[places >> 16]


def hash_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts that lie one behind the other, and where each text's words begin.

    A word's hash is the sum of its bytes' keys times powers of a base, and its
    length, mixed: equal for equal words, whatever stands around them.  A long
    text is gone through in pieces, so that memory follows the words and not
    the bytes; a word is never cut.
    """
    first, hashes, start = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    while start < len(raw):
        stop = min(start + CUT_BYTES, len(raw))
        while stop < len(raw):  # up to the next blank
            blank = np.flatnonzero(_IS_BLANK[raw[stop:stop + CUT_BYTES]])
            if len(blank):
                stop += int(blank[0])
                break
            stop = min(stop + CUT_BYTES, len(raw))
        inside = offsets[np.searchsorted(offsets, start):np.searchsorted(offsets, stop)]
        found, words = _hash_piece(raw[start:stop], inside - start)
        first.append(found + start)
        hashes.append(words)
        start = stop
    return np.concatenate(hashes), np.searchsorted(np.concatenate(first), offsets)


def _hash_piece(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where words begin, their hashes); a word ends at a cut between texts too."""
    solid = ~_IS_BLANK[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[cuts] = solid[cuts]
    first = np.flatnonzero(begins)
    if not len(first):
        return first, np.empty(0, np.uint64)
    place = np.arange(len(raw))
    place[:first[0]] = 0
    place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(raw))))
    keyed = _BYTE_KEYS[raw] * powers(place)
    lengths = np.add.reduceat(solid, first, dtype=np.int64).astype(np.uint64)
    return first, mix(np.add.reduceat(keyed, first) + mix(lengths))


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of each ``length`` consecutive values.

    H(i) = sum of w(i+j) * base^j, put together from windows of 1, 2, 4, ...
    values, so that a whole batch takes a few vector operations.
    """
    if len(words) < length:
        return np.empty(0, np.uint64)
    power = lambda n: np.uint64(pow(base, n, 2**64))
    total, done, part, width = None, 0, words, 1
    while True:
        if length & width:
            size = len(words) - done - width + 1
            moved = part[done:done + size]
            total = moved.copy() if total is None else total[:size] + moved * power(done)
            done += width
        if done == length:
            return total
        part, width = part[:-width] + part[width:] * power(width), width * 2


def runs(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Rows regrouped into tables of about ``most_bytes`` of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
            if len(column) else np.zeros(1, np.int64)
        start = 0
        while start < batch.num_rows:
            room = max(most_bytes - size, 1)
            stop = int(np.searchsorted(ends, ends[start] + room, side="right")) - 1
            stop = min(max(stop, start + (not held)), batch.num_rows)
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop] - ends[start])
            if stop < batch.num_rows or size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            start = stop
    if held:
        yield pa.Table.from_batches(held)
