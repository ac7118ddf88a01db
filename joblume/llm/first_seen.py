"""Which windows of a corpus repeat an earlier one, with about ten bytes a window shuffled.

A window is known by a 64-bit hash and by the bucket that an independent hash
puts it in.  Map tasks settle what repeats within a batch, so that a window of a
third of all documents reaches its bucket once per batch; buckets, whose number
follows the bytes of the input, settle the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import KEY, identified, runs, text_buffer

BATCH_BYTES = 8 * 1024 * 1024  # text that a task looks at together
CHUNK_BYTES = 1024 * 1024  # text whose bytes are hashed together
GROUP_BYTES = 8 * 1024 * 1024  # text that a task cuts together
BUCKET_WINDOWS = 2_500_000  # windows of a bucket, about
PACKED = "bucket int, settled boolean, notes binary, hashes binary"
MARKS = "_group int, notes binary"

# (bytes, offsets) of texts to (hashes, second hashes, number of windows of each text)
Windows = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def gaps_to_bytes(values: np.ndarray) -> bytes:
    """Non-negative integers, a byte each and one more for every full 255."""
    full, rest = np.divmod(values, 255)
    out = np.full(int(full.sum()) + len(values), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = rest
    return out.tobytes()


def gaps_from_bytes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    sums = np.cumsum(raw, dtype=np.int64)[raw < 255]
    return np.diff(sums, prepend=0)


def _gaps(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    gaps = np.diff(starts, prepend=0)
    new = np.flatnonzero(np.diff(docs, prepend=-1))
    gaps[new] = starts[new]
    return gaps


def _pack(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> bytes:
    """Keys (a column per document) and starts of windows that are ordered by document and start."""
    new = np.flatnonzero(np.diff(docs, prepend=-1))
    counts = np.diff(np.append(new, len(docs)))
    gaps = gaps_to_bytes(_gaps(docs, starts))
    head = np.array([len(new)], np.int64).tobytes()
    return pa.compress(head + np.ascontiguousarray(keys[:, docs[new]]).tobytes() + counts.astype(np.uint32).tobytes()
                       + gaps, codec="zstd", asbytes=True) \
        + np.array([8 + (8 * len(KEY) + 4) * len(new) + len(gaps)], np.int64).tobytes()


def _unpack(notes: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, number of windows) of documents, and the windows' starts."""
    size = int(np.frombuffer(notes[-8:], np.int64)[0])
    data = pa.decompress(notes[:-8], decompressed_size=size, codec="zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    keys = np.frombuffer(data, np.int64, len(KEY) * n, 8).reshape(len(KEY), n)
    counts = np.frombuffer(data, np.uint32, n, 8 + 8 * len(KEY) * n).astype(np.int64)
    return keys, counts, _starts(gaps_from_bytes(data[8 + (8 * len(KEY) + 4) * n:]), counts)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, which of them each column of ``keys`` is)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return keys[:, order[new]], rank


def _starts(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    return sums - np.repeat(sums[first] - gaps[first], counts)


def _map_side(windows: Windows, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("notes", pa.binary()),
                        ("hashes", pa.binary())])

    def map_batches(batches):
        for rows in runs(batches, BATCH_BYTES):
            rows = rows.sort_by([(c, "ascending") for c in KEY]).combine_chunks()
            keys = np.stack([rows[c].to_numpy() for c in KEY])
            ids = keys[0]
            found = [windows(*text_buffer(part.column(part.schema.get_field_index("text"))))
                     for chunk in runs(rows.to_batches(), CHUNK_BYTES) for part in chunk.to_batches()]
            hashes, second, counts = (np.concatenate(x) for x in zip(*found, strict=True))
            again = np.zeros(len(ids), bool)  # a repeated row is the same document
            again[1:] = (keys[:, 1:] == keys[:, :-1]).all(axis=0)
            docs = np.repeat(np.arange(len(ids)), counts)
            starts = np.arange(len(docs)) - np.repeat(np.cumsum(counts) - counts, counts)
            kept = ~again[docs]
            hashes, second, docs, starts = hashes[kept], second[kept], docs[kept], starts[kept]
            bucket = (second % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(hashes, kind="stable")
            later = np.zeros(len(docs), bool)
            same = (hashes[order[1:]] == hashes[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
            # rows that share a doc_id have no order: a window of the first one settles nothing for the next
            lead = np.zeros(len(order), np.int64)
            lead[1:] = np.where(same, 0, np.arange(1, len(order)))
            lead = order[np.maximum.accumulate(lead)] if len(order) else order
            later[order] = (lead != order) & ((ids[docs[lead]] < ids[docs[order]]) | (docs[lead] == docs[order]))
            out = []
            if later.any():
                out.append((int(keys[1, 0] % buckets), True, _pack(keys, docs[later], starts[later]), None))
            fresh = np.flatnonzero(~later)
            fresh = fresh[np.argsort(bucket[fresh], kind="stable")]
            cuts = np.searchsorted(bucket[fresh], np.arange(buckets + 1))
            for number in np.flatnonzero(np.diff(cuts)):
                part = fresh[cuts[number]:cuts[number + 1]]
                out.append((int(number), False, _pack(keys, docs[part], starts[part]), hashes[part].tobytes()))
            for at in range(0, len(out), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind.type) for column, kind in
                     zip(zip(*out[at:at + 512], strict=True), schema, strict=True)], schema=schema)
    return map_batches


def _settle(groups: int) -> Callable[[pa.Table], pa.Table]:
    return lambda rows: _settle_bucket(rows, groups)


def _settle_bucket(rows: pa.Table, groups: int) -> pa.Table:
    """The windows of one bucket that are not the first of their hash, by the group of their document."""
    keys, docs, starts, hashes, settled = [], [], [], [], []
    n = 0
    for done, notes, packed in zip(rows["settled"].to_pylist(), rows["notes"], rows["hashes"], strict=True):
        key, counts, start = _unpack(notes.as_py())
        keys.append(key)
        docs.append(np.repeat(np.arange(n, n + len(counts), dtype=np.int32), counts))
        n += len(counts)
        starts.append(start.astype(np.int32))
        settled.append(np.full(len(start), done))
        hashes.append(np.zeros(len(start), np.uint64) if done else np.frombuffer(packed.as_py(), np.uint64))
    keys, rank = _ranked(np.concatenate(keys, axis=1))
    docs, starts, settled, h = (np.concatenate(x) for x in (docs, starts, settled, hashes))
    del hashes
    docs = rank[docs].astype(np.int32)
    open_ = np.flatnonzero(~settled)
    order = open_[np.argsort(h[open_], kind="stable")]
    twin = np.zeros(len(order), bool)
    twin[1:] = h[order[1:]] == h[order[:-1]]
    member = twin.copy()
    member[:-1] |= twin[1:]
    order = order[member]
    order = order[np.lexsort((starts[order], docs[order], h[order]))]
    h, d, s = h[order], docs[order], starts[order]
    same = h[1:] == h[:-1]
    lead = np.zeros(len(h), np.int64)
    lead[1:] = np.where(same, 0, np.arange(1, len(h)))
    lead = np.maximum.accumulate(lead)
    own = np.zeros(len(h), np.int64)  # the first of the same document and hash
    own[1:] = np.where(same & (d[1:] == d[:-1]), 0, np.arange(1, len(h)))
    own = np.maximum.accumulate(own)
    ids = keys[0]
    later = (ids[d[lead]] < ids[d]) | (s[own] < s)
    d, s = np.concatenate([docs[settled], d[later]]), np.concatenate([starts[settled], s[later]])
    group = keys[1] % groups
    order = np.lexsort((s, d, group[d]))
    d, s = d[order], s[order].astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(group[d], prepend=-1)), len(d))
    packed = [_pack(keys, d[a:b], s[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.table({"_group": pa.array(group[d[cuts[:-1]]], pa.int32()), "notes": pa.array(packed, pa.binary())})


def _merge(notes: pa.ChunkedArray) -> dict[tuple[int, ...], np.ndarray]:
    """Starts by document."""
    found = []
    for packed in notes:
        keys, counts, starts = _unpack(packed.as_py())
        found.append((keys, counts, starts))
    if not found:
        return {}
    keys, rank = _ranked(np.concatenate([k for k, _, _ in found], axis=1))
    docs = np.repeat(rank, np.concatenate([c for _, c, _ in found]))
    order = np.argsort(docs, kind="stable")
    first = np.flatnonzero(np.diff(docs[order], prepend=-1))
    starts = np.concatenate([s for _, _, s in found])[order]
    return dict(zip(zip(*keys.tolist(), strict=True), np.split(starts, first[1:]), strict=True))


def cut_later_windows(docs: DataFrame, windows: Windows, bytes_per_window: float,
                      cut: Callable[[str, np.ndarray | None], tuple], size: str) -> DataFrame:
    """``cut(text, starts)`` of every row, with the starts of those of its windows that occur earlier.

    Earlier is: in a document of smaller doc_id, or in the same one at a smaller
    start.  Different texts under one doc_id have no order among each other.
    Returns doc_id and what ``cut`` gives: the number of positions, named
    ``size``, n_removed, kept_sha256, kept_text and removed, the intervals.
    """
    keyed = identified(docs, F.col("doc_id").cast("long").alias("doc_id"))
    total = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(total / bytes_per_window / BUCKET_WINDOWS))
    groups = max(1, math.ceil(total / GROUP_BYTES))
    packed = keyed.drop("doc_id").mapInArrow(_map_side(windows, buckets), PACKED).repartition(buckets, "bucket")
    marks = packed.groupBy("bucket").applyInArrow(_settle(groups), MARKS)
    # the tag spreads copies of a text, and texts of one doc_id
    grouped = keyed.withColumn("_group", F.pmod("_tag", F.lit(groups)).cast("int"))
    kinds = {"doc_id": pa.int64(), size: pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(),
             "kept_text": pa.string(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}

    def cut_group(rows: pa.Table, notes: pa.Table) -> pa.Table:
        starts = _merge(notes["notes"])
        out = [(doc_id, *cut(text, starts.get(tuple(key)))) for doc_id, text, *key in
               zip(*(rows[c].to_pylist() for c in ("doc_id", "text", *KEY)), strict=True)]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * len(kinds),
                                                              kinds.values(), strict=True)], names=list(kinds))

    return (grouped.groupBy("_group").cogroup(marks.groupBy("_group")).applyInArrow(
        cut_group, f"doc_id long, {size} long, n_removed long, kept_sha256 string, kept_text string, "
                   "removed array<struct<start:bigint,stop:bigint>>"))


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` positions windows of ``length`` at these starts cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + length, -1)
    return np.cumsum(edges[:n]) > 0


def intervals(gone: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
    return [{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
