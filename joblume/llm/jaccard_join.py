"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification per pair.

A document is known by the signature of its shingle set, so copies are one node.
Shingles are ordered by how often they occur, the rare ones first; two sets of
similarity t share k of the first n - ceil(t n) + k of either, and prefixes are
taken with a k of about n / 4.  So a node that shares too few of its prefix with
anyone is left out before pairs are thought of, and of the others the most
frequent shingles, now counted exactly, are left out: by k / 2, and k / 2 are asked
for.  The list of a prefix shingle is
not expanded into pairs: its nodes are first compared with one of them each.  What
that leaves apart in long lists is compared as families: nodes of lists that
have the same least node go, with their whole sets, to cells of two blocks each,
where shared shingles of all pairs are counted at once and only links come out.
Pairs are formed in short lists alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import KEY, hash_words, identified, land, mix, runs, small_batches, text_buffer, window_hashes
from joblume.llm.components import components
from joblume.llm.embedding_dedup import local_roots

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # similarity of 0.75, in whole numbers
FREQUENT = 200_000  # shingles whose counts every task gets: so many numbers, whatever the data
OFTEN = 4  # a shingle counts as frequent in a batch from so many documents on
STAR_ROUNDS = 2  # at most; without new links there are fewer
LONG = 64  # nodes; longer lists are compared as families
CELL_BYTES = 1024 * 1024  # of a block's sets, about
_COLUMNS = 2048  # shingles that are counted at a time
SLICE_COUNTS = 1 << 19  # pairs of sets that are counted at a time, about
DENSE_VALUES = 1 << 22  # of the sets on the right, for the shingles that are counted at a time
MEMBERS = 256  # sets that one task compares with one centre at a time
CHUNK_BYTES = 256 * 1024
BATCH_BYTES = 8 * 1024 * 1024
POSTING_BYTES = 4 * 1024 * 1024  # of texts whose entries are packed together
BUCKET_ENTRIES = 1_000_000
SORT_BITS = 3  # a bucket's entries are sorted in so many parts, by the first bits of their shingles
PACKS = 64  # that leave a task at a time
SUFFIX_PARTS = 64
EXTRA = 4  # prefixes have one shingle in so many more than one shared shingle asks for
PEELS = 2  # times that nodes which share too little are left out
FILTER_BITS = 1 << 24  # of the filter that picks documents whose sets are wanted: so many, whatever the data
_BASE = 0xAF251AF3B0F025B5


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted shingle hashes of each text; a text of fewer words is one shingle, one of none has no set."""
    raw, offsets = text_buffer(column)
    upper = (raw >= 65) & (raw <= 90)
    hashes, begins = hash_words(np.where(upper, raw + 32, raw).astype(np.uint8), offsets)
    windows = mix(window_hashes(hashes, words, _BASE))
    sets = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(windows[a:b - words + 1]))
        elif b > a:
            short = window_hashes(hashes[a:b], b - a, _BASE) + np.uint64((b - a) * 0x9E3779B97F4A7C15 % 2**64)
            sets.append(mix(mix(short)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def signature(shingles: np.ndarray) -> int:
    return int(mix(np.array([mix(shingles ^ np.uint64(_BASE)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))
               .view(np.int64)[0])


def _sets_of(rows: pa.Table, words: int) -> Iterator[np.ndarray]:
    for chunk in runs(rows.to_batches(), CHUNK_BYTES):
        for part in chunk.to_batches():
            yield from shingle_sets(part.column(part.schema.get_field_index("text")), words)


def _frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of what OFTEN of the sets or more have."""
    values = np.concatenate([np.empty(0, np.uint64), *sets])
    values.sort()
    # of so many equal ones the first lies that far before the last
    last = values[OFTEN - 1:]
    often = np.unique(last[last == values[:len(last)]])
    return often, np.searchsorted(values, often, "right") - np.searchsorted(values, often, "left")


def _survey(words: int):
    """A row per document, with its set's signature and size, and rows of shingles that are frequent in a batch."""
    names = [*KEY, "sig", "n", "shingle", "count"]

    def survey(batches):
        for rows in runs(batches, BATCH_BYTES):
            sets = list(_sets_of(rows, words))
            sigs = [signature(x) for x in sets]
            size = len(sets)
            yield pa.RecordBatch.from_arrays(
                [*(rows[c].combine_chunks() for c in KEY), pa.array(sigs, pa.int64()),
                 pa.array([len(x) for x in sets], pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64())],
                names)
            shingles, counts = _frequent(list(dict(zip(sigs, sets, strict=True)).values()))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(shingles), pa.int64())] * (len(KEY) + 2) + [pa.array(shingles.view(np.int64)),
                                                 pa.array(counts.astype(np.int64))], names)
    return survey


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 + n // EXTRA


# what two nodes share of their prefixes at least, by the smaller size, and what a node shares with any other
NODE_SHARES = f"(ceil({NUMERATOR}D * {{n}} / {DENOMINATOR}) div {EXTRA})"
NODE_NEEDS = "1 + " + NODE_SHARES.format(n="n")
# half of a node's share is left out where it is most frequent, so a pair has that much less to share
LEFT_OUT = "(" + NODE_SHARES + " div 2)"
PAIR_NEEDS = f"1 + least(x.n, y.n) div {EXTRA} - {LEFT_OUT.format(n='greatest(x.n, y.n)')}"


class RareFirst:
    """The order of shingles: by count, then by hash.  What is not among the frequent ones counts as rare."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.counts = shingles[order], counts[order]

    def frequency(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.counts[at], 0)

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shingles, their counts) of the prefix of a sorted set, in order."""
        counts, n = self.frequency(shingles), prefix_length(len(shingles))
        if not counts.any():
            return shingles[:n], counts[:n]
        order = np.argsort(counts, kind="stable")[:n]
        return shingles[order], counts[order]


def _postings(words: int, buckets: int, shared):
    """Prefix entries, packed by bucket; those of frequent shingles need no partner to be found and are marked."""
    schema = pa.schema([("bucket", pa.int32()), ("frequent", pa.bool_()), ("entries", pa.binary())])

    def postings(batches):
        order = RareFirst(*shared.value)
        for rows in runs(batches, POSTING_BYTES):
            found = {}
            for shingles in _sets_of(rows, words):
                if len(shingles) and (sig := signature(shingles)) not in found:
                    prefix, counts = order.prefix(shingles)
                    found[sig] = len(shingles), prefix.copy(), counts > 0
            if not found:
                continue
            sizes, prefixes, marks = zip(*found.values(), strict=True)
            lengths = [len(p) for p in prefixes]
            sigs, sizes = np.array(list(found), np.int64), np.array(sizes, np.int32)
            shingles, often = np.concatenate(prefixes), np.concatenate(marks)
            found = prefixes = marks = None
            node = np.repeat(np.arange(len(sigs), dtype=np.int32), lengths)
            pos = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            key = (mix(shingles) % np.uint64(buckets)).astype(np.int64)
            key[often] = sigs[node[often]] % buckets
            key = key * 2 + often
            turn = np.argsort(key, kind="stable")
            key = key[turn]
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
            for at in range(0, len(cuts) - 1, PACKS):
                out = []
                for a, b in zip(cuts[at:at + PACKS], cuts[at + 1:at + PACKS + 1], strict=False):
                    some, entries = turn[a:b], np.empty(b - a, _ENTRY)
                    entries["shingle"], entries["pos"] = shingles[some], pos[some]
                    entries["sig"], entries["n"] = sigs[node[some]], sizes[node[some]]
                    out.append((int(key[a] // 2), bool(key[a] % 2), _pack(entries)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    zip(*out, strict=True), schema, strict=True)], schema=schema)
    return postings


_ENTRY = np.dtype([("shingle", np.uint64), ("sig", np.int64), ("n", np.int32), ("pos", np.int32)])


def _pack(entries: np.ndarray) -> bytes:
    """Columns behind each other, so that what repeats is squeezed; a document's entries lie together."""
    data = b"".join(entries[f].tobytes() for f in _ENTRY.names)
    return len(entries).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(packed: list[pa.Buffer]) -> dict[str, np.ndarray]:
    """The columns of all packs, one behind the other."""
    sizes = [int.from_bytes(x[:8], "little") for x in packed]
    columns, first = {f: np.empty(sum(sizes), _ENTRY[f]) for f in _ENTRY.names}, 0
    for x, n in zip(packed, sizes, strict=True):
        data, at = pa.decompress(x[8:], decompressed_size=n * _ENTRY.itemsize, codec="zstd", asbytes=True), 0
        for f, column in columns.items():
            column[first:first + n] = np.frombuffer(data, _ENTRY[f], n, at)
            at += n * _ENTRY[f].itemsize
        first += n
    return columns


def _distinct(entries: dict[str, np.ndarray], twins: bool) -> np.ndarray:
    """Which entries are left, by shingle, if one per node is: copies of a text in several batches bring the same ones.

    ``twins``: only those whose shingle occurs with another node too.
    """
    part, left = (entries["shingle"] >> np.uint64(64 - SORT_BITS)).astype(np.uint8), [np.empty(0, np.int64)]
    for k in range(1 << SORT_BITS):
        at = np.flatnonzero(part == k)
        at = at[np.lexsort((entries["sig"][at], entries["shingle"][at]))]
        shingle, sig = entries["shingle"][at], entries["sig"][at]
        new = np.ones(len(at), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])
        at, shingle = at[new], shingle[new]
        if twins:
            twin = np.zeros(len(at), bool)
            same = shingle[1:] == shingle[:-1]
            twin[1:] |= same
            twin[:-1] |= same
            at = at[twin]
        left.append(at)
    return np.concatenate(left)


def _shared_lists(rows: pa.Table) -> pa.Table:
    """The distinct entries of a bucket whose shingle occurs with another node too."""
    marks, packed, found = rows["frequent"].to_pylist(), [x.as_buffer() for x in rows["entries"]], []
    for marked in (True, False):
        entries = _unpack([x for x, mark in zip(packed, marks, strict=True) if mark == marked])
        left = _distinct(entries, twins=not marked)
        found.append({f: column[left] for f, column in entries.items()})
    often, rest = found
    columns = {f: np.concatenate([often[f], rest[f]]) for f in _ENTRY.names}
    return pa.table({"shingle": pa.array(columns["shingle"].view(np.int64)), "sig": pa.array(columns["sig"]),
                     "n": pa.array(columns["n"]), "pos": pa.array(columns["pos"])})


def _compare(centre: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which sets are as similar to ``centre`` as asked; all are sorted."""
    sizes = np.array([len(x) for x in sets], np.int64)
    need = -(-NUMERATOR * (sizes + len(centre)) // (NUMERATOR + DENOMINATOR))
    # suffix filter: no more can be shared than the smaller count in each part of the hash range
    edges = np.arange(1, SUFFIX_PARTS, dtype=np.uint64) * np.uint64(2**64 // SUFFIX_PARTS)
    parts = lambda x: np.diff(np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]))
    own = parts(centre)
    likely = np.array([np.minimum(own, parts(x)).sum() for x in sets], np.int64) >= need
    shared = np.zeros(len(sets), np.int64)
    for i in np.flatnonzero(likely):
        at = np.minimum(np.searchsorted(centre, sets[i]), len(centre) - 1)
        shared[i] = int((centre[at] == sets[i]).sum())
    return likely & (DENOMINATOR * shared >= NUMERATOR * (sizes + len(centre) - shared))


def _verify_group(pairs: pa.Table, centres: pa.Table) -> pa.Table:
    centre = np.frombuffer(centres["centre_set"][0].as_py(), np.uint64)
    linked = _compare(centre, [np.frombuffer(x.as_py(), np.uint64) for x in pairs["shingles"]])
    return pairs.select(["a", "b"]).filter(pa.array(linked))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked.  A set goes once to each slot of a centre's partners."""
    per = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("_slots"))
    slotted = land(pairs.join(per, "a").withColumn("slot", F.pmod(F.xxhash64("b"), "_slots").cast("int"))
                   .select("a", "slot", "b"), "pairs")
    left = slotted.join(sets.select(F.col("sig").alias("b"), "shingles"), "b")
    right = (slotted.select(F.col("a").alias("centre"), F.col("slot").alias("part")).distinct()
             .join(sets.select(F.col("sig").alias("centre"), F.col("shingles").alias("centre_set")), "centre"))
    return (left.groupBy("a", "slot").cogroup(right.groupBy("centre", "part"))
            .applyInArrow(_verify_group, "a long, b long"))


def _can_link(a: str, b: str):
    """Length and positional filter of two entries of one list."""
    need = f"ceil({NUMERATOR}D * ({a}.n + {b}.n) / {NUMERATOR + DENOMINATOR})"
    return (f"{DENOMINATOR} * least({a}.n, {b}.n) >= {NUMERATOR} * greatest({a}.n, {b}.n) AND "
            f"least({a}.pos, {b}.pos) + 1 + least({a}.n - {a}.pos - 1, {b}.n - {b}.pos - 1) >= {need}")


def _unsettled(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Entries with the root that their node has so far, of lists in which several roots meet."""
    known = entries.withColumn("root", F.col("sig")) if roots is None else (
        entries.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
        .withColumn("root", F.coalesce("root", "sig")))
    mixed = known.groupBy("shingle").agg(F.min("root").alias("_least"), F.max("root").alias("_most")) \
        .where("_least <> _most").select("shingle")
    return known.join(mixed, "shingle", "left_semi")


def _peel(entries: DataFrame, needs: str) -> DataFrame:
    """Leaves out nodes with too few entries to be linked with any other, and lists of a single node."""
    enough = entries.groupBy("sig", "n").agg(F.count(F.lit(1)).alias("_n")).where(f"_n >= {needs}").select("sig")
    left = entries.join(enough, "sig", "left_semi")
    shared = left.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("shingle")
    return land(left.join(shared, "shingle", "left_semi"), "entries")


def _rarest(entries: DataFrame) -> DataFrame:
    """Leaves out the entries of each node whose lists are longest, half as many as it must share."""
    lengths = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("_length"))
    longest = Window.partitionBy("sig").orderBy(F.desc("_length"), "shingle")
    return land(entries.join(lengths, "shingle").withColumn("_rank", F.row_number().over(longest))
                .where(f"_rank > {LEFT_OUT.format(n='n')}").drop("_rank", "_length"), "rarest")


def _star_pairs(entries: DataFrame, number: int) -> DataFrame:
    """Each node of a list with one of them, the same for all; pairs that share half of what they need, to begin with."""
    centre = entries.groupBy("shingle").agg(F.min_by(F.struct("sig", "n", "pos", "root"),
                                                     F.xxhash64("sig", F.lit(number))).alias("x"))
    return (entries.alias("y").join(centre, "shingle").where("y.root <> x.root").where(F.expr(_can_link("x", "y")))
            .select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.expr(f"({PAIR_NEEDS}) / 2").alias("needs")))


def _remaining_pairs(entries: DataFrame) -> DataFrame:
    """All pairs that lists hold of nodes with different roots: what is outside a list's largest root with the list."""
    sizes = entries.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("_size"))
    main = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("_size", "root")).alias("_main"))
    marked = entries.join(main, "shingle").withColumn("_out", F.col("root") != F.col("_main"))
    out = marked.where("_out").drop("_main", "_out")
    return (out.alias("x").join(marked.alias("y"), F.col("x.shingle") == F.col("y.shingle"))
            .where("x.root <> y.root AND (NOT y._out OR x.sig < y.sig)").where(F.expr(_can_link("x", "y")))
            .select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"), F.expr(PAIR_NEEDS).alias("needs")))


def shared_slices(left: list[np.ndarray], right: list[np.ndarray]):
    """(first, counts): how many shingles the sets on the left from ``first`` on share with each other set on the right.

    A slice has about SLICE_COUNTS counts, as sets may be many where they are short.
    """
    sides = []
    for sets in (left, right):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        sides.append((np.concatenate([np.empty(0, np.uint64), *sets]), owner))
    # what one side alone has is shared by nobody
    columns = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if left is right:
        values, times = np.unique(sides[0][0], return_counts=True)
        columns = values[times > 1]
    placed = []
    for values, owner in sides:
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        some = columns[at] == values if len(columns) else np.zeros(len(values), bool)
        at, owner = at[some], owner[some]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], owner[order]))
    rows, width = max(1, SLICE_COUNTS // max(1, len(right))), max(1, min(_COLUMNS, DENSE_VALUES // max(1, len(right))))
    for first in range(0, len(left), rows):
        counts = np.zeros((min(rows, len(left) - first), len(right)), np.float32)
        at, owner = placed[0]
        some = (owner >= first) & (owner < first + rows)
        own = at[some], owner[some] - first
        for start in range(0, len(columns), width):
            dense = []
            for (at, owner), size in zip((own, placed[1]), counts.shape, strict=True):
                a, b = np.searchsorted(at, [start, start + width])
                part = np.zeros((size, min(width, len(columns) - start)), np.float32)
                part[owner[a:b], at[a:b] - start] = 1
                dense.append(part)
            counts += dense[0] @ dense[1].T
        yield first, counts


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each other set on the right, all at once."""
    return np.concatenate([np.zeros((0, len(right)), np.float32), *(counts for _, counts in shared_slices(left, right))])


def _link_cell(rows: pa.Table) -> pa.Table:
    """Links within a cell, as one per node: (node, a node that its links lead to)."""
    node, block = rows["sig"].to_numpy(), rows["block"].to_numpy()
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"]]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    own = [sets[i] for i in left]
    sizes, roots = np.array([len(x) for x in sets], np.int64), np.arange(len(node))
    for first, counts in shared_slices(own, own if low == high else [sets[i] for i in right]):
        shared, part = counts.astype(np.int64), left[first:first + len(counts)]
        union = sizes[part][:, None] + sizes[right][None, :] - shared
        a, b = np.nonzero(DENOMINATOR * shared >= NUMERATOR * union)
        # links between what earlier slices joined
        a, b = roots[part[a]], roots[right[b]]
        some = a != b
        if some.any():
            roots = local_roots(len(node), a[some], b[some])[roots]
    moved = np.flatnonzero(roots != np.arange(len(node)))
    return pa.table({"a": pa.array(node[moved]), "b": pa.array(node[roots[moved]])})


def _family_links(entries: DataFrame, sets_of) -> DataFrame:
    """Links of all nodes with different roots that meet in a long list.

    A family is the lists that have the same least node, by a hash: lists of one
    group of near copies are a few families, and whoever shares a long list is
    in its family.  All of a family is compared, block by block.
    """
    long = (entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.xxhash64("sig"), "sig")).alias("_f"))
            .where(F.col("_n") > LONG).select("shingle", F.col("_f.sig").alias("family")))
    members = land(entries.join(long, "shingle").groupBy("family", "sig").agg(F.first("n").alias("n"), F.first("root").alias("root")),
                   "members")
    size = F.ceil(F.sum("n") * 8 / CELL_BYTES).cast("int")
    families = (members.groupBy("family").agg(size.alias("blocks"), F.min("root").alias("_a"), F.max("root").alias("_b"))
                .where("_a <> _b").select("family", "blocks"))
    placed = (members.join(families, "family").withColumn("block", F.pmod(F.xxhash64("sig", "family"), "blocks").cast("int"))
              .select("family", "sig", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
              .select("family", "sig", "block", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")))
    placed = land(placed, "cells")
    sets = sets_of(placed.select("sig").distinct())
    return land(placed.join(sets, "sig").groupBy("family", "low", "high").applyInArrow(_link_cell, "a long, b long"), "links")


def _short(entries: DataFrame) -> DataFrame:
    """Entries of lists that are no families."""
    short = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= LONG).select("shingle")
    return entries.join(short, "shingle", "left_semi")


def _once(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Pairs that share as many lists as they need, without those tested before, whichever way round."""
    both = pairs.withColumn("_low", F.least("a", "b")).withColumn("_high", F.greatest("a", "b"))
    one = (both.groupBy("_low", "_high")
           .agg(F.first("a").alias("a"), F.first("b").alias("b"), F.count(F.lit(1)).alias("_n"),
                F.min("needs").alias("needs")).where("_n >= needs"))
    if tested is not None:
        one = one.join(tested.select(F.least("a", "b").alias("_low"), F.greatest("a", "b").alias("_high")),
                       ["_low", "_high"], "left_anti")
    return land(one.select("a", "b"), "candidates")


def _bit(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64) ^ tags.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _sets(keyed: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sig, shingles), once each, of at least the ``wanted`` nodes (sig), each from one of its documents.

    Which documents are read is told to the tasks by a bit filter of fixed size;
    where it is full more documents are read, and more sets shuffled, than needed.
    """
    def bits(batches):
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bit // 32), pa.array(np.int64(1) << bit % 32)], ["at", "bits"])

    first = nodes.groupBy("sig").agg(F.min(F.struct(*KEY)).alias("f")) \
        .join(wanted, "sig", "left_semi").select("f.*")
    marked = first.mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 32, np.uint32)
    held[marked["at"].to_numpy()] = marked["bits"].to_numpy()
    shared = keyed.sparkSession.sparkContext.broadcast(held)

    def with_sets(batches):
        for batch in batches:
            bit = _bit(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            some = batch.filter(pa.array(shared.value[bit // 32] >> (bit % 32).astype(np.uint32) & 1 == 1))
            for rows in runs(iter([some]), CHUNK_BYTES):
                sets = list(_sets_of(rows, words))
                yield pa.RecordBatch.from_arrays([pa.array([signature(x) for x in sets], pa.int64()),
                                                  pa.array([x.tobytes() for x in sets], pa.binary())],
                                                 ["sig", "shingles"])

    # repeated rows, and what passes a full filter, bring a set more than once
    return land(keyed.mapInArrow(with_sets, "sig long, shingles binary").groupBy("sig")
                .agg(F.first("shingles").alias("shingles")), "sets")


def link_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(_id, _tag, _tag2, sig, n, root) of each distinct document: nodes of equal root are linked, directly or not."""
    small_batches(docs.sparkSession)
    keyed = identified(docs)
    surveyed = land(keyed.mapInArrow(_survey(words), "_id long, _tag long, _tag2 long, sig long, n long, shingle long, count long"),
                    "survey")
    nodes = surveyed.where("sig IS NOT NULL").select(*KEY, "sig", "n").distinct()
    frequent = (surveyed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("count"))
                .orderBy(F.desc("count"), "shingle").limit(FREQUENT).toArrow())
    shared = docs.sparkSession.sparkContext.broadcast(
        (frequent["shingle"].to_numpy().view(np.uint64), frequent["count"].to_numpy()))
    total = surveyed.agg(F.sum("n")).first()[0] or 0
    # a prefix has a quarter of a set, and what EXTRA adds
    buckets = max(1, math.ceil(total * (1 / 4 + 1 / EXTRA) / BUCKET_ENTRIES))
    entries = land(keyed.select("text").mapInArrow(_postings(words, buckets, shared),
                                                   "bucket int, frequent boolean, entries binary")
                   .repartition(buckets, "bucket").groupBy("bucket")
                   .applyInArrow(_shared_lists, "shingle long, sig long, n int, pos int"), "entries")
    for _ in range(PEELS):
        entries = _peel(entries, NODE_NEEDS)
    entries = _peel(_rarest(entries), f"{NODE_NEEDS} - {LEFT_OUT.format(n='n')}")
    roots = tested = None

    def joined(found):
        """Roots with more links; what earlier ones joined goes in as one link per node."""
        return components(found if roots is None else found.unionByName(roots.toDF("a", "b")))

    def compared(pairs):
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        return land(_verify(pairs, _sets(keyed, nodes, wanted, words)).distinct(), "links")

    for number in range(STAR_ROUNDS):
        pairs = _once(_star_pairs(land(_unsettled(entries, roots), "lists"), number), tested)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if pairs.isEmpty() or (found := compared(pairs)).isEmpty():
            break
        roots = joined(found)
    unsettled = land(_unsettled(entries, roots), "lists")
    found = _family_links(unsettled, lambda wanted: _sets(keyed, nodes, wanted, words))
    if not found.isEmpty():
        roots = joined(found)
        unsettled = land(_unsettled(unsettled.drop("root"), roots), "lists")
    # who meets in a long list is settled; all others share as much as they need in short ones
    pairs = _once(_remaining_pairs(_short(unsettled)), tested)
    if not pairs.isEmpty() and not (found := compared(pairs)).isEmpty():
        roots = joined(found)
    if roots is None:
        return nodes.withColumn("root", F.col("sig"))
    return (nodes.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
            .withColumn("root", F.coalesce("root", "sig")).select(*KEY, "sig", "n", "root"))


def near_duplicate_classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links), one row per row of ``docs``.

    A document's set has its distinct shingles of ``words`` words, A-Z in lower
    case; with fewer words their whole sequence is the one shingle.  Two link if
    four times what they share is at least three times their union.

    A null or empty text, or one of blanks, has an empty set, is linked with
    nothing, and has its own doc_id as component_id.  A null doc_id counts as
    the largest and comes back as null, also as component_id where no other is
    reachable.  Repeated rows get the same result each.  An empty table gives an
    empty table; other columns are not read.
    """
    rows = identified(docs, F.col("doc_id").cast("long").alias("doc_id")).drop("text")
    linked = land(link_documents(docs, words), "linked")
    smallest = linked.where("n > 0").groupBy("root").agg(F.min("_id").alias("_first"))
    classes = linked.join(smallest, "root", "left").select(
        *KEY, "n", F.when(F.col("n") > 0, F.col("_first")).otherwise(F.col("_id")).alias("_first"))
    return rows.join(classes, KEY).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("_first") < 2**63 - 1, F.col("_first")).alias("component_id"))
