"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs.

Pairs are compared in the bucket where they meet and counted there; what leaves
a bucket is a number and a pointer per vector, never a pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joblume.llm.common import NO_ID, land
from joblume.llm.components import components

COSINE = 0.98
TABLES = 8
HASHES = 2  # cross-polytope hashes that make a bucket
PROBES = 5  # buckets of a table that a vector looks into, its own included
SEED = 20240115
BLOCK = 1024  # members of a bucket that are compared at a time
ROWS_PER_TASK = 20_000


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, whose length is a power of two."""
    n, d = rows.shape
    width = 1
    while width < d:
        pairs = rows.reshape(n, d // (2 * width), 2, width)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        width *= 2
    return rows / math.sqrt(d)


def bucket_codes(units: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
                 seed: int = SEED) -> np.ndarray:
    """(vectors, tables, probes) bucket numbers, the vector's own bucket first, then the next likely ones.

    A hash is the axis, of 2d with its sign, that is nearest to the vector after
    three rounds of random signs and a Hadamard transform.  Further probes
    exchange axes for the next nearest, in the order of what is lost by it.
    """
    n, d = units.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = units
    signs = np.random.Generator(np.random.PCG64([seed, size])).choice([-1.0, 1.0], (tables, hashes, 3, size))
    near = min(size, probes)
    out = np.zeros((n, tables, probes), np.int64)
    for t in range(tables):
        axes, losses = [], []
        for h in range(hashes):
            turned = padded
            for s in signs[t, h]:
                turned = hadamard(turned * s)
            order = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(turned, order, axis=1)
            axes.append(order * 2 + (value < 0))
            losses.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        code, loss = axes[0], losses[0]
        for h in range(1, hashes):
            code = (code[:, :, None] * (2 * size) + axes[h][:, None, :]).reshape(n, -1)
            loss = (loss[:, :, None] + losses[h][:, None, :]).reshape(n, -1)
            best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, :code.shape[1]] = code[:, :probes]
        out[:, t, code.shape[1]:] = code[:, :1]  # fewer axes than probes: the own bucket again
    return out


def _codes(batches):
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        nodes = batch.column("node").to_numpy()
        vectors = [np.frombuffer(x.as_py(), np.float64) for x in batch.column("vector")]
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            for part in np.array_split(at, math.ceil(len(at) / 2000)):
                rows = np.stack([vectors[i] for i in part])
                codes = bucket_codes(rows / np.linalg.norm(rows, axis=1, keepdims=True)).reshape(len(part), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[part]), pa.array([*codes], pa.list_(pa.int64()))], ["node", "codes"])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    roots = np.arange(n)
    while True:
        before = roots.copy()
        np.minimum.at(roots, a, roots[b])
        np.minimum.at(roots, b, roots[a])
        roots = roots[roots]
        if (roots == before).all():
            return roots


def _meet_first(codes_a: np.ndarray, codes_b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether this bucket is the first in which the pairs (rows of tables x probes) meet."""
    via_a = (codes_a[:, :, :1] == codes_b).any(axis=2)  # the bucket of a is one that b looks into
    via_b = (codes_b[:, :, :1] == codes_a).any(axis=2)
    first = ~(via_a | via_b)[:, :table].any(axis=1)
    none = np.iinfo(np.int64).max
    least = np.minimum(np.where(via_a[:, table], codes_a[:, table, 0], none),
                       np.where(via_b[:, table], codes_b[:, table, 0], none))
    return first & (least == code)


def _link_cells(rows: pa.Table) -> pa.Table:
    """Per vector of each cell: how many vectors it is linked with there, and one that its links lead to."""
    rows = rows.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")])
    key = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("bucket", "low", "high")])
    cuts = np.append(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])), rows.num_rows)
    node, block, copies = (rows[c].to_numpy() for c in ("node", "block", "copies"))
    table, code, own = (rows[c].to_numpy() for c in ("table", "code", "own"))
    vectors = rows["vector"].to_pylist()
    codes = np.stack(rows["codes"].to_pylist()).reshape(rows.num_rows, TABLES, PROBES)
    found = []
    for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        at = np.arange(start, stop)
        x = np.stack([np.frombuffer(vectors[i], np.float64) for i in at])
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        left = at if key[1, start] == key[2, start] else at[block[at] == key[1, start]]
        right = at if key[1, start] == key[2, start] else at[block[at] == key[2, start]]
        pairs = []
        for some in np.array_split(left, math.ceil(len(left) / 256) or 1):
            i, j = np.nonzero(unit[some - start] @ unit[right - start].T >= COSINE - 1e-9)
            i, j = some[i], right[j]
            keep = (i < j) if left is right else np.ones(len(i), bool)
            keep &= own[i] | own[j]
            i, j = i[keep], j[keep]
            exact = np.einsum("ij,ij->i", x[i - start], x[j - start]) / (
                np.linalg.norm(x[i - start], axis=1) * np.linalg.norm(x[j - start], axis=1))
            keep = exact >= COSINE
            i, j = i[keep], j[keep]
            keep = _meet_first(codes[i], codes[j], int(table[start]), int(code[start])) if len(i) else np.zeros(0, bool)
            pairs.append((i[keep], j[keep]))
        i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
        if len(i):
            links = np.zeros(len(at), np.int64)
            np.add.at(links, i - start, copies[j])
            np.add.at(links, j - start, copies[i])
            some = np.flatnonzero(links)
            found.append((node[at][some], links[some], node[at][local_roots(len(at), i - start, j - start)[some]]))
    columns = zip(*found, strict=True) if found else [[np.empty(0, np.int64)]] * 3
    return pa.table([pa.array(np.concatenate(list(c)), pa.int64()) for c in columns], names=["node", "links", "to"])


def near_duplicate_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept (it is the component's first), one row per row of ``embeddings``.

    Two vectors of equal label and length link if their cosine, in double
    precision, is at least 0.98; pairs are found where one lies in a bucket that
    the other looks into.  Vectors equal in every component are compared once
    for all.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing, nor does one whose label is null: n_links 0, its own
    vec_id as component_id.  A null vec_id counts as the largest and comes back
    as null.  A repeated row is the same vector: it is not counted as a link and
    gets the same result.  An empty table gives an empty table; other columns
    are not read.
    """
    vector = F.col("embedding").cast("array<double>")
    # without -0.0, so that equal vectors are equal bits
    vectors = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                                F.col("label").cast("string").alias("label"),
                                F.transform(vector, lambda x: x + F.lit(0.0)).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull() & finite
              & F.exists("vector", lambda x: x != 0))
    vectors = vectors.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "vector")))
    members = land(vectors.select("_id", "node"), "members")
    nodes = land(vectors.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"),
        F.count_distinct("_id").alias("copies"), F.min("_id").alias("first"))
        .select("node", "label", "copies", "first", F.size("vector").alias("dims"), "vector")
        .mapInArrow(_as_bytes, "node long, label string, copies long, first long, dims int, vector binary"), "vectors")
    codes = land(nodes.select("node", "dims", "vector").mapInArrow(_codes, "node long, codes array<long>"), "codes")

    looked = (nodes.select("node", "label", "dims").join(codes, "node")
              .select("node", "label", "dims", F.posexplode("codes").alias("at", "code"))
              .withColumn("table", F.expr(f"at div {PROBES}").cast("int"))
              .withColumn("bucket", F.xxhash64("label", "dims", "table", "code"))
              .groupBy("node", "bucket").agg(F.first("table").alias("table"), F.first("code").alias("code"),
                                             F.bool_or(F.col("at") % PROBES == 0).alias("own")))
    looked = land(looked, "looked")
    shared = (looked.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("own").alias("_own"))
              .where("_n > 1 AND _own").select("bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks")))
    met = looked.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = land(met.select("node", "bucket", "table", "code", "own", "block",
                            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
                 .withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other"))
                 .drop("_other"), "cells")
    tasks = max(1, math.ceil(cells.count() / ROWS_PER_TASK))
    filled = (cells.join(nodes.select("node", "copies", "vector").join(codes, "node"), "node")
              .withColumn("task", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(tasks)).cast("int")))
    found = land(filled.groupBy("task").applyInArrow(_link_cells, "node long, links long, to long"), "links")

    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    settled = (nodes.select("node", "copies", "first").join(counted, "node", "left").join(roots, "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    smallest = settled.groupBy("root").agg(F.min("first").alias("component"))
    classes = settled.join(smallest, "root").select(
        "node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component")
    component = F.coalesce("component", "_id")
    return members.join(classes, "node", "left").select(
        F.when(F.col("_id") < NO_ID, F.col("_id")).alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(component < NO_ID, component).alias("component_id"), (F.col("_id") == component).alias("kept"))


def _scaled(vector: np.ndarray) -> np.ndarray:
    """Times a power of two, which changes no digit, so that no square overflows or vanishes."""
    return np.ldexp(vector, -np.frexp(np.abs(vector).max())[1])


def _as_bytes(batches):
    for batch in batches:
        packed = [_scaled(np.asarray(x, np.float64)).tobytes() for x in batch.column("vector").to_pylist()]
        columns = [batch.column(c) for c in ("node", "label", "copies", "first", "dims")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(packed, pa.binary())],
                                         ["node", "label", "copies", "first", "dims", "vector"])
