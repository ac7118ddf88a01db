"""Approximate nearest neighbours: randomly rotated one-bit codes, and error bounds that choose what is reranked.

A unit vector o is turned at random, and of each component the sign is kept.
With the code x of unit length that these signs stand for, <q, x> / <x, o>
estimates <q, o> without bias, and errs by more than
EPSILON * sqrt((1 - <x, o>^2) / <x, o>^2 / (bits - 1)) only in rare cases.  So a
vector is compared exactly if its upper bound reaches the lower bounds of as
many others as are asked for, and by the error bound nearly no neighbour is lost.

Blocks of codes meet blocks of queries; what leaves such a meeting is a few
vectors per query.  All codes are looked at for every query: nothing is pruned
but by its bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import land
from joblume.llm.embedding_dedup import hadamard
from joblume.operators.skew import spread_join

NEIGHBOURS = 5
BITS = 256  # of a code at least; vectors of more components have a bit for each
EPSILON = 2.5
SEED = 20240311
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 2048, 1 << 20, 256  # vectors of a block of codes, and such blocks at best
QUERY_BLOCK = 16_384
TILE = 256  # queries that are compared with a block of codes at a time
TILE_CODES = 8192
CODE = "ids array<long>, vector binary, code binary, along double"


def unit_scale(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit, so that no square overflows or vanishes."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``; both are scaled."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def rotated(units: np.ndarray, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Unit vectors in more dimensions, ``bits`` at least, by random signs and Hadamard transforms; float32."""
    n, d = units.shape
    size = 1 << max(3, (d - 1).bit_length())
    times = max(1, -(-bits // size))
    padded = np.zeros((n, size))
    padded[:, :d] = units
    signs = np.random.Generator(np.random.PCG64([seed, size])).choice([-1.0, 1.0], (times, 3, size))
    parts = []
    for rounds in signs:
        turned = padded
        for s in rounds:
            turned = hadamard(turned * s)
        parts.append(turned)
    return (np.concatenate(parts, axis=1) / math.sqrt(times)).astype(np.float32)


def _vectors(column) -> np.ndarray:
    """Packed vectors of one length as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as rows, so that in each all are of one length."""
    for batch in batches:
        sizes = np.array([len(v) if v is not None else 0 for v in batch.column("vector").to_pylist()], np.int64)
        for size in np.unique(sizes):
            part = batch.filter(pa.array(sizes == size))
            yield part, np.array(part.column("vector").to_pylist(), np.float64).reshape(part.num_rows, size)


def _encode(batches):
    for part, x in _by_length(batches):
        x = unit_scale(x)
        turned = rotated(_units(x))
        along = np.abs(turned).sum(axis=1, dtype=np.float64) / math.sqrt(turned.shape[1])
        yield pa.RecordBatch.from_arrays(
            [part.column("ids"), pa.array([v.tobytes() for v in x], pa.binary()),
             pa.array([b.tobytes() for b in np.packbits(turned > 0, axis=1)], pa.binary()), pa.array(along)],
            ["ids", "vector", "code", "along"])


def _search(neighbours: int):
    """Of each query of a block its nearest vectors in a block of codes, one more than asked for."""
    asked = neighbours + 1  # the query's own vector may be among them
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64()),
                        ("ids", pa.list_(pa.int64()))])

    def search(codes: pa.Table, queries: pa.Table) -> pa.Table:
        if not codes.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, q = _vectors(codes["vector"]), _vectors(queries["vector"])
        packed = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(x), -1)
        bits = packed.shape[1] * 8
        along = codes["along"].to_numpy()
        error = (EPSILON * np.sqrt(np.maximum(1 - along ** 2, 0) / along ** 2 / (bits - 1))).astype(np.float32)
        ids = codes["ids"].to_pylist()
        least = np.array([i[0] for i in ids], np.int64)
        a, b = queries["a"].to_numpy(), queries["b"].to_numpy()
        out: list[list] = [[], [], [], []]
        for start in range(0, len(q), TILE):
            some = q[start:start + TILE]
            turned = rotated(_units(some))
            estimates = np.empty((len(some), len(x)), np.float32)
            for at in range(0, len(x), TILE_CODES):
                signs = np.unpackbits(packed[at:at + TILE_CODES], axis=1).astype(np.float32) * 2 - 1
                estimates[:, at:at + TILE_CODES] = turned @ signs.T
            estimates /= (math.sqrt(bits) * along).astype(np.float32)
            lower = estimates - error
            if len(x) > asked:
                reached = np.partition(lower, len(x) - asked, axis=1)[:, len(x) - asked]
            else:
                reached = np.full(len(some), -np.inf, np.float32)
            for i in range(len(some)):
                chosen = np.flatnonzero(estimates[i] + error >= reached[i])
                scores = np.empty(len(chosen))
                for at in range(0, len(chosen), TILE_CODES):
                    part = chosen[at:at + TILE_CODES]
                    scores[at:at + TILE_CODES] = cosines(np.broadcast_to(some[i], (len(part), x.shape[1])), x[part])
                best = np.lexsort((least[chosen], -scores))[:asked]
                out[0] += [int(a[start + i])] * len(best)
                out[1] += [int(b[start + i])] * len(best)
                out[2] += scores[best].tolist()
                out[3] += [ids[c] for c in chosen[best].tolist()]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
    return search


def usable_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector, key) once each, without null ids and vectors that are null, empty, zero or not finite.

    Vectors are the same if the two 64-bit hashes of ``key`` are.
    """
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))  # no -0.0
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    key = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(SEED), "vector").alias("b")).alias("key")
    return (rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite
                       & F.exists("vector", lambda x: x != 0))
            .select("vec_id", "vector", key).dropDuplicates(["vec_id", "key"]))


def _blocks(n: int) -> int:
    size = min(MOST_BLOCK, max(LEAST_BLOCK, math.ceil(n / BLOCKS)))
    return max(1, math.ceil(n / size))


def nearest_vectors(embeddings: DataFrame, is_query: Column, neighbours: int = NEIGHBOURS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``neighbours`` nearest vectors of each query, by cosine.

    Queries are the rows of which ``is_query``, a condition on vec_id, holds;
    candidates are all rows of another vec_id and of as many components.  Equal
    scores are ranked by vec_id.  Vectors equal in every component are searched
    once, with the smallest ids that they have.  The score is computed in double
    precision from the vectors themselves.

    Rows whose vec_id is null, or whose vector is null, empty, zero or has a
    null or non-finite component, take no part.  A repeated row counts once; an
    id with several vectors is searched for each of them, and may be found by
    each.  A query without candidates has no rows; an empty table gives an empty
    table; other columns are not read.
    """
    rows = land(usable_vectors(embeddings), "vectors")
    # a bounded number of ids goes on, however many have the vector
    least = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    vectors = land(rows.withColumn("_rank", least).where(F.col("_rank") <= neighbours + 1).groupBy("key").agg(
        F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    codes = land(vectors.select("ids", "vector").mapInArrow(_encode, CODE), "codes")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "key")
    asking = land(vectors.join(queries.select("key").distinct(), "key", "left_semi")
                  .select("key.a", "key.b", "vector").mapInArrow(_pack_queries, "a long, b long, vector binary"), "asking")
    blocks, turns = _blocks(vectors.count()), max(1, math.ceil(asking.count() / QUERY_BLOCK))
    dims = F.octet_length("vector").alias("dims")
    dealt = codes.select("*", dims, F.pmod(F.xxhash64("vector"), F.lit(blocks)).cast("int").alias("block"),
                         F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    asked = asking.select("*", dims, F.pmod("a", F.lit(turns)).cast("int").alias("turn"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    place = ["block", "turn", "dims"]
    found = land(dealt.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(
        _search(neighbours), "a long, b long, score double, ids array<long>"), "found")

    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), F.col("ids")[0])
    listed = (found.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= neighbours + 1)
              .groupBy("a", "b").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
              .select(F.struct("a", "b").alias("key"), "found"))
    ranked = F.expr(f"""slice(array_sort(filter(flatten(transform(found,
        f -> transform(f.ids, i -> struct(-f.score AS less, i AS vec_id)))), x -> x.vec_id <> query_id)), 1, {neighbours})""")
    # one vector may be that of very many queries
    return (spread_join(queries, listed, "key", "inner", ["query_id"])
            .select("query_id", F.posexplode(ranked).alias("_at", "_found"))
            .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_found.vec_id").alias("vec_id"),
                    (-F.col("_found.less")).alias("score")))


def _pack_queries(batches):
    for part, x in _by_length(batches):
        yield pa.RecordBatch.from_arrays(
            [part.column("a"), part.column("b"), pa.array([v.tobytes() for v in unit_scale(x)], pa.binary())],
            ["a", "b", "vector"])
