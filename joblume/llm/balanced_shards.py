"""Sharding by Karmarkar-Karp differencing: near equal bytes with groups of equal texts kept whole."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import land

SHARDS = 40
ROW_BYTES = 16  # what a row takes besides its text
CHUNK_GROUPS = 20_000  # groups that one task puts into a partial partition
FAN_IN = 500  # partial partitions that one task combines
ROWS_PER_RUN = 50_000  # rows that are numbered together


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions, the rows of ``sums``, until one is left.

    Repeatedly takes the two of largest spread and adds the largest part of one
    to the smallest of the other, and so on.  Returns the part that each part of
    each row ends in, and the sums of these.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    parts = list(np.take_along_axis(sums, order, axis=1))
    heap = [(int(p[-1] - p[0]), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        added = parts[a] + parts[b][::-1]
        turn = np.argsort(-added, kind="stable")
        parts[a] = parts[b] = None
        merges.append((a, b, turn))
        parts.append(added := added[turn])
        heapq.heappush(heap, (int(added[-1] - added[0]), len(parts) - 1))
    where: list = [None] * len(parts)
    where[-1] = np.arange(k)
    for node in range(len(parts) - 1, n - 1, -1):
        a, b, turn = merges[node - n]
        where[a], where[b] = np.empty(k, np.int64), np.empty(k, np.int64)
        where[a][turn] = where[b][k - 1 - turn] = where[node]
        where[node] = None
    ends = np.empty((n, k), np.int64)
    np.put_along_axis(ends, order, np.stack(where[:n]), axis=1)
    return ends, parts[-1]


def _partition_groups(shards: int):
    def partition(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("bytes", "descending"), ("text_hash", "ascending"), ("text_crc32", "ascending")])
        sums = np.zeros((rows.num_rows, shards), np.int64)
        sums[:, 0] = rows["bytes"].to_numpy()
        ends, _ = difference(sums)
        return pa.table({**{c: rows[c] for c in ("size", "text_crc32", "text_hash", "bytes", "node")},
                         "part": pa.array(ends[:, 0], pa.int32())})
    return partition


def _combine(shards: int):
    def combine(rows: pa.Table) -> pa.Table:
        nodes, at = np.unique(rows["node"].to_numpy(), return_inverse=True)
        sums = np.zeros((len(nodes), shards), np.int64)
        sums[at, rows["part"].to_numpy()] = rows["bytes"].to_numpy()
        ends, _ = difference(sums)
        return pa.table({"node": pa.array(np.repeat(nodes, shards), pa.int64()),
                         "part": pa.array(np.tile(np.arange(shards), len(nodes)), pa.int32()),
                         "bytes": pa.array(sums.ravel(), pa.int64()),
                         "parent": pa.array(np.repeat(nodes // FAN_IN, shards), pa.int64()),
                         "end": pa.array(ends.ravel(), pa.int32())})
    return combine


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``shard`` for each of ``groups`` (size, text_crc32, text_hash, bytes)."""
    groups = land(groups, "groups")
    chunks = max(1, math.ceil(groups.count() / CHUNK_GROUPS))
    spread = groups.withColumn("node", F.pmod(F.xxhash64("text_hash", "text_crc32"), F.lit(chunks)))
    kinds = "size long, text_crc32 long, text_hash long, bytes long, node long, part int"
    placed = land(spread.groupBy("node").applyInArrow(_partition_groups(shards), kinds), "partial")
    sums = placed.groupBy("node", "part").agg(F.sum("bytes").alias("bytes"))
    ends, nodes = None, chunks
    while nodes > 1:
        level = land(sums.groupBy(F.expr(f"node div {FAN_IN}")).applyInArrow(
            _combine(shards), "node long, part int, bytes long, parent long, end int"), "level")
        sums = level.groupBy(F.col("parent").alias("node"), F.col("end").alias("part")).agg(F.sum("bytes").alias("bytes"))
        step = level.select("node", "part", "parent", "end")
        ends = step if ends is None else (
            ends.withColumnRenamed("parent", "via").withColumnRenamed("end", "at")
            .join(step.toDF("via", "at", "parent", "end"), ["via", "at"]).select("node", "part", "parent", "end"))
        nodes = math.ceil(nodes / FAN_IN)
    if ends is None:
        return placed.withColumnRenamed("part", "shard").drop("node", "bytes")
    return (placed.join(ends.select("node", "part", F.col("end").alias("shard")), ["node", "part"])
            .select("size", "text_crc32", "text_hash", "shard"))


def _slots(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Numbers each shard's rows from 0, in runs, so that no task sorts a shard."""
    parts = max(1, math.ceil(total / shards / ROWS_PER_RUN))
    rows = rows.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)))
    runs = rows.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_run").orderBy("doc_id", "text_hash", "text_crc32")
    return (rows.withColumn("_at", F.row_number().over(within) - 1).join(runs, ["shard", "_run"])
            .withColumn("slot", F.col("_before") + F.col("_at")).drop("_run", "_before", "_at"))


def balance_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Puts documents into shards of near equal bytes; documents of equal text stay together.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law ("bytes"), shard
    (0 to ``shards`` - 1), slot (gapless from 0 in each shard) and grown_shard
    (null: another number of shards is another partition), one row per row.

    A null text is as good as an empty one: size 16, CRC 0, one group.  A
    repeated row belongs to the group of its text like any other row; rows of
    null doc_id are placed by their text.  A group larger than an even share
    makes its shard as large as itself, as groups are never split.  An empty
    table gives an empty table; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = land(rows, "sizes")
    key = ["size", "text_crc32", "text_hash"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
    placed = rows.join(assign_groups(groups, shards), key)
    return _slots(placed, rows.count(), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
