"""Joins and numbering that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joblume.session import checkpoint_root

ROWS_PER_SLOT = 1_000_000
COUNT_ONE_IN = 64
CHUNK = 65_536
BROADCAST_BYTES = 64 * 1024 * 1024


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str,
                row_id: list[str], rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Equi-join of ``left``, where keys may be hot, with ``right``, where each is rare.

    The left rows of every key of more than ``rows_per_slot`` go to as many slots
    as they need, its right rows to each of them; such keys number
    ``rows / rows_per_slot`` at most, and are broadcast only if they fit.  ``how`` is inner, left, left_semi or left_anti.  How hot keys
    are is estimated from one left row in 64; the estimate decides on slots
    only, and the result is that of a plain join whatever it says.

    Both sides are shuffled: Spark's size estimates do not see what an explode
    or a parse makes of its input, and would broadcast either side on them.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot be spread")
    counted = left.where(F.pmod(F.xxhash64(*row_id), F.lit(COUNT_ONE_IN)) == 0)
    hot, size = measured(
        counted.groupBy(F.xxhash64(on).alias("_hash"))
        .agg((F.count(F.lit(1)) * COUNT_ONE_IN).alias("_rows")).where(F.col("_rows") > rows_per_slot)
        .select("_hash", F.ceil(F.col("_rows") / rows_per_slot).cast("int").alias("_slots")))
    hot = hot.hint("broadcast" if size <= BROADCAST_BYTES else "merge")
    slots = F.coalesce(F.col("_slots"), F.lit(1))

    def with_slots(side):
        return (side.withColumn("_hash", F.xxhash64(on))
                .join(hot, "_hash", "left").drop("_hash"))

    salted = (with_slots(left)
              .withColumn("_slot", F.pmod(F.xxhash64(*row_id), slots).cast("int")).drop("_slots"))
    copied = (with_slots(right)
              .withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("_slots"))
    return salted.join(copied.hint("merge"), [on, "_slot"], how).drop("_slot")


def measured(small: DataFrame) -> tuple[DataFrame, int]:
    """``small`` as a checkpoint, and its bytes: measured, not estimated.

    For a side that may be broadcast if it is as small as thought.
    """
    checkpoint_root(small.sparkSession)
    kept = small.checkpoint()
    row = F.lit(16)
    for name, kind in kept.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            width = F.octet_length(column)
        elif kind.startswith(("array", "map", "struct")):
            width = F.length(F.to_json(F.struct(column)))   # no shorter than what it stands for, but for numbers of one digit
        else:
            width = F.lit(16)
        row = row + F.coalesce(width, F.lit(16))
    return kept, kept.agg(F.sum(row)).first()[0] or 0


def number_within(rows: DataFrame, group: list[str], position: str, name: str,
                  chunk: int = CHUNK) -> DataFrame:
    """``row_number`` from 0 per group in the order of a unique integer position.

    A plain window would sort a whole group in one task.  Here a task sorts one
    chunk of positions, and what is added up over a group is one count per
    chunk.  That is little for dense positions only; give no sparse ones, such
    as those of ``monotonically_increasing_id``.
    """
    chunked = rows.withColumn("_chunk", F.expr(f"`{position}` div {chunk}"))
    in_chunk = Window.partitionBy(*group, "_chunk").orderBy(position)
    counts = chunked.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_chunk",
                            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (chunked.withColumn("_local", F.row_number().over(in_chunk) - 1)
            .join(offsets, [*group, "_chunk"])
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_chunk", "_local", "_before"))


def dense_rank_by(rows: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Numbers all rows from ``start`` on, without gaps, in the order of ``order``.

    Rows are sorted in ranges, a task each.  A row's place in its task is written
    down with it, and only the tasks' counts are added up: a row per task.
    """
    checkpoint_root(rows.sparkSession)
    placed = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_place", F.monotonically_increasing_id()).checkpoint())
    placed = placed.withColumn("_task", F.shiftright("_place", 33))
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (placed.join(F.broadcast(offsets), "_task")
            .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start))
            .drop("_task", "_place", "_before"))


def first_per_key(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key.

    Spark turns the ``= 1`` into a rank limit before the shuffle, so each map
    task sends one row of a key however hot it is.
    """
    window = Window.partitionBy(*key).orderBy(*order)
    return (rows.withColumn("_rank", F.row_number().over(window))
            .where(F.col("_rank") == 1).drop("_rank"))
