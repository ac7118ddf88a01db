"""What a sink is, and writing to several of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Sink(Protocol):
    """Takes all final records of a niche at once.

    ``batch_id`` is set by a stream: a batch that is replayed replaces what it
    wrote before.
    """

    def write(self, items: DataFrame, niche: str, batch_id: int | None = None) -> None: ...


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What lies at ``path``; None if nothing does.  A store that cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):   # no folder, or no file in it
            return None
        raise


class BatchInDoubt(RuntimeError):
    """A batch was begun and not committed, and the store cannot be asked what it holds of it."""


class BatchLedger:
    """What became of the batches of a stream in a store that has no part per batch to replace.

    A batch is marked before it is written and again when it is.  A replay of a
    committed batch is skipped.  One that was only begun may have been written,
    wholly, partly or not at all: ``holds(batch_id)``, which asks the store for
    its rows of the batch, tells; without it, and where rows are there, nothing
    is written and the stream stops, as either choice could be wrong.
    """

    def __init__(self, path: str, holds: Callable[[int], bool] | None = None):
        self.path, self.holds = path.rstrip("/"), holds

    def marked(self, spark: SparkSession, mark: str, batch_id: int) -> bool:
        return stored(spark, f"{self.path}/{mark}/batch_id={batch_id}") is not None

    def mark(self, spark: SparkSession, mark: str, batch_id: int) -> None:
        spark.createDataFrame([(mark,)], "mark string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/{mark}/batch_id={batch_id}")

    def once(self, spark: SparkSession, batch_id: int, write: Callable[[], None]) -> None:
        if self.marked(spark, "committed", batch_id):
            return
        if self.marked(spark, "begun", batch_id) and (self.holds is None or self.holds(batch_id)):
            raise BatchInDoubt(f"batch {batch_id} was begun and not committed: see what the store holds of it, then "
                               f"commit it in {self.path} or take its rows out")
        self.mark(spark, "begun", batch_id)
        write()
        self.mark(spark, "committed", batch_id)


def store(frame: DataFrame, path: str, batch_id: int | None, format: str = "parquet",
          mode: str = "append", ledger: BatchLedger | None = None, **options) -> None:
    """Writes a frame; a batch of a stream replaces its own part, or is written once by the ledger."""
    if batch_id is not None and path:
        path, mode = f"{path.rstrip('/')}/batch_id={batch_id}", "overwrite"
    writer = frame.write.format(format).mode(mode).options(**options)
    if path:
        writer.save(path)
    elif batch_id is None:
        writer.save()
    elif ledger is None:
        raise ValueError(f"a stream needs a store with a path, or a ledger of batches; {format} without either would "
                         "be overwritten or repeated")
    else:
        ledger.once(frame.sparkSession, batch_id, writer.save)


# what a stream adds to the rows of a store, so that a record that turns out not to be the first of its key can be told
PLACED = ["item_key", "item_place"]


def placed(items: DataFrame, batch_id: int | None) -> list[str]:
    """The columns of PLACED that a sink keeps."""
    return [c for c in PLACED if batch_id is not None and c in items.columns]


def current(spark: SparkSession, path: str, places: str) -> DataFrame:
    """What a stream's store holds, without rows of records that an earlier one has replaced.

    ``places`` is the table of what passed, which the stream writes and never reads.
    """
    first = (spark.read.parquet(places).groupBy("item_key").agg(F.min("item_place").alias("item_place")))
    return spark.read.parquet(path).join(first, PLACED, "left_semi").drop(*PLACED, "batch_id")


def fan_out(items: DataFrame, sinks: Sequence[Sink], niche: str, batch_id: int | None = None) -> DataFrame:
    """Writes to every sink in turn; one that fails does not stop the others.

    Give a landed table: each sink reads it.  Returns (sink_no, sink, error).
    """
    status = []
    for number, sink in enumerate(sinks):
        try:
            sink.write(items, niche, batch_id)
            status.append((number, type(sink).__name__, None))
        except Exception as failure:
            status.append((number, type(sink).__name__, f"{type(failure).__name__}: {failure}"))
    return items.sparkSession.createDataFrame(status, "sink_no int, sink string, error string")
