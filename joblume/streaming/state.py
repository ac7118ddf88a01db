"""First of each key by order, over all micro-batches, with bounded state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from joblume.operators.skew import first_per_key

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CONF = "spark.sql.streaming.stateStore.providerClass"


class FirstByOrder(StatefulProcessor):
    """Lets a record pass if none of its key has passed, or only later ones.

    The state of a key is the place of what passed: the values of the order
    columns, nothing else of the record.
    """

    def __init__(self, order: list[str], place: T.StructType, ttl_ms: int | None):
        self.order, self.place, self.ttl_ms = order, place, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getValueState("passed", self.place, self.ttl_ms)

    def _rank(self, values) -> list[tuple]:
        return [(value is not None, value) for value in values]     # nulls first, as in the batch plan

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = min(rows, key=lambda row: self._rank(row[c] for c in self.order))
        here = tuple(best[c] for c in self.order)
        before = self.passed.get()      # None if nothing has passed; each call to the state costs
        if before is None or self._rank(here) < self._rank(before):
            self.passed.update(here)
            yield Row(**best.asDict(), replaces=before is not None)

    def close(self) -> None:
        pass


def first_by_order(items: DataFrame, key: str, order: list[str], ttl_hours: float | None = None) -> DataFrame:
    """Of each key the first record by ``order`` that a stream has seen so far, with ``replaces``.

    A record passes if its key is new.  One that comes late, but is earlier in
    the order than what has passed, passes as well, and ``replaces`` says that
    it takes the place of that one; what is as late as it or later, a replayed
    record among them, does not pass.  So the first by order of what passed is
    that of a batch over all records, however they arrive: ``settled``.

    The state is on disk (RocksDB) and has a key and a place per key; with
    ``ttl_hours`` a key is forgotten so long after something of it last passed.
    """
    spark = items.sparkSession
    spark.conf.set(_CONF, STATE_STORE)      # the only one that keeps such state
    place = T.StructType([T.StructField(c, items.schema[c].dataType) for c in order])
    out = T.StructType([*items.schema.fields, T.StructField("replaces", T.BooleanType())])
    ttl = None if ttl_hours is None else int(ttl_hours * 3_600_000)
    return items.groupBy(key).transformWithState(FirstByOrder(order, place, ttl), out, "Append",
                                                 "None" if ttl is None else "ProcessingTime")


def settled(passed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The record of each key that no other has replaced, out of a table of what passed."""
    return first_per_key(passed, [key], [F.col(c) for c in order]).drop("replaces")


# so that tasks need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
