"""The relational table of adverts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.functions.recency import now_column
from joblume.operators.records import ARRIVAL
from joblume.operators.skew import dense_rank_by
from joblume.session import checkpoint_root
from joblume.sinks.base import BatchLedger, placed, store, stored

COLUMNS = ["titulo", "empresa", "localizacao", "origem", "salario", "requisitos", "link_inscricao"]


def joined_list(values: Column) -> Column:
    return F.array_join(values, ", ")


def job_rows(items: DataFrame, now, *others: str) -> DataFrame:
    """Flat rows as stored, without the surrogate key.  Lengths are not enforced."""
    return items.select(*[joined_list(F.col(c)).alias(c) if c == "requisitos" else F.col(c) for c in COLUMNS],
                        now_column(now).alias("extraido_em"), *others)


def broken_rules(constraints: dict[str, str]) -> Column:
    """Names of the store's constraints that a row breaks; what comes out unknown is broken, too."""
    broken = [F.when(F.coalesce(F.expr(rule), F.lit(False)), None).otherwise(name) for name, rule in constraints.items()]
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


class JobsTable:
    """Appends one row per record, whatever the niche it is told; makes the table if absent.

    ``constraints`` are the rules of the store (a name and a condition on the
    row), as its table declares them: a row that breaks any is not written but
    set aside, with the names of the rules, in ``rejects`` (by default beside
    the table), and all others are stored.

    ``id`` goes on from the largest stored one without a gap, in the order of
    ``order``.  How far it went is noted per write beside the table, so that a
    write does not read what is stored.

    Another ``format`` (say ``jdbc``) with its ``options`` writes elsewhere; the
    key then is the store's own.  A stream into a store without a path needs a
    ``ledger``.
    """

    def __init__(self, path: str = "", now=None, format: str = "parquet", order: list[str] | None = None,
                 constraints: dict[str, str] | None = None, rejects: str | None = None,
                 ledger: BatchLedger | None = None, **options):
        self.path, self.now, self.format, self.order = path, now, format, order
        self.constraints, self.ledger, self.options = constraints or {}, ledger, options
        self.rejects = rejects or (f"{path.rstrip('/')}-rejects" if path else "")
        self.ids = f"{path.rstrip('/')}-ids"
        if self.constraints and not self.rejects:
            raise ValueError("rows that the store refuses need a place: name a table of rejects")

    def last_id(self, spark: SparkSession, batch_id: int | None) -> int:
        """The largest id given so far; a replayed batch does not count itself."""
        notes = stored(spark, self.ids)
        if notes is None:   # a table from before ids were noted
            rows = stored(spark, self.path)
            return 0 if rows is None else rows.agg(F.max("id")).first()[0] or 0
        if batch_id is not None and "batch_id" in notes.columns:
            notes = notes.where(F.coalesce(F.col("batch_id") != batch_id, F.lit(True)))
        return notes.agg(F.max("last_id")).first()[0] or 0

    def write(self, items: DataFrame, niche: str, batch_id: int | None = None) -> None:
        spark = items.sparkSession
        order = [c for c in self.order or ARRIVAL if c in items.columns]
        carried = placed(items, batch_id)
        rows = job_rows(items, self.now, *[c for c in order if c not in COLUMNS and c not in carried], *carried)
        if self.constraints:
            checkpoint_root(spark)
            judged = rows.withColumn("_broken", broken_rules(self.constraints)).checkpoint()
            aside = judged.where(F.size("_broken") > 0).select(
                *COLUMNS, "extraido_em", *carried, F.array_join("_broken", ", ").alias("reason"))
            store(aside, self.rejects, batch_id)
            rows = judged.where(F.size("_broken") == 0).drop("_broken")
        final = [*COLUMNS, "extraido_em", *carried]
        if self.format != "parquet" or not self.path:
            store(rows.select(*final), self.path, batch_id, self.format, ledger=self.ledger, **self.options)
            return
        start = self.last_id(spark, batch_id)
        numbered = dense_rank_by(rows, order or COLUMNS, "id", start + 1).select("id", *final)
        store(numbered, self.path, batch_id, self.format, **self.options)
        last = spark.createDataFrame([(start + numbered.count(),)], "last_id long")     # of what is checkpointed
        store(last.coalesce(1), self.ids, batch_id)
