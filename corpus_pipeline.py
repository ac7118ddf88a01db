"""A training corpus out of documents, in five stages of corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet below the shared folder and rereads it as the next one's ``docs``.
All but the last return the columns of their ``docs``.  Rows of null text or
null ids, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from joblume.llm.balanced_shards import balance_shards
from joblume.llm.common import KEY, identified, land, table
from joblume.llm.decontamination import leaked_items
from joblume.llm.jaccard_join import link_documents
from joblume.llm.language_id import UNDETERMINED, identify_language, learn_profiles
from joblume.llm.source_mix import mix_sources

# A text whose n-grams lie further than this from every language is in none of them.
LEAST_LANGUAGE_SCORE = 0.25


def _whole(docs: DataFrame) -> list:
    """A row in one column, so that no name of ``docs`` clashes with those used here."""
    return [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what is in no language: texts without letters, and those far from every profile."""
    found = identify_language(docs, learn_profiles(docs), _whole(docs))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)) \
        .select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near duplicates, and one of repeated rows."""
    linked = land(link_documents(docs), "linked")
    # a document without words is a group of its own
    own = F.when(F.col("n") == 0, F.struct(*KEY))
    kept = linked.groupBy("root", own.alias("own")).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    rows = identified(docs, *_whole(docs)).drop("text").join(kept, KEY, "left_semi")
    same = Window.partitionBy(*KEY).orderBy(F.xxhash64("_row"))
    return rows.withColumn("_rank", F.row_number().over(same)).where("_rank = 1").select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    leaks = leaked_items(docs, table(spark, sf_dir, "benchmark")).select(*KEY).distinct()
    return identified(docs, *_whole(docs)).drop("text").join(leaks, KEY, "left_anti").select("_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, as a whole: not at all, once or twice."""
    key = ["_id", "_hash", "_source"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def keyed(frame, hash_):
        return (F.coalesce(frame["doc_id"].cast("long"), F.lit(2**63 - 1)).alias("_id"), hash_.alias("_hash"),
                F.when(frame["source"].isNull(), "1").otherwise(F.concat(F.lit("0"), frame["source"].cast("string")))
                .alias("_source"))

    mixed = mix_sources(docs)
    # equal rows share what is taken of them, one after the other
    copies = mixed.select(*keyed(mixed, F.col("text_hash")), "copies").where("copies > 0") \
        .groupBy(*key).agg(F.array_sort(F.collect_list("copies")).alias("_copies"))
    rows = docs.select(*keyed(docs, F.xxhash64(text)), *_whole(docs))
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("_row")))
    return (rows.join(copies, key).withColumn("_turn", turn).where(F.col("_turn") <= F.size("_copies"))
            .select("_row", F.explode(F.sequence(F.lit(1), F.element_at("_copies", F.col("_turn")))).alias("_copy"))
            .select("_row.*"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row goes: a shard of near equal bytes and a slot in it."""
    return balance_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mix", mix),
    ("sharding", shard),
]

#: n-gram ranks, similarity joins and a latent space are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
