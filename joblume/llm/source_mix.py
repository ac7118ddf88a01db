"""Mixing sources to target weights: block quotas split over output shards by a hypergeometric tree.

Everything is DataFrame operations.  A source of n documents is cut into about
sqrt(n) blocks by a hash, so both the blocks of a source and the documents of a
block number about sqrt(n), and no window holds more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from joblume.llm.common import WORD, land

WEIGHTS = (3, 1, 2)  # by code point order of the sources, null last, repeating
SHARE = 1.5  # of all words
MOST = 2.0  # a document is taken so often at most
SHARDS = 16  # output shards, a power of two
SEED = 20240115


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(_source, source_size, n_docs, target) of each source.

    Targets share ``share`` of all words by weight; one that would pass ``most``
    times its source stops there, and what it leaves goes to the others by
    weight.  That is: all get ``level`` times their weight or their ceiling, and
    the level is read off the sources in the order in which they reach it.
    """
    sources = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy("_source")  # one row per source
    listed = sources.withColumn("_weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    ceiling = F.col("source_size") * most
    reach = Window.orderBy("_reach", "_source")
    before = reach.rowsBetween(Window.unboundedPreceding, -1)
    levels = (listed.withColumn("_reach", ceiling / F.col("_weight"))
              .withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
              .withColumn("_left", F.col("_all") * share - F.coalesce(F.sum(ceiling).over(before), F.lit(0.0)))
              .withColumn("_rest", F.sum("_weight").over(reach.rowsBetween(0, Window.unboundedFollowing)))
              .withColumn("_level", F.col("_left") / F.col("_rest"))
              .withColumn("_stops", F.col("_reach") <= F.col("_level")))
    # the first source that does not stop sets the level for itself and all after it
    return (
        levels.withColumn("_free", F.min(F.when(~F.col("_stops"), F.struct("_reach", "_source", "_level")))
                          .over(Window.partitionBy()))
        .select("_source", "source_size", "n_docs",
                F.least(ceiling, F.coalesce(F.col("_free._level") * F.col("_weight"), ceiling)).alias("target")))


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(_source, shard, quota): block quotas (_source, quota) dealt to ``shards`` by a tree.

    Each node gives one half of its blocks to either child.  How many of each
    source is a draw from the multivariate hypergeometric distribution, made by
    going through the blocks and choosing each with the chance that what is
    still to be chosen has among what is left.  Sums by source stay exact.
    """
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("_source", F.col("quota").cast("long").alias("quota"))))
                       .alias("_quotas")).select(F.lit(1).cast("long").alias("_node"), "_quotas")
    start = "CAST(0 AS BIGINT)"
    width = 1
    while width < shards:
        draw = f"""
          aggregate(_quotas,
            named_struct('rest', aggregate(_quotas, {start}, (n, q) -> n + q.quota),
                         'due', aggregate(_quotas, {start}, (n, q) -> n + q.quota) div 2,
                         'left', CAST(array() AS ARRAY<BIGINT>)),
            (acc, q) -> transform(array(
              aggregate(IF(q.quota > 0, sequence(CAST(1 AS BIGINT), q.quota), CAST(array() AS ARRAY<BIGINT>)),
                named_struct('rest', acc.rest, 'due', acc.due, 'got', {start}),
                (s, i) -> IF(shiftrightunsigned(xxhash64(_node, q._source, i, {SEED}), 11) / {float(1 << 53)!r}D
                               * s.rest < s.due,
                             named_struct('rest', s.rest - 1, 'due', s.due - 1, 'got', s.got + 1),
                             named_struct('rest', s.rest - 1, 'due', s.due, 'got', s.got)))),
              s -> named_struct('rest', s.rest, 'due', s.due, 'left', array_append(acc.left, s.got)))[0]).left"""
        nodes = nodes.select("_node", "_quotas", F.expr(draw).alias("_left")).select(F.explode(F.array(
            F.struct((F.col("_node") * 2).alias("_node"), F.expr(
                "transform(_quotas, (q, i) -> named_struct('_source', q._source, 'quota', _left[i]))").alias("_quotas")),
            F.struct((F.col("_node") * 2 + 1).alias("_node"), F.expr(
                "transform(_quotas, (q, i) -> named_struct('_source', q._source, 'quota', q.quota - _left[i]))")
                .alias("_quotas")))).alias("_child")).select("_child.*")
        nodes = land(nodes, "quotas")  # else the draws of a level are made again for each use
        width *= 2
    return (nodes.select((F.col("_node") - width).cast("int").alias("shard"), F.explode("_quotas").alias("_q"))
            .select("_q._source", "shard", "_q.quota"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
                shards: int = SHARDS) -> DataFrame:
    """Takes words of each source up to its target, dealt to output shards.

    Returns doc_id, text_hash, source, size (words), source_size, target (the
    source's), taken (words that the mix takes, repeats counted), copies (whole
    documents that come nearest to that) and draws, an array of (pass, shard,
    words, place); reading a shard in the order of place reads it shuffled.

    A source is gone through as a whole as often as its target allows; the last
    pass takes blocks in a random order, and within the block and the document
    where the target ends as many documents and words as are left, so that
    taken adds up to the rounded target.

    A null or empty text has no words: its size and taken are 0.  A null source
    is a source of its own, null and repeated doc_ids are rows like any other
    (equal rows are as good as each other), and a source without words has
    target 0.  An empty table gives an empty table; other columns are not read.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    sizes = land(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.xxhash64(text).alias("text_hash"),
        # '0' before names and '1' for null: strings compare by code point
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = land(source_targets(sizes, weights, share, most)
                   .withColumn("_blocks", F.ceil(F.sqrt("n_docs")).cast("long"))
                   .withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                               .otherwise(0).cast("long"))
                   .withColumn("_rest", (F.round("target").cast("long") - F.col("_passes") * F.col("source_size"))),
                   "targets")
    rows = sizes.join(targets.select("_source", "_blocks"), "_source") \
        .withColumn("_order", F.xxhash64("doc_id", "text_hash", F.lit(SEED))) \
        .withColumn("_block", F.pmod(F.xxhash64("_order", F.lit(SEED + 1)), "_blocks")).drop("_blocks")

    permuted = Window.partitionBy("_source").orderBy(F.xxhash64("_source", "_block", F.lit(SEED + 2)), "_block")
    blocks = land(rows.groupBy("_source", "_block").agg(F.sum("size").alias("_words"))
                  .join(targets, "_source")
                  .withColumn("_before", F.coalesce(F.sum("_words").over(
                      permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                  # words that the last pass takes of the block
                  .withColumn("_last", F.greatest(F.lit(0), F.least("_words", F.col("_rest") - F.col("_before")))),
                  "blocks")
    passes = blocks.select("_source", "_block", F.explode(F.filter(
        F.sequence(F.lit(0), F.lit(int(most))),
        lambda p: (p < F.col("_passes")) | ((p == F.col("_passes")) & (F.col("_last") > 0)))).alias("pass"))
    drawn = passes.withColumn("_rank", F.row_number().over(Window.partitionBy("_source").orderBy(
        F.xxhash64("_source", "_block", "pass", F.lit(SEED + 3)), "_block", "pass")) - 1)
    quotas = drawn.groupBy("_source").agg(F.count(F.lit(1)).alias("quota"))
    dealt = split_quotas(quotas, shards)
    upto = Window.partitionBy("_source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranks = (dealt.withColumn("_from", F.coalesce(F.sum("quota").over(upto), F.lit(0))).where("quota > 0")
             .select("_source", "shard", F.explode(F.sequence(
                 F.col("_from"), F.col("_from") + F.col("quota") - 1)).alias("_rank")))
    placed = (drawn.join(ranks, ["_source", "_rank"]).groupBy("_source", "_block")
              .agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_draws")))
    plan = land(blocks.join(placed, ["_source", "_block"], "left").select(
        "_source", "_block", "source_size", "target", "_passes", "_last", "_words",
        F.coalesce("_draws", F.expr("CAST(array() AS ARRAY<STRUCT<pass: INT, shard: INT>>)")).alias("_draws")), "plan")

    # Where the target ends inside a block, its documents are gone through one by one.
    cut = (F.col("_last") > 0) & (F.col("_last") < F.col("_words"))
    joined = rows.join(plan, ["_source", "_block"])
    in_block = Window.partitionBy("_source", "_block").orderBy("_order", "doc_id", "text_hash")
    ended = joined.where(cut).withColumn("_before", F.coalesce(F.sum("size").over(
        in_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("_words_last", F.greatest(F.lit(0), F.least("size", F.col("_last") - F.col("_before")))) \
        .drop("_before")
    whole = joined.where(~cut).withColumn("_words_last", F.when(F.col("_last") > 0, F.col("size")).otherwise(0))
    taken = F.col("_passes") * F.col("size") + F.col("_words_last")
    draws = F.filter(F.transform("_draws", lambda d: F.struct(
        d["pass"].alias("pass"), d["shard"].alias("shard"),
        F.when(d["pass"] < F.col("_passes"), F.col("size")).otherwise(F.col("_words_last")).alias("words"),
        F.xxhash64("_order", d["pass"], d["shard"], F.lit(SEED + 4)).alias("place"))), lambda d: d["words"] > 0)
    return ended.unionByName(whole).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.floor(taken / F.col("size") + 0.5)).otherwise(0).cast("int").alias("copies"),
        draws.alias("draws"))
