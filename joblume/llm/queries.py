"""One query per corpus operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from joblume.llm import oracle
from joblume.llm.balanced_shards import balance_shards
from joblume.llm.common import table
from joblume.llm.decontamination import find_leaks
from joblume.llm.embedding_dedup import near_duplicate_vectors
from joblume.llm.jaccard_join import near_duplicate_classes
from joblume.llm.language_id import learn_and_identify
from joblume.llm.line_dedup import remove_repeated_lines
from joblume.llm.periodic_runs import collapse_runs
from joblume.llm.source_mix import mix_sources
from joblume.llm.substring_dedup import remove_repeated_substrings
from joblume.llm.token_alignment import align_tokens, count_links, group_texts
from joblume.llm.token_counts import count_tokens
from joblume.llm.toxicity import score_toxicity
from joblume.llm.vector_search import nearest_vectors


def tokenizer_path(name="byte_bpe_50k.json"):
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_embedding_dedup(spark, sf_dir):
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_source_mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")) \
        .select("doc_id", "size", "source_size", "target", "taken", "source", "draws")


def op4_line_dedup(spark, sf_dir):
    return remove_repeated_lines(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op5_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark, sf_dir):
    return learn_and_identify(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_substring_dedup(spark, sf_dir):
    return remove_repeated_substrings(table(spark, sf_dir, "documents")) \
        .select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_balanced_shards(spark, sf_dir):
    return balance_shards(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_vector_search(spark, sf_dir):
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_token_alignment(spark, sf_dir):
    aligned = align_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    texts = group_texts(aligned).select("_row", "doc_id", digest.alias("groups_sha256"))
    return texts.join(count_links(aligned), "_row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def with_planted_periods(docs):
    """Documents as op13 takes them: in one of ten, by its id's CRC, words are repeated from some place on."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words")) \
        .withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10")) \
        .withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))) \
        .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = "transform(sequence(0L, n - 1L), i -> element_at(words, CAST(1 + if(i < a, i, a + (i - a) % p) AS INT)))"
    return planted.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN array_join({repeated}, ' ') ELSE text END").alias("text"))


def op13_periodic_runs(spark, sf_dir):
    found = collapse_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # greatest length / period, then smallest start and period, without a fraction
    first = F.get(F.expr("""array_sort(runs, (x, y) -> CASE
        WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1)
        WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1)
        WHEN x.period <> y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END)"""), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("kept_text", 256).alias("collapsed_sha256"))


def queries():
    return {query.__name__: query for query in (op1_embedding_dedup, op2_token_counts, op3_source_mix, op4_line_dedup, op5_toxicity, op6_language_id, op7_decontamination,
                                            op8_substring_dedup, op9_balanced_shards, op10_jaccard_join, op11_vector_search,
                                            op12_token_alignment, op13_periodic_runs)}


def oracle_sql():
    return {"op1_embedding_dedup": oracle.EMBEDDING_DEDUP, "op4_line_dedup": oracle.LINE_DEDUP,
            "op8_substring_dedup": oracle.SUBSTRING_DEDUP, "op10_jaccard_join": oracle.JACCARD_JOIN}
