"""Replies that were paid for: an append-only table that runs share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.operators.batches import ATTEMPTS, WAIT, call_extractor, unanswered
from joblume.operators.skew import spread_join
from joblume.sinks.base import stored

SCHEMA = "request_key string, response string"


def request_key(text: str) -> Column:
    """What is asked of whom: the model, the instruction and the text, which begins with the URLs of its adverts."""
    return F.sha2(F.concat_ws("\0", "model", F.col("messages")[0]["content"], text), 256)


class ReplyLedger:
    """(request_key, response) of every call that was answered, whatever the answer."""

    def __init__(self, path: str):
        self.path = path

    def replies(self, spark: SparkSession) -> DataFrame:
        """One reply per key: two runs at once may both have asked."""
        kept = stored(spark, self.path)
        if kept is None:
            return spark.createDataFrame([], SCHEMA)
        return kept.groupBy("request_key").agg(F.min("response").alias("response"))

    def answer(self, requests: DataFrame, extractor: Callable[[str, str], str], text: str, folder: str,
               call_partitions: int | None = None, attempts: int = ATTEMPTS,
               wait: tuple[float, float] = WAIT) -> DataFrame:
        """Landed ``requests`` with ``response`` and ``call_error``.

        Only requests without a kept reply are sent, equal ones once.  Replies
        are kept before anything is made of them; a call that failed leaves
        nothing, so the next run sends it again.
        """
        spark = requests.sparkSession
        keyed = requests.withColumn("request_key", request_key(text))
        known = self.replies(spark).select("request_key")
        # equal requests may be very many: one row per key and map task is shuffled
        fresh = (keyed.groupBy("request_key").agg(F.first(F.struct("messages", text)).alias("r"))
                 .join(known, "request_key", "left_anti").select("request_key", "r.*"))
        if call_partitions:
            fresh = fresh.repartition(call_partitions)
        calls = f"{folder}/calls"
        call_extractor(fresh, extractor, ["request_key"], text, attempts, wait).write.mode("overwrite").parquet(calls)
        called = spark.read.parquet(calls)
        called.where(F.col("call_error").isNull()).select("request_key", "response") \
            .write.mode("append").parquet(self.path)
        failed = unanswered(keyed.select("request_key").distinct(), called, ["request_key"]).join(called, "request_key")
        replies = (self.replies(spark).withColumn("call_error", F.lit(None).cast("string"))
                   .unionByName(failed.select("request_key", F.lit(None).cast("string").alias("response"), "call_error")))
        place = [c for c in ("url_no", "batch_no") if c in keyed.columns] or [c for c in requests.columns if c != "messages"]
        return spread_join(keyed.drop("messages"), replies, "request_key", "left", place).drop("request_key")
