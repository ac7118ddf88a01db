"""The list of URLs to visit."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.functions.text import strip


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) to (line_no, url).

    Blank lines go, and lines whose very first character is ``#``; an indented
    ``#`` does not make a comment.  Order and repeats stay.
    """
    return (lines.where(~F.col("value").startswith("#"))
            .select("line_no", strip(F.col("value")).alias("url"))
            .where(F.col("url") != ""))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """The list in a text file; a missing or unreadable one is an empty list.

    ``line_no`` orders the lines of a file; it is not dense.
    """
    try:
        lines = (spark.read.text(path)
                 .select(F.monotonically_increasing_id().alias("line_no"), "value"))
        lines.isEmpty()
    except Exception as failure:
        if not isinstance(failure, AnalysisException) and "FileNotFound" not in str(failure):
            raise
        lines = spark.createDataFrame([], "line_no long, value string")
    return parse_lines(lines)


def first_lines(urls: DataFrame) -> DataFrame:
    """Each URL once, with its first line and how often it is listed.

    A repeated URL can only repeat records that are dropped again as duplicates,
    so the run visits it once.
    """
    return urls.groupBy("url").agg(F.min("line_no").alias("url_no"), F.count(F.lit(1)).alias("n_lines"))
