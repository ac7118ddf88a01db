"""The remote title list as landed pages: a file each, that names the page after it."""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES_PER_TASK = 64
SCHEMA = "page_no long, next_page long, nodes array<struct<content: struct<title: string>>>"


class TitlePages(DataSource):
    """``title_pages``: the pages below the option ``path``, as ``land_title_pages`` writes them.

    A file that is no JSON, or no page, is a page that failed: NULL nodes.
    """

    @classmethod
    def name(cls) -> str:
        return "title_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def _system(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs
        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        paths = sorted(f.path for f in found if f.is_file and re.search(r"/page_no=\d+/part-[^/]*$", f.path))
        return [_Files(paths[i:i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = self._system()
        for path in partition.paths:
            number = int(re.search(r"/page_no=(\d+)/", path)[1])
            try:
                with system.open_input_stream(path) as file:
                    page = json.loads(file.read())
                nodes = [_node(node) for node in page["nodes"]]
                yield number, page.get("next_page"), nodes
            except (ValueError, KeyError, TypeError, AttributeError):
                yield number, None, None


def _node(node: dict | None):
    content = (node or {}).get("content")
    return None if node is None else (None if content is None else (content.get("title"),),)


def land_title_pages(pages: DataFrame, path: str) -> None:
    """(page_no, body), a page's JSON, to a file each."""
    pages.select("page_no", "body").repartition("page_no").write.partitionBy("page_no").mode("append").text(path)


def read_title_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_no, nodes) up to where following ``next_page`` from page 0 ends.

    It ends behind the page that names no other, and before one that failed or
    never landed.  Pages are read side by side; where the chain ends is worked
    out from their numbers.
    """
    spark.dataSource.register(TitlePages)
    pages = spark.read.format("title_pages").option("path", path).load()
    numbers = pages.select("page_no", "next_page", F.col("nodes").isNull().alias("failed")).checkpoint()
    # what a page before it should name but does not, or what is not there
    links = numbers.select(F.col("page_no").alias("from_page"), F.col("next_page").alias("to_page"))
    ends = (numbers.where("failed").select("page_no")
            .unionByName(numbers.where("next_page IS NULL AND NOT failed").select((F.col("page_no") + 1).alias("page_no")))
            .unionByName(links.where("to_page IS NOT NULL").join(
                numbers.select(F.col("page_no").alias("to_page")), "to_page", "left_anti")
                .select(F.col("to_page").alias("page_no"))))
    end = ends.agg(F.min("page_no")).first()[0]
    return pages.select("page_no", "nodes").where(F.col("page_no") < (0 if end is None else end))


# so that tasks need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
