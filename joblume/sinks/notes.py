"""Markdown notes, one per record."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joblume.functions.recency import now_column
from joblume.functions.text import flag_text, float_text, iso_timestamp, safe_name
from joblume.operators.records import ARRIVAL
from joblume.plans.specs import HARDWARE, JOBS, SchemaSpec
from joblume.sinks.base import placed, store
from joblume.sinks.note_files import NoteFiles

SPECS = {"jobs": JOBS, "hardware": HARDWARE}


def note_filename(name: Column, niche: str, now: Column, places: list[Column]) -> Column:
    """``niche_name_time_place.md``: one ``now`` stands for the run, so the place tells notes apart."""
    stamp = F.date_format(now, "yyyyMMdd_HHmmss_SSSSSS")
    tail = F.concat_ws("_", *[place.cast("string") for place in places])
    return F.concat(F.lit(f"{niche}_"), safe_name(name), F.lit("_"), stamp, F.lit("_"), tail, F.lit(".md"))


def _shown(column: str, kind: str, quote: bool) -> Column:
    value = {"number": float_text, "flag": flag_text}.get(kind, lambda c: c)(F.col(column))
    if quote and kind == "text":
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        value = F.concat(F.lit('"'), F.regexp_replace(escaped, r"[\r\n]+", " "), F.lit('"'))
    return F.coalesce(value, F.lit("None"))


def note_content(spec: SchemaSpec, columns: list[str], now: Column, yaml_quote: bool = False) -> Column:
    """Front matter with every field but the lists, then the heading.

    Values stand as they are; ``yaml_quote`` makes them safe YAML.
    """
    lines = [F.lit("---")]
    lines += [F.concat(F.lit(f"{f.name}: "), _shown(f.name, f.kind, yaml_quote))
              for f in spec.fields if f.kind != "texts" and f.name in columns]
    name = F.col(spec.name_field) if spec.name_field in columns else F.lit("item")
    company = F.lit("")
    if spec.niche == "jobs":
        company = F.col("empresa") if "empresa" in columns else F.lit("empresa")
    lines += [F.concat(F.lit("extraido_em: "), iso_timestamp(now)), F.lit(f"nicho: {spec.niche}"),
              F.lit("---"), F.lit(""), F.concat(F.lit("# "), name, F.lit(" @ "), company)]
    return F.concat_ws("\n", *lines)


def render_notes(items: DataFrame, niche: str, now: datetime | str | Column,
                 order: list[str] | None = None, yaml_quote: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(niche, path, content) of each record; paths differ by the place of the record."""
    spec, moment = SPECS[niche], now_column(now)
    name = F.col(spec.name_field) if spec.name_field in items.columns else F.lit("item")
    places = [F.col(c) for c in (order or ARRIVAL)]
    return items.select(F.lit(niche).alias("niche"),
                        note_filename(name, niche, moment, places).alias("path"),
                        note_content(spec, items.columns, moment, yaml_quote).alias("content"), *(keep or []))


class NoteTable:
    """Notes as rows of a table, for a file each would drown any file system at scale."""

    def __init__(self, path: str, now, order: list[str] | None = None, yaml_quote: bool = False):
        self.path, self.now, self.order, self.yaml_quote = path, now, order, yaml_quote

    def reset(self, spark: SparkSession) -> None:
        """A run starts without notes, even if it then finds no URL to visit."""
        spark.createDataFrame([], "niche string, path string, content string") \
            .write.mode("overwrite").parquet(self.path)

    def write(self, items: DataFrame, niche: str, batch_id: int | None = None) -> None:
        store(render_notes(items, niche, self.now, self.order, self.yaml_quote, placed(items, batch_id)), self.path, batch_id)


class NoteFolder:
    """Notes as files in a folder all executors have mounted.

    They come into the folder when all tasks have written theirs; a write that
    fails leaves nothing.  A batch that is written again replaces its files.
    """

    def __init__(self, folder: str, now, order: list[str] | None = None, yaml_quote: bool = False):
        self.folder, self.now, self.order, self.yaml_quote = folder, now, order, yaml_quote

    def reset(self, spark: SparkSession | None = None) -> None:
        """Files go, folders stay; a file that cannot go is left."""
        os.makedirs(self.folder, exist_ok=True)
        with os.scandir(self.folder) as entries:
            for entry in entries:
                if entry.is_file():
                    try:
                        os.remove(entry.path)
                    except OSError:
                        pass

    def write(self, items: DataFrame, niche: str, batch_id: int | None = None) -> None:
        items.sparkSession.dataSource.register(NoteFiles)
        (render_notes(items, niche, self.now, self.order, self.yaml_quote).select("path", "content")
         .write.format(NoteFiles.name()).option("folder", self.folder).mode("append").save())
