"""The run as a command: ``spark-submit`` this, or ``python -m joblume``."""

from __future__ import annotations

import argparse
from datetime import datetime
from importlib import import_module

from pyspark.sql import SparkSession

from joblume.functions.text import CONFIGURED_CHAR_LIMIT
from joblume.operators.links import BATCH_SIZE
from joblume.plans.run import lost_details, run
from joblume.plans.specs import HARDWARE, JOBS
from joblume.sinks.jobs_table import JobsTable
from joblume.sinks.notes import NoteTable
from joblume.sinks.tickets import TicketOutbox
from joblume.sources.url_list import read_url_list


def parse_arguments(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="joblume", description="Page snapshots to records.")
    parser.add_argument("--urls", required=True, help="text file with a URL a line")
    parser.add_argument("--pages", required=True, help="parquet table (page_id, url, html)")
    parser.add_argument("--output", required=True, help="folder of the stores")
    parser.add_argument("--extractor", required=True, help="module:function from (system, text) to JSON")
    parser.add_argument("--known-titles", help="parquet table (title) of tickets that exist")
    parser.add_argument("--niche", choices=["jobs", "hardware"], default="jobs")
    parser.add_argument("--char-limit", type=int, default=CONFIGURED_CHAR_LIMIT, help="characters of a page's text")
    parser.add_argument("--batch-size", type=int, default=BATCH_SIZE, help="adverts of an extraction request")
    parser.add_argument("--stored", help="parquet table (item_key) of records that are not stored again")
    parser.add_argument("--ledger", help="folder of replies that runs share; default: below the output")
    parser.add_argument("--store-format", default="parquet", help="format of the jobs table, say jdbc")
    parser.add_argument("--store-option", action="append", default=[], metavar="NAME=VALUE", help="option of that format")
    parser.add_argument("--rule", action="append", default=[], metavar="NAME=CONDITION",
                        help="rule of the jobs table; rows that break it are set aside")
    parser.add_argument("--now", type=datetime.fromisoformat, default=None, help="default: the clock")
    return parser.parse_args(arguments)


def pairs(texts: list[str]) -> dict[str, str]:
    return dict(text.split("=", 1) for text in texts)


def main(arguments: list[str] | None = None) -> None:
    args = parse_arguments(arguments)
    spark = SparkSession.builder.appName("joblume").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"{args.output}/checkpoints")
    module, function = args.extractor.split(":")
    now = args.now or datetime.now()
    known = spark.read.parquet(args.known_titles) if args.known_titles else None
    sinks = [NoteTable(f"{args.output}/notes", now)]
    if args.niche == "jobs":
        path = f"{args.output}/jobs" if args.store_format == "parquet" else ""
        sinks += [TicketOutbox(f"{args.output}/tickets", known, index=f"{args.output}/titles"),
                  JobsTable(path, now, args.store_format, constraints=pairs(args.rule), rejects=f"{args.output}/jobs-rejects",
                            **pairs(args.store_option))]
    done = run(spark, read_url_list(spark, args.urls), spark.read.parquet(args.pages), now,
               getattr(import_module(module), function), sinks,
               work_dir=f"{args.output}/work", spec=JOBS if args.niche == "jobs" else HARDWARE,
               char_limit=args.char_limit, batch_size=args.batch_size, ledger=args.ledger or f"{args.output}/replies",
               stored=spark.read.parquet(args.stored) if args.stored else None)
    for name, frame in (("counters", done.counters), ("quarantine", done.quarantine), ("dead_letters", done.dead_letters),
                        ("lost_details", lost_details(done.listings, spark.read.parquet(args.pages)))):
        frame.write.mode("overwrite").parquet(f"{args.output}/{name}")
    done.status.show(truncate=False)
    print(done.seen)


if __name__ == "__main__":
    main()
