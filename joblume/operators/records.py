"""From parsed records to final ones: dedupe, required fields, link and origin repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblume.functions.text import is_blank, site_name, url_authority, url_scheme
from joblume.operators.skew import first_per_key

# Origins that say nothing.
UNKNOWN_ORIGINS = ("desconhecida", "unknown")

# the order in which records arrive
ARRIVAL = ["url_no", "batch_no", "pos"]


def item_key(parts: tuple[str, ...] = ("titulo", "empresa")) -> Column:
    """Lower-cased fields joined by ``|``, not trimmed."""
    return F.concat_ws("|", *[F.lower(part) for part in parts])


def dedupe_first(items: DataFrame, order: list[str] | None = None,
                 key_parts: tuple[str, ...] = ("titulo", "empresa")) -> DataFrame:
    """The first record of each key in order of arrival."""
    return first_per_key(items.withColumn("item_key", item_key(key_parts)), ["item_key"], order or ARRIVAL)


def require_fields(items: DataFrame, fields: tuple[str, ...] = ("titulo", "empresa")) -> DataFrame:
    """Drops records with a blank field.  Comes after the dedupe, as a blank record takes its key."""
    for field in fields:
        items = items.where(~is_blank(F.col(field)))
    return items


def repaired_link(link: Column, source: Column) -> Column:
    """A link without ``http`` is a path on the site of its source."""
    path = F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))
    absolute = F.concat(url_scheme(source), F.lit("://"), url_authority(source), path)
    return F.when(link.contains("http"), link).otherwise(absolute)


def filled_origin(origin: Column, source: Column) -> Column:
    """An empty or unknown origin becomes the name of the source's site."""
    unknown = (origin == "") | F.lower(origin).isin(*UNKNOWN_ORIGINS)
    return F.when(unknown, site_name(source)).otherwise(origin)


def repair(items: DataFrame) -> DataFrame:
    return items.withColumns({
        "link_inscricao": repaired_link(F.col("link_inscricao"), F.col("source_url")),
        "origem": filled_origin(F.col("origem"), F.col("source_url")),
    })


def finalize(items: DataFrame, order: list[str] | None = None) -> DataFrame:
    return repair(require_fields(dedupe_first(items, order)))


def drop_stored(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Leaves out records stored by earlier runs; ``stored`` may repeat its keys."""
    return items.join(stored.select("item_key").distinct(), "item_key", "left_anti")
