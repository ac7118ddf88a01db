"""Structured replies: strict validation, quarantine, one row per record.

A reply is parsed to a VARIANT, which keeps the JSON types, and every field is
tested by type: a cast or ``from_json`` would let the number 1 pass as ``'1'``.
All of it happens inside the row of the batch, so a bad record can reject its
batch without any aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblume.functions.text import strip
from joblume.plans.specs import JOBS, Field, SchemaSpec

# What text counts as a flag or as a number.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")
NUMBER_TEXT = (r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?"
               r"|inf|infinity|nan)$")


def parse_json(response: Column) -> Column:
    """The reply as a VARIANT, NULL unless all of it is one JSON value.

    The parser ignores what follows a value.  A reply that closes the list and
    goes on, or brings elements of its own, makes a list of another length
    either as its first element or as its last.
    """
    return _first_of_pair(_parse_pair(response), _parse_pair(response, last=True))


def _parse_pair(response: Column, last: bool = False) -> Column:
    before, behind = ("[0,", "]") if last else ("[", ",0]")
    return F.try_parse_json(F.concat(F.lit(before), response, F.lit(behind)))


def _first_of_pair(pair: Column, turned: Column) -> Column:
    def length(list_):
        return F.size(F.try_variant_get(list_, "$", "array<variant>"))
    return F.when((length(pair) == 2) & (length(turned) == 2), F.try_variant_get(pair, "$[0]", "variant"))


def _type(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column):
    return _type(value) == "STRING", F.try_variant_get(value, "$", "string")


def text_list(value: Column):
    """null is no element, a text is one element; a list holds texts only."""
    elements = F.try_variant_get(value, "$", "array<variant>")
    all_texts = F.forall(elements, lambda e: F.coalesce(_type(e) == "STRING", F.lit(False)))
    ok = F.is_variant_null(value) | (_type(value) == "STRING") | F.coalesce(all_texts, F.lit(False))
    listed = (F.when(F.is_variant_null(value), F.array().cast("array<string>"))
              .when(_type(value) == "STRING", F.array(F.try_variant_get(value, "$", "string")))
              .otherwise(F.transform(elements, lambda e: F.try_variant_get(e, "$", "string"))))
    return ok, listed


def _number(value: Column):
    text = strip(F.try_variant_get(value, "$", "string"))
    from_text = F.when(text.rlike(NUMBER_TEXT), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    kind = _type(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
    number = F.when(kind == "STRING", from_text).when(numeric, F.try_variant_get(value, "$", "double"))
    return number.isNotNull(), number


def _flag(value: Column):
    text = F.lower(F.try_variant_get(value, "$", "string"))
    kind = _type(value)
    number = F.try_variant_get(value, "$", "double")
    numeric = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    flag = (F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
            .when(kind == "STRING", F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False))
            .when(numeric, F.when(number == 1, True).when(number == 0, False)))
    return flag.isNotNull(), flag


_READERS = {"text": _text, "texts": text_list, "number": _number, "flag": _flag}


def _opened(record: Column, spec: SchemaSpec) -> Column:
    """A record as a struct of its fields, NULL where absent; NULL if it is no object."""
    return F.try_variant_get(record, "$", "struct<" + ", ".join(f"{f.name}: variant" for f in spec.fields) + ">")


def _read(record: Column, field: Field):
    value = record[field.name]
    ok, read = _READERS[field.kind](value)
    if field.default is None:
        return F.coalesce(value.isNotNull() & ok, F.lit(False)), read
    absent = value.isNull()
    if field.null_default:
        absent = absent | F.is_variant_null(value)
    return absent | F.coalesce(ok, F.lit(False)), F.when(absent, F.lit(field.default)).otherwise(read)


def _check(record: Column, spec: SchemaSpec) -> Column:
    parts = [_read(record, field) for field in spec.fields]
    ok = record.isNotNull()
    for field_ok, _ in parts:
        ok = ok & field_ok
    value = F.struct(*[read.alias(field.name) for field, (_, read) in zip(spec.fields, parts)])
    return F.struct(ok.alias("ok"), value.alias("value"))


def parse_replies(replies: DataFrame, spec: SchemaSpec = JOBS, per_record: bool = False) -> DataFrame:
    """Adds ``records`` (NULL for a rejected batch) and ``reason`` (NULL for a good one).

    One bad record rejects its batch; ``per_record`` keeps the good ones.

    Both come out of a generator: a filter on them then stays above it, where
    else the optimizer would parse every reply a second time inside the filter.
    """
    reply = F.col("_reply")
    is_object = F.coalesce(_type(reply).startswith("OBJECT"), F.lit(False))
    listed = F.try_variant_get(reply, f"$.{spec.list_field}", "variant")
    records = F.try_variant_get(reply, f"$.{spec.list_field}", "array<variant>")
    if not spec.list_required:
        records = F.when(listed.isNull(), F.array().cast("array<variant>")).otherwise(records)
    checked = F.col("_checked")
    good = F.filter(checked, lambda c: c["ok"]) if per_record else checked
    accepted = F.lit(True) if per_record else F.forall(checked, lambda c: c["ok"])
    judged = (replies
              .withColumn("_pair", _parse_pair(F.col("response")))
              .withColumn("_turned", _parse_pair(F.col("response"), last=True))
              .withColumn("_reply", _first_of_pair(F.col("_pair"), F.col("_turned")))
              .withColumn("_opened", F.when(is_object, F.transform(records, lambda r: _opened(r, spec))))
              .withColumn("_checked", F.transform("_opened", lambda r: _check(r, spec)))
              .withColumn("_good", F.when(accepted, F.transform(good, lambda c: c["value"]))))
    reason = (F.when(F.col("response").isNull(), "no reply")
              .when(reply.isNull(), "no JSON")
              .when(checked.isNull(), "no list")
              .when(F.col("_good").isNull(), "invalid record"))
    return judged.select(*replies.columns, F.inline(F.array(
        F.struct(F.col("_good").alias("records"), reason.alias("reason")))))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Rejected batches with their text and the reason; a missing reply is not invalid."""
    return parsed.where(F.col("reason").isNotNull() & (F.col("reason") != "no reply")).drop("records")


def has_records(parsed: DataFrame) -> DataFrame:
    """Batches that hand on something; the others are only counted."""
    return parsed.where(F.size("records") > 0)


def explode_records(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per record, with its place in the reply; source columns come along as keys."""
    return (parsed.where(F.col("records").isNotNull())
            .select(*keys, F.posexplode("records").alias("pos", "record"))
            .select(*keys, "pos", "record.*"))
