"""String projections with the semantics of the job, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space plus the four
# separators \x1c-\x1f; the line breaks are the subset that ends a line.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
              "           "
              "    　")
LINE_BREAKS = r"[\n\r\x0b\f\x1c-\x1e\x85  ]+"
CARD_SEPARATOR = "\n\n---\n\n"

# How many code points of a page are kept.
DEFAULT_CHAR_LIMIT = 12000
CONFIGURED_CHAR_LIMIT = 18000

# scheme and authority of a URL
_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` alone drops blanks only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def line_compact(text: Column) -> Column:
    """One stripped line per non-blank line."""
    lines = F.transform(F.split(text, LINE_BREAKS), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def truncate(text: Column, limit: int = CONFIGURED_CHAR_LIMIT) -> Column:
    """The first ``limit`` code points."""
    return F.substring(text, 1, limit)


def card_text(cards: Column) -> Column:
    """Texts of a page's cards as one block each."""
    return F.array_join(cards, CARD_SEPARATOR)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean_url(url), _SCHEME, 1))


def url_authority(url: Column) -> Column:
    """Host with port and user, as written; empty where the URL has none."""
    return F.regexp_extract(_clean_url(url), _AUTHORITY, 1)


def site_name(url: Column) -> Column:
    """First label of the host without ``www.``, first letter upper, the rest lower.

    A host with unbalanced brackets is no valid address and becomes ``Web``.
    """
    host = url_authority(url)
    label = F.split_part(F.replace(host, F.lit("www."), F.lit("")), F.lit("."), F.lit(1))
    named = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substring(label, 2, 1 << 30)))
    return F.when(host.contains("[") != host.contains("]"), F.lit("Web")).otherwise(named)


def _clean_url(url: Column) -> Column:
    # URL parsing ignores control characters and blanks in front, and tabs and
    # line ends anywhere
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def safe_name(name: Column) -> Column:
    """Letters, digits, blanks and ``_`` only; stripped; blanks become ``_``."""
    kept = F.regexp_replace(name, r"[^\p{L}\p{N} _]", "")
    return F.replace(F.trim(kept), F.lit(" "), F.lit("_"))


def iso_timestamp(moment: Column) -> Column:
    """``2024-01-15T12:00:00``, with six decimals only if there are microseconds."""
    whole = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def float_text(number: Column) -> Column:
    """A double the way a note shows it: ``10.5``, ``12000000.0``, ``1e+16``."""
    def digits(count):
        return F.format_string(f"%.{count - 1}e", number)
    # the fewest digits that read back as the same double
    shortest = (F.when(digits(15).try_cast("double") == number, digits(15))
                .when(digits(16).try_cast("double") == number, digits(16)).otherwise(digits(17)))
    plain = F.regexp_replace(shortest.try_cast("decimal(38,20)").cast("string"), r"(\.\d+?)0+$", "$1")
    scientific = F.regexp_replace(shortest, r"\.?0*e", "e")
    size = F.abs(number)
    return (F.when(F.isnan(number), F.lit("nan"))
            .when(size == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
            .when(size == 0, F.when(number.cast("string").startswith("-"), "-0.0").otherwise("0.0"))
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(scientific))


def flag_text(flag: Column) -> Column:
    return F.when(flag, F.lit("True")).otherwise(F.lit("False"))
