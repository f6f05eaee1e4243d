"""Text expressions: trimming, footnote removal, names and labels."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, functions as F

from parcelrules import fixed_values as fv


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def built_once(make):
    """Keep what ``make`` builds (columns that depend on its arguments only) as long as the JVM lives.

    A long expression takes a second to build call by call, and a stream would build it for every batch.
    """
    kept: dict[tuple, tuple] = {}

    @functools.wraps(make)
    def get(*args):
        gateway = SparkContext._gateway
        if args not in kept or kept[args][0] is not gateway:
            made = make(*args)
            kept[args] = (SparkContext._gateway, made)
        return kept[args][1]

    return get


# Every character that counts as white space, not only the blank.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
               "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def drop_footnotes(text: Column) -> Column:
    """Remove superscripts, ``^n`` and ``(n)``, in that order."""
    cleaned = text
    for pattern in (fv.SUPERSCRIPT_RUN, fv.CARET_NOTE, fv.BRACKET_NOTE):
        cleaned = F.regexp_replace(cleaned, pattern, "")
    return F.when(text.rlike(f"[{fv.SUPERSCRIPTS}^(]"), cleaned).otherwise(text)


def clean_zone_name(name: Column) -> Column:
    return strip(drop_footnotes(strip(name)))


def file_suffix(path: Column) -> Column:
    """Lower-case text after the last dot of the last path element, '' if none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def town_from_filename(filename: Column) -> Column:
    """``Doc_`` plus the first 20 safe characters before the first dot."""
    stem = F.split_part(filename, F.lit("."), F.lit(1))
    safe = F.substring(F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_"), 1, 20)
    return F.when(filename != "", F.concat(F.lit("Doc_"), safe))


def job_town_from_filename(filename: Column) -> Column:
    """``Unknown_`` plus the first 30 characters, dots made underscores."""
    head = F.translate(F.substring(filename, 1, 30), ".", "_")
    return F.when(filename != "", F.concat(F.lit("Unknown_"), head))


def human_size(size: Column) -> Column:
    mb = F.lit(1024.0 * 1024.0)
    return F.when(size > mb, F.format_string("%.1f MB", size / mb)).otherwise(
        F.format_string("%.1f KB", size / F.lit(1024.0)))


def prompt_label(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit(" v"), version)
