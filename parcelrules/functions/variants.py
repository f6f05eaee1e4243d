"""Reading semi-structured values.

A key with a JSON null is present (its value is a non-NULL variant); a missing
key gives NULL. ``coalesce`` over untyped values is therefore "the first key that
exists". Objects with known keys are read as structs of variants, which makes a
look-up a field access; objects whose keys matter themselves are read as maps.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelrules.functions.numeric import number_from_text, parse_int
from parcelrules.functions.text import blank_to_null, let

MAP = "map<string,variant>"


def struct_of(keys: list[str]) -> str:
    """The type of an object of which only these keys are read."""
    return "struct<" + ",".join(f"`{k}`:variant" for k in dict.fromkeys(keys)) + ">"


def as_map(value: Column) -> Column:
    """The value as an object, NULL when it is anything else."""
    return F.try_variant_get(value, "$", MAP)


def as_maps(value: Column) -> Column:
    """A list's elements as objects (NULL where an element is none); NULL for no list."""
    return F.try_variant_get(value, "$", f"array<{MAP}>")


def text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_given(value: Column) -> Column:
    """Present and not a JSON null."""
    return value.isNotNull() & ~F.is_variant_null(value)


# A short plain number reads the same as text and as number: nothing to repair.
SHORT_PLAIN = r"^-?[0-9]{1,4}(\.[0-9]{1,6})?$"


def number(value: Column) -> Column:
    """A JSON number as it is; a JSON string after footnote and digit repair."""
    nothing = F.lit(None).cast("double")
    return let(value, lambda v: F.when(v.isNull(), nothing).otherwise(let(
        text(v), lambda t: F.when(t.isNull(), nothing).when(t.rlike(SHORT_PLAIN), t.try_cast("double"))
        .when(kind(v) == "STRING", number_from_text(t)).otherwise(double(v)))))


def whole_number(value: Column) -> Column:
    """A JSON number truncated; a JSON string only if it is a whole number."""
    return let(value, lambda v: F.when(kind(v) == "STRING", parse_int(text(v)))
               .otherwise(double(v).try_cast("int")))


def shown_name(value: Column) -> Column:
    """A zone name as text; blank, zero, false and empty values count as absent."""
    def shown(v: Column) -> Column:
        what = kind(v)
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(what == "STRING", blank_to_null(text(v)))
            .when(what == "BOOLEAN", F.when(text(v) == "true", F.lit("True")))
            .when(what.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.when(double(v) != 0, text(v)))
            .when(what.rlike("^(OBJECT|ARRAY)"), F.when(~text(v).isin("{}", "[]"), text(v))))

    return let(value, shown)
