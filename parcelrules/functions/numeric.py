"""Number repair: text to numbers, footnote digits, contaminated lot areas."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions.text import drop_footnotes, let, strip

# Spark's cast also takes '25f' or '25d'; only plain decimal notation counts here.
DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"


def parse_double(text: Column) -> Column:
    # The cast itself ignores the blanks the pattern allows.
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def parse_int(text: Column) -> Column:
    """Whole-number text only: '2' gives 2, '2.5' gives null."""
    return F.when(text.rlike(INTEGER_TEXT), strip(text).try_cast("int"))


def _within(number: Column, bounds: tuple[int, int]) -> Column:
    return number.between(F.lit(bounds[0]), F.lit(bounds[1]))


# A five- or six-digit area above 50,000 whose last four digits are a plausible
# area of 1,000 or more, after one digit or one of the two-digit prefixes.
GLUED_AREA = "^(?:[5-9]|" + "|".join(fv.TWO_DIGIT_PREFIXES) + ")([1-9][0-9]{3})$"


def clean_numeric(text: Column) -> Column:
    """Drop footnotes, then a footnote digit in front of a suspiciously large area.

    Commas are ignored while looking, but kept in text that is not repaired, so
    '8,000' stays unparsable while '65,000' becomes '5000'.
    """
    def repaired(cleaned: Column) -> Column:
        area = F.regexp_extract(F.translate(cleaned, ", ", ""), GLUED_AREA, 1)
        return F.when(area != "", area).otherwise(cleaned)

    return let(drop_footnotes(strip(text)), repaired)


def number_from_text(text: Column) -> Column:
    return let(clean_numeric(text), parse_double)


def footnote_digit(zone_name: Column) -> Column:
    """The zone's footnote digit: a superscript, else the number of R-1/R-2/R-3."""
    mark = F.regexp_extract(zone_name, "[¹²³⁴⁵⁶⁷⁸⁹]", 0)
    digit = F.when(mark != "", F.translate(mark, "¹²³⁴⁵⁶⁷⁸⁹", "123456789"))
    for n in ("1", "2", "3"):
        named = zone_name.contains(f"R-{n}") | zone_name.contains(f"R{n}")
        digit = digit.when(named, F.lit(n))
    return digit


def fix_lot_area(area: Column, zone_name: Column, mode: str = "compatible") -> Column:
    """Undo footnote digits glued to a lot area.

    ``area`` is the number left by :func:`number_from_text`; ``zone_name`` is the
    raw name, '' when the zone has none and null when it is not text (then only
    the two name-free rules apply). ``mode='strict'`` keeps only the repairs that
    have proof: the known values and a superscript in the zone name.
    """
    if mode not in ("compatible", "strict"):
        raise ValueError(mode)
    shown = area.try_cast("bigint").cast("string")
    rest = F.substring(shown, 2, 20).try_cast("bigint")
    known = F.create_map(*[F.lit(float(x)) for pair in fv.KNOWN_LOT_AREAS.items() for x in pair])
    digit = footnote_digit(zone_name)
    by_digit = F.startswith(shown, digit) & _within(rest, fv.PLAUSIBLE_LOT_AREA)
    repaired = F.when(known[area].isNotNull(), known[area])
    if mode == "strict":
        proven = zone_name.rlike("[¹²³⁴⁵⁶⁷⁸⁹]")
        return repaired.when(proven & by_digit, rest.cast("double")).otherwise(area)
    small = (F.length(shown) == 5) & F.substring(shown, 1, 1).isin("1", "2", "3") & _within(rest, fv.SMALL_LOT_AREA)
    large = ((area > fv.LARGE_LOT_ABOVE) & (F.length(shown) > 4) & zone_name.isNotNull()
             & _within(rest, fv.PLAUSIBLE_LOT_AREA))
    # Nothing below 10,000 has a digit to lose.
    return (F.when(area < 10000, area).when(known[area].isNotNull(), known[area]).when(small, rest.cast("double"))
            .when(by_digit, rest.cast("double"))
            .when(large, rest.cast("double"))
            .otherwise(area))
