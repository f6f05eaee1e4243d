"""Rules read out of an ordinance by its own wording: headings, clauses and dimensional tables.

A text is cut at its zone headings. A section is read once, token by token: phrases that name a field,
numbers with their unit, words for accessory buildings, yards and sides, references, and the ends of
clauses. A fold over the tokens keeps what is being spoken of and gives each number to it, if the
unit fits; of several numbers for one field the first counts. A table whose first
column is the zone is read by its header row. Nothing is shuffled. The fold is a small state machine over
Arrow batches of texts: as expressions it would be a lambda per token, which Spark interprets (measured: six times slower).

What the fold knows: the field last named (a comma doesn't end it, but a number without a unit
behind a comma isn't taken), whether the clause is on accessory buildings (until ``;``, a line's or a sentence's
end), and whether yards are the subject, so that 'setbacks: front 25 feet, side 10 feet' names sides only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from parcelrules import fixed_values as fv

# --- headings ---------------------------------------------------------------------------

# 'Zone R-1', 'district r-2a', 'Zone PLANNED', 'Zone Highway Commercial:'; footnote signs behind the name are dropped.
NOTE = r"(?:[¹²³⁰⁴-⁹]+|\^[0-9]+|\([0-9]+\))?"
CODE = r"[A-Za-z]{1,5}-?[0-9]+[A-Za-z]?(?:-[A-Za-z0-9]{1,3})*|[A-Z]{1,5}-[A-Z0-9]{1,4}|[A-Z][A-Z]+|[A-Z]"
NO_NAME = r"(?!(?:Requirements?|Regulations?|Standards?|Boundar\w*|Maps?|Boards?|Codes?|Ordinances?|Laws?|Plans?|Changes?|Officers?)\b)"
NAME = NO_NAME + r"[A-Z][a-z]+(?: (?:and |of )?[A-Z][a-z]+){0,3}"
ENDS = r"[ \t]*(?:[:\n(]|[-–—] |$|(?:requirements|regulations|standards|shall)\b)"
HEADING = re.compile(rf"\b(?i:zone|district)[ \t]+(?:({CODE}){NOTE}(?![\w-])|({NAME}){NOTE}(?={ENDS}))")
TOWN = re.compile(r"\b(?:Town|City|Borough|Township|Village) of "
                  r"([A-Z][\w'-]*(?: (?!Zoning|Land|Ordinance|Code)[A-Z][\w'-]*)*)")
COUNTY = re.compile(r"County:\s*([A-Z][\w'-]*(?: [A-Z][\w'-]*)*)")

# --- tokens -----------------------------------------------------------------------------

FIELDS = list(fv.PHRASES)
AREA, DENSITY = (FIELDS.index(n) for n in ("interior_min_lot_area_sqft", "maximum_density_units_per_acre"))
FRONTAGE, WIDTH, DEPTH = (FIELDS.index(f"interior_min_lot_{x}_ft") for x in ("frontage", "width", "depth"))
SIDES = [FIELDS.index(f"principal_min_{side}_yard_ft") for side in ("front", "side", "rear")]
COVERAGES = [FIELDS.index(n) for n in ("max_building_coverage_percent", "max_lot_coverage_percent")]
ANY_AREA, STORIES, ACCESSORY_SIDE = 20, 21, 30           # further targets; accessory sides are 30, 31, 32
IN_FEET = {*(i for i, n in enumerate(FIELDS) if n.endswith(("_ft", "_feet"))), *range(ACCESSORY_SIDE, ACCESSORY_SIDE + 3)}
ACCESSORY, YARD, SIDE, CLAUSE, SENTENCE, COMMA, NOTHING, REFERENCE = 100, 101, 110, 120, 121, 122, 123, 124

STORY = r"(?:stories|storeys|story|floors)"
WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
UNITS = {"sqft": r"sq\.?\s*(?:ft|feet)|square\s+(?:feet|foot)|sf\b", "feet": r"ft\b|feet|foot|'", "percent": r"%|percent", "story": STORY,
         "density": r"(?:dwelling\s+)?units\s+per\s+acre", "acre": r"acres?\b",
         "other": r"(?:days|years?|months?|hours?|spaces?|units?|inch(?:es)?|miles?|lots?|copies)\b"}
DIGITS = r"(?P<digits>[0-9][0-9,]*+(?:\.[0-9]++)?+(?P<half>\s*½|\s+1/2)?+|\.[0-9]++)"


def plain(phrase: str) -> str:
    """A phrase without what may not follow it."""
    return re.sub(r" ?\??\(\?.*\)$", "", phrase).lower()


SAID = {plain(p): i for i, phrases in enumerate(fv.PHRASES.values()) for p in phrases}
KNOWN = {**{f"{p}s": i for p, i in SAID.items()}, **SAID,
         **dict.fromkeys(("accessory", "garage", "garages", "shed", "sheds", "outbuilding", "outbuildings"), ACCESSORY),
         **dict.fromkeys(("setback", "setbacks", "yard", "yards"), YARD), "front": SIDE, "side": SIDE + 1, "sides": SIDE + 1, "rear": SIDE + 2, "back": SIDE + 2,
         ";": CLAUSE, "\n": CLAUSE, ".": SENTENCE, ",": COMMA, **dict.fromkeys(("n/a", "none", "not required", "not applicable"), NOTHING)}
CASED = {"FAR", "H ?(?==)"}
PHRASE = "|".join(f"(?-i:{p})" if p in CASED else p for p in sorted((p for ps in fv.PHRASES.values() for p in ps), key=len, reverse=True))
TOKEN = re.compile(
    rf"(?i)(?<![0-9.,]){DIGITS}(?:[ \t]*-?[ \t]*(?:{'|'.join(f'(?P<{n}>{u})' for n, u in UNITS.items())}))?+"
    rf"|(?P<word>[;\n,]|\.(?=\s|$))|(?P<reference>\b(?:section|sec\.|article|chapter|table|figure|page|note)\s*[0-9][0-9.()a-z-]*|§+\s*[0-9][0-9.()a-z-]*)"
    rf"|\b(?:(?P<counted>{'|'.join(WORDS)})(?P<more>\s+and\s+(?:one|a)[- ]half)?[\s-]+(?P<stories>{STORY})"
    rf"|(?P<phrase>(?:{PHRASE})s?|accessory|garages?|sheds?|outbuildings?|(?:setback|yard)s?\b|(?:front|sides?|rear|back)\b|n/a|none\b|not required|not applicable))")


def number(match: re.Match) -> float:
    """'10,000' is 10000, '2½' and '2 1/2' are 2.5."""
    digits, half = match["digits"], match["half"]
    if half:
        digits = digits[:len(digits) - len(half)]
    return float(digits.replace(",", "")) + (0.5 if half else 0.0)


def found_in(section: str) -> dict[int, float]:
    """What a section states: the first value of each field."""
    found: dict[int, float] = {}
    pending, accessory, yards, comma = -1, False, False, False
    for match in TOKEN.finditer(section):
        kind = match.lastgroup
        if kind in ("word", "phrase", "reference"):
            code = REFERENCE if kind == "reference" else KNOWN[" ".join(match[kind].lower().split()) or "\n"]
            side = code - SIDE if SIDE <= code <= SIDE + 2 else SIDES.index(code) if code in SIDES else -1
            if code in (CLAUSE, SENTENCE):
                pending, accessory, yards = -1, False, yards and code == CLAUSE
            elif code == ACCESSORY:
                pending, accessory = -1, True
            elif code == NOTHING:
                pending = -1
            elif code == YARD:
                yards, pending = True, ACCESSORY_SIDE if accessory and pending < 0 else pending
            elif side >= 0 and accessory:
                pending, yards = ACCESSORY_SIDE + side, True
            elif code < len(FIELDS):
                pending, yards = -1 if accessory else code, code in SIDES
            elif side >= 0 and yards:
                pending = SIDES[side]
            comma = code == COMMA or (comma and code == REFERENCE)
            continue
        target = -1
        if kind == "stories":
            value, unit = WORDS[match["counted"].lower()] + (0.5 if match["more"] else 0.0), "story"
        else:
            value, unit = number(match), kind
        if unit in ("story", "density", "sqft", "acre"):
            if not accessory:
                target = {"story": STORIES, "density": DENSITY, "sqft": AREA if pending == AREA else ANY_AREA, "acre": AREA if pending == AREA else -1}[unit]
            value *= fv.SQFT_IN_ACRE if unit == "acre" else 1.0
        elif (unit == "feet" and pending in IN_FEET) or (unit == "percent" and pending in COVERAGES) or (unit == "digits" and not comma):
            target = pending
        if target >= 0:
            found.setdefault(target, value)
        pending, comma = -1 if target == pending else pending, False
    return found


# --- tables -----------------------------------------------------------------------------

# A line whose first cell is the zone, and the lines with cells that follow; cells are parted by | or tabs.
TABLE = re.compile(r"(?im)^[ \t|]*(?:zones?|districts?)[ \t]*(?:\||\t)[^\n]*+(?:\n[^\n|\t]*[|\t][^\n]*+)+")
HEADER = {**{ACCESSORY_SIDE + i: f"(?:accessory|garage|shed|outbuilding).*{s}" for i, s in enumerate(("front", "side", "(?:rear|back)"))}, STORIES: STORY,
          **{i: "|".join(f"(?-i:{p})" if p in CASED else p for p in phrases) for i, phrases in enumerate(fv.PHRASES.values()) if i not in (AREA, COVERAGES[1])},
          SIDES[0]: r"\bfront\b", SIDES[1]: r"\bsides?\b", SIDES[2]: r"\b(?:rear|back)\b", COVERAGES[1]: "coverage", AREA: "area|lot size|minimum lot"}
HEADER_CELL = [(field, re.compile(f"(?i){pattern}")) for field, pattern in HEADER.items()]     # the narrow before the wide
RULE = re.compile(r"[-: ]*")
CELL_NUMBER = re.compile(rf"[^0-9.]*{DIGITS}")
LAST_NOTE = re.compile(rf"{NOTE}\s*$")


def cells(line: str) -> list[str]:
    return [x.strip() for x in re.split(r"[ ]*(?:\||\t+)[ ]*", re.sub(r"^[ \t]*\||\|[ \t]*$", "", line))]


def table_zones(block: str) -> Iterator[tuple[int, str, dict[int, float]]]:
    """(line, zone, values) of a table's rows that have as many cells as its header."""
    header, *lines = block.split("\n")
    fields = [next((f for f, pattern in HEADER_CELL if pattern.search(x)), -1) for x in cells(header)]
    for line, text in enumerate(lines):
        row = cells(text)
        if len(row) != len(fields) or RULE.fullmatch(row[0]):
            continue
        found = {}
        for field, cell in zip(fields, row):
            match = CELL_NUMBER.match(cell) if field >= 0 else None
            if match:
                found.setdefault(field, number(match))
        yield line, LAST_NOTE.sub("", row[0]).strip(), found


# --- the job -------------------------------------------------------------------------------

TARGETS = [*range(len(FIELDS)), STORIES, *range(ACCESSORY_SIDE, ACCESSORY_SIDE + 3)]
VALUES = [*FIELDS, "principal_max_height_stories", *(f"accessory_min_{side}_yard_ft" for side in ("front", "side", "rear"))]


def zones_of(text: str) -> Iterator[tuple[int, str, dict[int, float]]]:
    """(position, zone, values) of a text: headings first, then the lines of its tables."""
    blocks = TABLE.findall(text)
    if blocks:
        text = TABLE.sub("\n", text)
    marks = list(HEADING.finditer(text))
    for i, mark in enumerate(marks):
        end = marks[i + 1].start() if i + 1 < len(marks) else len(text)
        yield i + 1, mark[1] or mark[2], found_in(text[mark.end():end])
    before = len(marks) + 1
    for block in blocks:
        for line, zone, found in table_zones(block):
            yield before + line, zone, found
        before += block.count("\n")


def with_fallbacks(found: dict[int, float]) -> dict[int, float]:
    """A width that isn't stated is the frontage, a depth the width, an area the first number of square feet."""
    for field, other in ((AREA, ANY_AREA), (WIDTH, FRONTAGE), (DEPTH, WIDTH)):
        if field not in found and other in found:
            found[field] = found[other]
    return found


def rule_extract(texts: DataFrame) -> DataFrame:
    """One row per zone heading and table row of a text (doc_id, text) with the fields stated there.

    ``position`` counts the headings of a text from 1; the lines of its tables are counted on from there.
    A null or empty text has no zones.
    """
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"doc_id {kind}, extracted_town string, extracted_county string, position int, zone_name string, " + ", ".join(f"{n} double" for n in VALUES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, about, values = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                place = [m and m[1] for m in (TOWN.search(text or ""), COUNTY.search(text or ""))]
                for position, zone, found in zones_of(text or ""):
                    found = with_fallbacks(found)
                    rows.append(row)
                    about.append((*place, position, zone))
                    values.append([found.get(t) for t in TARGETS])
            columns = [*(zip(*about) if about else [()] * 4), *(zip(*values) if values else [()] * len(VALUES))]
            types = [pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.float64()] * len(VALUES)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, types))],
                                             names=["doc_id", "extracted_town", "extracted_county", "position", "zone_name", *VALUES])

    return texts.select("doc_id", "text").mapInArrow(run, schema)
