"""From response text to one clean row per zone.

    parse_responses -> zone_rows -> typed_fields -> (place, defaults) -> upsert

All steps are column expressions of one lazy plan. A response's zones are
de-duplicated inside its own array, so nothing is shuffled before the final
upsert. The long key look-ups run inside ``transform`` lambdas: that keeps the
generated code of a stage small enough for the JVM to compile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions import numeric, text, variants as v
from parcelrules.functions.text import built_once, let


# --- parsing --------------------------------------------------------------------

ZONE_KEYS = [*fv.ZONE_NAME_KEYS, *[n for names in fv.GROUP_KEYS.values() for n in names],
             *[k for _, flat, keys in fv.FIELD_ALIASES.values() if flat for k in keys],
             *[k for keys in fv.ACCESSORY_FALLBACK_KEYS.values() for k in keys]]
ZONE = v.struct_of(ZONE_KEYS)
BODY = v.struct_of(["raw_response", "extracted_town", "extracted_county", "extraction_confidence", *fv.ZONE_ARRAY_KEYS])


def framed(raw: Column) -> Column:
    """The text read as the only element of a list; a JSON reader alone would stop
    at the end of the first value and not see what follows it."""
    complete = F.right(text.strip(raw), F.lit(1)).rlike(r'[}\]"0-9el]')
    return F.try_parse_json(F.when(complete, F.concat(F.lit("["), raw, F.lit("]"))))


def is_one(frame: Column) -> Column:
    """The text was one JSON value and nothing else."""
    return (F.try_variant_get(frame, "$[0]", "variant").isNotNull()
            & F.try_variant_get(frame, "$[1]", "variant").isNull())


def strict_json(raw: Column) -> Column:
    """The JSON value a text is; null when anything but white space surrounds it."""
    return let(framed(raw), lambda f: F.when(is_one(f), F.try_variant_get(f, "$[0]", "variant")))


def repair_json(raw: Column) -> Column:
    """From the first { to the last }, without trailing commas and control characters."""
    body = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    body = F.regexp_replace(body, fv.TRAILING_COMMA, "$1")
    return F.nullif(F.regexp_replace(body, fv.CONTROL_CHARS, ""), F.lit(""))


def envelope(content: Column) -> Column:
    """The stored response: a JSON content as it is, other text wrapped."""
    wrapped = F.to_json(F.struct(
        content.alias("raw_response"), F.array().cast("array<string>").alias("zones"),
        F.lit(fv.ENVELOPE_CONFIDENCE).alias("extraction_confidence")))
    return F.when(strict_json(content).isNotNull(), content).otherwise(wrapped)


def zones_from_any_list(source: Column) -> Column:
    """The first list, in document order, whose first item is an object that names a zone."""
    naming = F.array(*[F.lit(k) for k in fv.ZONE_MARKER_KEYS])
    entries = F.map_values(F.from_json(source, v.MAP))
    return F.get(F.filter(entries, lambda value: F.coalesce(F.arrays_overlap(F.map_keys(
        F.try_variant_get(value, "$[0]", v.MAP)), naming), F.lit(False))), F.lit(0))


def as_zones(value: Column) -> Column:
    """A list's elements as zone objects (NULL where an element is none)."""
    return F.try_variant_get(value, "$", f"array<{ZONE}>")


@built_once
def parsing() -> list[dict[str, Column]]:
    """The new columns of each step from a text to body and zones."""
    raw, one, wrapped, plain = F.col("response_text"), is_one(F.col("_f")), F.col("body.raw_response"), F.col("_inner").isNull()
    # The first key that is present decides, even if it holds an empty list.
    nothing = F.col("_known").isNull() | (F.size("_zones") == 0) | (F.col("_zones").isNull() & F.to_json("_known").isin("{}", '""'))
    return [
        {"_f": framed(raw)},
        {"_source": F.when(one, raw).otherwise(repair_json(raw)), "_f": F.when(one, F.col("_f")).otherwise(framed(repair_json(raw)))},
        {"_source": F.col("_source"), "_f": F.col("_f"), "_read": F.coalesce(one, F.lit(False)), "body": F.when(one, F.try_variant_get("_f", "$[0]", BODY))},
        {"_source": F.col("_source"), "_read": F.col("_read"), "body": F.col("body"), "_inner": F.when(v.kind(wrapped) == "STRING", v.text(wrapped))},
        {"_source": F.col("_source"), "_read": F.col("_read"), "body": F.col("body"), "_inner": F.col("_inner"),
         "_f": F.when(F.col("_inner").isNotNull(), framed(F.col("_inner")))},
        {"_source": F.when(plain, F.col("_source")).otherwise(F.col("_inner")),
         "outcome": F.when(F.col("_read") & (plain | one), F.lit("json")).otherwise(F.lit("text")),
         "body": F.when(plain, F.col("body")).when(one, F.try_variant_get("_f", "$[0]", BODY))},
        {"_source": F.col("_source"), "outcome": F.col("outcome"), "body": F.col("body"), "_known": F.coalesce(*[F.col(f"body.{k}") for k in fv.ZONE_ARRAY_KEYS])},
        {"_source": F.col("_source"), "outcome": F.col("outcome"), "body": F.col("body"), "_known": F.col("_known"), "_zones": as_zones(F.col("_known"))},
        {"outcome": F.col("outcome"), "body": F.col("body"), "zones": F.when(F.col("body").isNotNull(), F.when(
            F.coalesce(nothing, F.lit(False)), as_zones(zones_from_any_list(F.col("_source")))).otherwise(F.col("_zones")))},
    ]


def parse_responses(responses: DataFrame) -> DataFrame:
    """Add ``outcome``, ``body`` (the keys that matter) and ``zones`` (list of objects).

    ``outcome`` is 'json' when the text, its repaired form or its inner
    ``raw_response`` could be read, 'text' when only the text is left.
    """
    step = responses
    for made in parsing():
        step = step.select(*responses.columns, *[x.alias(n) for n, x in made.items()])
    return step


def zone_mentions(raw: Column) -> Column:
    """Zone names a text mentions, by three patterns; a set."""
    found = [F.regexp_extract_all(raw, F.lit(p), F.lit(1)) for p in fv.ZONE_MENTION_PATTERNS]
    return F.filter(F.array_distinct(F.concat(*found)),
                    lambda z: (z != "") & (F.length(z) < fv.MAX_ZONE_MENTION_LENGTH))


# --- place ------------------------------------------------------------------------

@built_once
def places() -> dict[str, Column]:
    """town, county and state: the user's value, else the response's, else a made-up name."""
    user_town = text.strip(F.coalesce("municipality", F.lit("")))
    user_county = text.strip(F.coalesce("county", F.lit("")))
    state = text.strip(F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit(fv.DEFAULT_STATE)))
    unknown = F.lower(user_town).isin("", "unknown")
    said = lambda key: F.when(v.kind(F.col(f"body.{key}")) == "STRING",
                              text.blank_to_null(v.text(F.col(f"body.{key}"))))
    named = F.coalesce(said("extracted_town"), text.town_from_filename(F.col("filename")),
                       F.concat(F.lit("Job_"), F.substring("job_id", 1, 8)))
    town = (F.when(F.col("outcome") == "text", F.when(unknown, F.lit(fv.PENDING_TOWN)).otherwise(user_town))
            .when(unknown | (F.lower(user_town) == fv.PENDING_TOWN.lower()), named).otherwise(user_town))
    county = (F.when(~user_county.isin("", fv.UNKNOWN_COUNTY), user_county)
              .when(F.col("outcome") == "text", F.lit(fv.UNKNOWN_COUNTY))
              .otherwise(F.coalesce(said("extracted_county"), F.lit(fv.UNKNOWN_COUNTY))))
    return {"town": town, "county": county, "state": state}


def with_place(parsed: DataFrame) -> DataFrame:
    return parsed.withColumns(places())


# --- zones and fields ---------------------------------------------------------------

def zone_name(zone: Column) -> Column:
    name = F.coalesce(*[v.shown_name(zone[k]) for k in fv.ZONE_NAME_KEYS])
    cleaned = let(name, lambda n: text.strip(text.drop_footnotes(n)))
    return F.coalesce(cleaned, F.lit(fv.UNKNOWN_ZONE))


def area_zone_name(name: Column) -> Column:
    """What the lot-area repair sees of a name: '' when missing, null when not a text."""
    return let(name, lambda named: F.when(named.isNull(), F.lit(""))
               .when(v.kind(named) == "STRING", v.text(named)))


def _first(scopes: list[str], keys: list[str]) -> str:
    """SQL for the first key that is present in the first scope that has one."""
    found = [f"{scope}.`{key}`" for scope in scopes for key in keys]
    return f"coalesce({', '.join(found)})" if len(found) > 1 else found[0]


def _group(name: str) -> str:
    """SQL for the first of a group's names that holds an object."""
    kind = v.struct_of([k for group, _, keys in fv.FIELD_ALIASES.values() if group == name for k in keys])
    held = [f"try_variant_get(zone_object.`{n}`, '$', '{kind}')" for n in fv.GROUP_KEYS[name]]
    return f"coalesce({', '.join(held)}) AS _{name}"


def _field(field: str) -> str:
    """SQL for a field's untyped value: its aliases in the group, then in the zone object."""
    group, flat, keys = fv.FIELD_ALIASES[field]
    return _first([f"_{group}", "zone_object"] if flat else [f"_{group}"], keys)


def with_fallbacks(fields: dict[str, Column], yards: dict[str, Column]) -> dict[str, Column]:
    """Width from frontage, depth from width, accessory yards from principal ones."""
    out = dict(fields)
    frontage, width, depth = (f"interior_min_lot_{x}_ft" for x in ("frontage", "width", "depth"))
    out[width] = F.coalesce(fields[width], fields[frontage])
    out[depth] = F.coalesce(fields[depth], out[width])
    for field, principal in yards.items():
        out[field] = F.coalesce(fields[field], principal)
    return out


@built_once
def zone_steps() -> list[Column]:
    """Zone objects up to the first that is none; their names; the names as keys; and the first zone of each key."""
    mentioned = F.transform(zone_mentions(F.col("response_text")),
                            lambda z: F.try_variant_get(F.parse_json(F.to_json(F.struct(z.alias("zone")))), "$", ZONE))
    listed = F.when(F.col("outcome") == "text", mentioned).otherwise(F.col("zones"))
    whole = let(listed, lambda zones: let(
        F.array_position(F.transform(zones, lambda z: z.isNull()), F.lit(True)).cast("int"),
        lambda bad: F.when(bad > 0, F.slice(zones, F.lit(1), bad - 1)).otherwise(zones)))
    keys = F.when(F.col("outcome") == "text", F.col("_names")).otherwise(F.transform("_names", F.lower))
    first = F.filter(F.arrays_zip(F.col("_names").alias("zone"), F.col("_keys").alias("key"),
                                  F.col("_zones").alias("zone_object"),
                                  F.transform("_keys", lambda _, i: i).alias("position")),
                     lambda n: F.array_position(F.col("_keys"), n["key"]) == n["position"] + 1)
    return [whole, F.transform("_zones", zone_name), keys, F.explode(first)]


def zone_rows(placed: DataFrame) -> DataFrame:
    """One row per zone of a response: ``position``, ``zone`` (name) and ``zone_object``.

    Reading stops at the first element that is not an object, and the first of
    several zones with one name is taken; zones of a list are told apart without
    regard to case, zones mentioned in a text with it.
    """
    staged = placed
    for name, made in zip(("_zones", "_names", "_keys", "_n"), zone_steps()):
        staged = staged.withColumn(name, made)
    return staged.select(
        *[c for c in placed.columns if c not in ("zones", "response_text")],
        F.col("_n.position").alias("position"), F.col("_n.zone").alias("zone"),
        F.col("_n.zone_object").alias("zone_object"))


NUMBER_FIELDS = [f for f in fv.RULE_FIELDS if f not in fv.INTEGER_FIELDS]


@built_once
def field_columns(mode: str) -> tuple[Column, Column, list[Column]]:
    """All values as numbers; the lot area after its repair; and the 29 fields with the exact stories."""
    area = let(F.col("_numbers")[0], lambda a: numeric.fix_lot_area(a, area_zone_name(F.col("_name")), mode))
    cell = {f: F.col("_numbers")[i] for i, f in enumerate(NUMBER_FIELDS)}
    yards = {f: F.col("_numbers")[len(NUMBER_FIELDS) + i] for i, f in enumerate(fv.ACCESSORY_FALLBACK_KEYS)}
    cell["interior_min_lot_area_sqft"] = F.col("_area")
    cell = with_fallbacks(cell, yards)
    cell["max_height_stories"] = v.whole_number(F.element_at("_values", -1))
    return F.transform("_values", v.number), area, [*[cell[f].alias(f) for f in fv.RULE_FIELDS],
                                                    F.element_at("_numbers", -1).alias("max_height_stories_exact")]


def typed_fields(zones: DataFrame, mode: str = "compatible") -> DataFrame:
    """Replace ``zone_object`` by the 29 rule fields."""
    values = [*[_field(f) for f in NUMBER_FIELDS],
              *[_first(["zone_object"], keys) for keys in fv.ACCESSORY_FALLBACK_KEYS.values()],
              _field("max_height_stories")]
    found = zones.selectExpr("*", *[_group(g) for g in fv.GROUP_KEYS]).selectExpr(
        *[c for c in zones.columns if c != "zone_object"], f"array({', '.join(values)}) AS _values",
        "zone_object.zone_name AS _name")
    numbers, area, fields = field_columns(mode)
    found = found.withColumn("_numbers", numbers).withColumn("_area", area)
    return found.select(*[c for c in zones.columns if c != "zone_object"], *fields)


@built_once
def confidence() -> Column:
    given = F.col("body.extraction_confidence")
    return (F.when(F.col("outcome") == "text", F.lit(fv.REGEX_CONFIDENCE))
            .when(given.isNull(), F.lit(fv.DEFAULT_CONFIDENCE))
            .otherwise(v.double(given)))


def normalize(responses: DataFrame, mode: str = "compatible") -> DataFrame:
    """Responses to requirement rows: place, zone, 29 fields and their origin."""
    placed = with_place(parse_responses(responses)).withColumn("extraction_confidence", confidence())
    slim = placed.select("response_id", "job_id", "town", "county", "state", "extraction_confidence", "processed_at",
                         "outcome", "zones", F.when(F.col("outcome") == "text", F.col("response_text"))
                         .alias("response_text"))
    rows = typed_fields(zone_rows(slim), mode)
    return rows.select(
        "response_id", "position", "job_id", "town", "county", "state", "zone", *fv.RULE_FIELDS,
        "max_height_stories_exact", F.lit(fv.DATA_SOURCE).alias("data_source"), "extraction_confidence",
        F.col("processed_at").alias("extracted_at"))


# --- the bulk call -------------------------------------------------------------------

CALL = v.struct_of(["extracted_town", "extracted_county", "zoning_requirements"])
BULK_ZONE = v.struct_of(["zone_name", *fv.BULK_INTEGER_FIELDS, *fv.BULK_NUMERIC_FIELDS])
NO_JSON, NO_TOWN, NO_LIST, TAKEN = "no_json", "no_town", "no_list", "taken"


def read_calls(calls: DataFrame) -> DataFrame:
    """``calls`` with outcome, town, county and ``elements``, the list's values whatever they are.

    A call without a list has no zones; one with something else in its place fails.
    """
    read = calls.withColumn("_body", strict_json(F.col("response_text")))
    read = read.withColumn("_call", F.try_variant_get("_body", "$", CALL))
    given = F.col("_call.zoning_requirements")
    elements = F.try_variant_get(given, "$", "array<variant>")
    town = v.text(F.col("_call.extracted_town"))
    outcome = (F.when(F.col("_body").isNull(), NO_JSON).when(town.isNull(), NO_TOWN)
               .when(given.isNotNull() & elements.isNull(), NO_LIST).otherwise(TAKEN))
    return read.select(*calls.columns, outcome.alias("outcome"), town.alias("town"),
                       v.text(F.col("_call.extracted_county")).alias("county"), elements.alias("elements"))


def bulk_rows(calls: DataFrame) -> DataFrame:
    """Every element of every call's list with its casts.

    ``is_error`` where a cast failed, the zone has no name, or the element is no object; the others stay.
    """
    rows = read_calls(calls).where(F.col("outcome") == TAKEN).select(
        "response_id", "town", "county", F.posexplode("elements").alias("position", "element"))
    rows = rows.withColumn("z", F.try_variant_get("element", "$", BULK_ZONE))

    def cast(field: str, to: str) -> Column:
        raw = v.text(F.col(f"z.{field}"))
        return F.when(raw.rlike(numeric.INTEGER_TEXT if to == "int" else numeric.DECIMAL_TEXT),
                      text.strip(raw).try_cast(to))

    casts = {f: cast(f, "int") for f in fv.BULK_INTEGER_FIELDS} | {f: cast(f, "double") for f in fv.BULK_NUMERIC_FIELDS}
    failed = F.exists(F.array(*[F.struct(v.is_given(F.col(f"z.{f}")).alias("given"), c.isNull().alias("lost"))
                                for f, c in casts.items()]), lambda p: p["given"] & p["lost"])
    zone = v.text(F.col("z.zone_name"))
    return rows.select("response_id", "position", "town", "county", zone.alias("zone_name"),
                       *[c.alias(f) for f, c in casts.items()], (zone.isNull() | F.coalesce(failed, F.lit(False))).alias("is_error"))


def bulk_report(calls: DataFrame) -> DataFrame:
    """Per call: success, a message and how many zones were taken or refused."""
    counts = bulk_rows(calls).groupBy("response_id").agg(
        F.count_if(~F.col("is_error")).alias("inserted_count"), F.count_if("is_error").alias("error_count"))
    out = read_calls(calls).drop("elements").join(counts, "response_id", "left").fillna(0, ["inserted_count", "error_count"])
    taken = F.col("outcome") == TAKEN
    message = (F.when(F.col("outcome") == NO_JSON, "Error processing JSON: not a JSON value")
               .when(F.col("outcome") == NO_TOWN, "Missing required field: extracted_town")
               .when(F.col("outcome") == NO_LIST, "Error processing JSON: zoning_requirements is no list")
               .otherwise(F.format_string("Successfully processed %d zones, %d errors", "inserted_count", "error_count")))
    return out.select(
        "response_id", taken.alias("success"), message.alias("message"), "inserted_count", "error_count",
        F.when(taken, F.col("town")).alias("town"), F.when(taken, F.col("county")).alias("county"))


def bulk_document_status(calls: DataFrame) -> DataFrame:
    """What a call does to the document it names (document_id): completed, failed with the reason, or nothing.

    A call without a town is turned away before it touches its document.
    """
    report = bulk_report(calls).select("response_id", "success", "message")
    outcome = read_calls(calls).select("response_id", "document_id", "outcome").join(report, "response_id")
    return outcome.where(F.col("document_id").isNotNull() & (F.col("outcome") != NO_TOWN)).select(
        "document_id", F.when(F.col("success"), "completed").otherwise("failed").alias("processing_status"),
        F.when(~F.col("success"), F.substring_index("message", ": ", -1)).alias("error_message"))
