"""Scoring extracted zones against verified ones.

The list of a response stays inside its row until zones are matched; verified
zones are joined on (document, zone name), and scores are plain column sums, so
the only shuffles are that join and the final sum per test.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelrules import fixed_values as fv
from parcelrules.functions import scores, variants as v
from parcelrules.functions.numeric import parse_double
from parcelrules.functions.text import let
from parcelrules.operators.responses import strict_json
from parcelrules.operators.skew import splittable


def scorer_zones(raw: Column) -> Column:
    """Zones of a response as the scorer reads it: JSON between the outer braces,
    the first of four keys that holds a list, or the object itself as the only zone."""
    body = v.as_map(strict_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))))

    def pick(obj: Column) -> Column:
        lists = [v.as_maps(obj[k]) for k in fv.SCORER_ZONE_ARRAY_KEYS]
        single = F.when(obj["zone"].isNotNull() | obj["zone_name"].isNotNull(), F.array(obj))
        return F.coalesce(*lists, single)

    return let(body, pick)


def scorer_name(zone: Column) -> Column:
    return F.coalesce(v.shown_name(zone["zone_name"]), v.shown_name(zone["zone"]))


def extracted_zones(tests: DataFrame, keys: list[str], read: Callable[[Column], Column], upper: bool = True) -> DataFrame:
    """One row per test and zone name, the first of several with one name; a test without zones keeps one row of nulls.

    Of a zone only its name and ``read`` of the wanted ``keys`` go on: no object crosses a shuffle.
    """
    zones = tests.withColumn("_zones", scorer_zones(F.col("response_text")))
    zones = zones.select("test_id", "ground_truth_doc_id", F.transform("_zones", lambda z: F.struct(
        scorer_name(z).alias("name"), F.array(*[read(z[k]) for k in keys]).alias("values"))).alias("_zones"))
    key = (lambda z: F.upper(z["name"])) if upper else (lambda z: z["name"])
    zones = zones.withColumn("_keys", F.transform("_zones", key))
    kept = F.filter(F.arrays_zip(F.col("_keys").alias("key"), F.col("_zones").alias("zone"),
                                 F.transform("_keys", lambda _, i: i).alias("i")),
                    lambda n: F.array_position(F.col("_keys"), n["key"]) == n["i"] + 1)
    return zones.withColumn("_z", F.explode_outer(kept)).select(
        "test_id", "ground_truth_doc_id", F.col("_z.key").alias("zone_key"), F.col("_z.zone.name").alias("predicted_zone"),
        F.col("_z.zone.values").alias("values"))


def given_value(value: Column) -> Column:
    """What a score needs of a key: whether it is given, is a JSON null, and its number.

    Numbers may come as text; other text never equals a number.
    """
    def parts(val: Column) -> Column:
        # A text counts only in plain decimal notation.
        number = F.when(v.kind(val) == "STRING", parse_double(v.text(val))).otherwise(v.double(val))
        return F.struct(val.isNotNull().alias("given"), F.coalesce(F.is_variant_null(val), F.lit(False)).alias("none"), number.alias("number"))

    return let(value, parts)


def key_score(value: Column, actual: Column) -> Column:
    """Score of one key of an extracted zone (a :func:`given_value`); null when the key is absent."""
    return (F.when(~value["given"], F.lit(None).cast("double"))
            .when(value["none"] & actual.isNull(), F.lit(1.0))
            .when(value["none"] | actual.isNull() | value["number"].isNull(), F.lit(0.0))
            .otherwise(scores.field_accuracy(value["number"], actual)))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def score_extractions(tests: DataFrame, truth: DataFrame) -> DataFrame:
    """Zone, field and overall accuracy per test (test_id, ground_truth_doc_id, response_text).

    A document without verified zones scores 0 throughout.
    """
    have = set(truth.columns)
    pairs = {k: f for k, f in fv.SCORED_KEYS.items() if f in have}
    verified = truth.select("ground_truth_doc_id", F.upper("zone").alias("zone_key"), F.lit(True).alias("is_verified"),
                            *sorted(set(pairs.values())))
    rows = extracted_zones(tests, list(pairs), given_value).join(verified, ["ground_truth_doc_id", "zone_key"], "left")
    given = F.arrays_zip(F.col("values").alias("value"), F.array(*[F.col(f).cast("double") for f in pairs.values()]).alias("actual"))
    cells = F.when(F.col("is_verified"), F.array_compact(F.transform(given, lambda g: key_score(g["value"], g["actual"]))))
    per_zone = rows.select("test_id", "ground_truth_doc_id", F.when(F.col("is_verified"), F.col("zone_key")).alias("zone_key"), cells.alias("s")).select(
        "test_id", "ground_truth_doc_id", "zone_key", F.aggregate("s", F.lit(0.0), lambda a, x: a + x).alias("score"),
        F.when(F.col("s").isNotNull(), F.size("s")).alias("n"))
    per_test = per_zone.groupBy("test_id", "ground_truth_doc_id").agg(
        F.nullif(F.count_distinct("zone_key"), F.lit(0)).alias("found"), F.sum("score").alias("score"), F.sum("n").alias("n"))
    expected = verified.groupBy("ground_truth_doc_id").agg(F.count_distinct("zone_key").alias("expected"))
    rows = per_test.join(splittable(expected, "ground_truth_doc_id"), "ground_truth_doc_id", "left")
    zone = F.coalesce(F.try_divide(F.col("found").cast("double"), F.col("expected")), F.lit(0.0))
    field = F.coalesce(F.try_divide("score", "n"), F.lit(0.0))
    known = F.col("expected").isNotNull()
    return rows.select(
        "test_id", "ground_truth_doc_id", zone.alias("zone_accuracy"), field.alias("field_accuracy"),
        F.when(known, F.lit(1.0)).otherwise(F.lit(0.0)).alias("location_accuracy"),
        (zone * fv.ZONE_WEIGHT + field * fv.FIELD_WEIGHT).alias("overall_accuracy"))


def zone_results(tests: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted against verified per verified zone of a test, missed zones with nulls."""
    have = [f for f in fv.RULE_FIELDS if f in truth.columns]
    verified = truth.select(F.col("id").alias("ground_truth_req_id"), "ground_truth_doc_id",
                            F.col("zone").alias("actual_zone"), F.upper("zone").alias("zone_key"), *have)
    wanted = tests.select("test_id", "ground_truth_doc_id").join(verified, "ground_truth_doc_id")
    keys = {f: [k for k, t in fv.SCORED_KEYS.items() if t == f] for f in have}
    scored = [f for f, ks in keys.items() if ks]
    # A field takes its first number.
    flat = [k for f in scored for k in keys[f]]
    found = extracted_zones(tests, flat, v.number).where(F.col("zone_key").isNotNull()).drop("ground_truth_doc_id")
    rows = wanted.join(found, ["test_id", "zone_key"], "left").withColumnRenamed("values", "_n")
    predicted = {f: F.coalesce(*[F.col("_n")[flat.index(k)] for k in keys[f]]) for f in scored}
    marks = F.transform(F.array(*[F.struct(p.alias("p"), F.col(f).cast("double").alias("a"))
                                  for f, p in predicted.items()]), lambda m: scores.field_accuracy(m["p"], m["a"]))
    return rows.select(
        "test_id", "ground_truth_req_id", "actual_zone",
        "predicted_zone",
        *[p.alias(f"predicted_{f}") for f, p in predicted.items()],
        F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(
            F.aggregate(marks, F.lit(0.0), lambda a, x: a + x) / len(scored))
        .alias("zone_accuracy_score"))


def strict_accuracy(tests: DataFrame, expected: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Share of expected fields within 5 %, over zones matched by their exact name.

    ``fields`` maps a key of an extracted zone to a column of ``expected``.
    """
    verified = expected.select("ground_truth_doc_id", F.col("zone").alias("zone_key"), F.lit(True).alias("is_verified"), *fields.values())
    rows = extracted_zones(tests, list(fields), v.number, upper=False).join(verified, ["ground_truth_doc_id", "zone_key"], "left")
    hits = _total([scores.strict_hit(F.col("values")[i], F.col(c)).cast("int") for i, c in enumerate(fields.values())])
    per_test = rows.groupBy("test_id", "ground_truth_doc_id").agg(
        F.sum(F.when(F.col("is_verified"), hits)).alias("hits"), F.count("is_verified").alias("zones"))
    return per_test.select(
        "test_id", "ground_truth_doc_id",
        F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("zones") * len(fields)), F.lit(0.0)).alias("accuracy"))


def _listed(raw: Column) -> Column:
    return let(v.as_map(strict_json(raw)), lambda body: v.as_maps(body["zoning_requirements"]))


def completeness(tests: DataFrame) -> DataFrame:
    """Given key fields over ten per zone, per response (at most 0.9: nine fields are counted)."""
    zones = tests.select("test_id", _listed(F.col("response_text")).alias("zones"))
    given = F.aggregate(F.transform("zones", lambda z: _total(
        [F.coalesce(v.is_given(z[k]), F.lit(False)).cast("int") for k in fv.COMPLETENESS_KEYS])),
        F.lit(0), lambda a, x: a + x)
    return zones.select("test_id", F.coalesce(F.try_divide(
        given.cast("double"), F.size("zones") * fv.COMPLETENESS_FIELDS_PER_ZONE), F.lit(0.0)).alias("completeness"))


def response_profile(tests: DataFrame) -> DataFrame:
    """Per zone of a response: name and number of given fields; with what the response names."""
    parsed = tests.select("test_id", v.as_map(strict_json(F.col("response_text"))).alias("body"))
    known = parsed.select(
        "test_id", F.coalesce(v.is_given(F.col("body")["extracted_town"]), F.lit(False)).alias("has_town"),
        F.coalesce(v.is_given(F.col("body")["extracted_county"]), F.lit(False)).alias("has_county"),
        v.as_maps(F.col("body")["zoning_requirements"]).alias("zones"))
    return known.select("test_id", "has_town", "has_county", F.coalesce(F.size("zones"), F.lit(0)).alias("zone_count"),
                        F.posexplode_outer("zones").alias("position", "z")).select(
        "test_id", "has_town", "has_county", "zone_count", "position",
        F.when(F.col("z").isNotNull(), F.coalesce(v.text(F.col("z")["zone_name"]), F.lit("Unknown"))).alias("zone_name"),
        F.size(F.filter(F.map_values("z"), lambda x: ~F.is_variant_null(x))).alias("given_fields"))


RANK_BINS = 10000


def prompt_ranking(tests: DataFrame, experiments: DataFrame) -> DataFrame:
    """Prompts by mean accuracy of their successful tests; equal means share a rank.

    The rank is counted in two bounded steps (bins of accuracy, then values in a
    bin) instead of a window over all prompts in one task.
    """
    ok = F.col("extraction_success")
    per_exp = tests.groupBy(F.col("prompt_experiment_id").alias("id")).agg(
        F.avg(F.when(ok, F.col("overall_accuracy_score"))).alias("a"), F.sum("llm_tokens_used").alias("tokens"),
        F.sum("parsed_zones_count").alias("zones_found"))
    rows = per_exp.where(F.col("a").isNotNull()).join(
        experiments.select("id", "prompt_name", "prompt_version"), "id").withColumn("accuracy", scores.settled(F.col("a")))
    values = rows.groupBy("accuracy").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bin", F.least(F.greatest(F.floor(F.col("accuracy") * RANK_BINS), F.lit(0)), F.lit(RANK_BINS)))
    bins = values.groupBy("bin").agg(F.sum("n").alias("bin_n"))
    before = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("bin_n").over(before), F.lit(0)).alias("above"))
    inside = Window.partitionBy("bin").orderBy(F.desc("accuracy")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = values.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bins, "bin").select(
        "accuracy", (F.col("above") + F.col("ahead") + 1).alias("rank"))
    return rows.join(ranks, "accuracy").select(
        "rank", "prompt_name", "prompt_version", "accuracy", scores.percent_text(F.col("accuracy"))
        .alias("accuracy_text"), "tokens", "zones_found").orderBy("rank", "prompt_name", "prompt_version")
