"""The text to send to a language model for every planned test, from whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelrules import fixed_values as fv


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` replaced by its value, ``{{`` and ``}}`` by single braces.

    Values are not looked into again: the template is cut at its placeholders
    first and the pieces are joined with the values.
    """
    mark, names = "\x01", list(values)
    cut = F.replace(F.replace(template, F.lit("{{"), F.lit("\x02")), F.lit("}}"), F.lit("\x03"))
    for i, name in enumerate(names):
        cut = F.replace(cut, F.lit("{" + name + "}"), F.lit(f"{mark}{i}{mark}"))
    cut = F.replace(F.replace(cut, F.lit("\x02"), F.lit("{")), F.lit("\x03"), F.lit("}"))
    given = F.array(*[F.coalesce(values[n], F.lit("")) for n in names])
    pieces = F.transform(F.split(cut, mark), lambda piece, i: F.when(i % 2 == 0, piece).otherwise(
        F.get(given, piece.try_cast("int"))))
    return F.array_join(pieces, "")


def build_prompts(plan: DataFrame, experiments: DataFrame, documents: DataFrame, gt_documents: DataFrame,
                  max_chars: int | None = None) -> DataFrame:
    """A row for every planned (experiment, document) pair: its prompt from the whole text, and a status.

    ``plan`` names the pairs, so documents meet experiments by equi-joins. A pair that
    lacks its template, place or text has no prompt, and its status says what is missing.
    """
    content = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    pairs = plan.select("prompt_experiment_id", "ground_truth_doc_id").distinct()
    places = gt_documents.select(F.col("id").alias("ground_truth_doc_id"), "town", "county", "state", F.lit(True).alias("placed"))
    texts = documents.select(F.col("doc_id").alias("ground_truth_doc_id"), "text")
    templates = experiments.select(F.col("id").alias("prompt_experiment_id"), "prompt_text")
    # Small columns meet first; each text then joins the pairs of its document once.
    rows = pairs.join(templates, "prompt_experiment_id", "left").join(places, "ground_truth_doc_id", "left").join(
        texts, "ground_truth_doc_id", "left")
    status = (F.when(F.col("prompt_text").isNull(), "no prompt").when(F.col("placed").isNull(), "no place")
              .when(F.col("text").isNull(), "no text").otherwise("ready"))
    prompt = fill_template(F.col("prompt_text"), {
        "text_content": content, "municipality": F.col("town"), "county": F.col("county"),
        "state": F.coalesce("state", F.lit(fv.DEFAULT_STATE))})
    return rows.withColumn("status", status).select(
        "prompt_experiment_id", "ground_truth_doc_id", "status", F.when(F.col("status") == "ready", prompt).alias("prompt"))
