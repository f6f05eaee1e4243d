"""A key with a third of all rows: joins are split, results stay whole."""

import pytest
from pyspark.sql import functions as F

from parcelrules.operators import maintenance as m, scoring, stats

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, value in SMALL.items():
        spark.conf.set(k, value)
    yield
    for k, value in old.items():
        spark.conf.set(k, value) if value is not None else spark.conf.unset(k)


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n):
    """Ids in eight input splits; every third row has the key 'hot'."""
    return spark.range(0, n, 1, 8).withColumn("k", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") / 3).cast("bigint"))))


def test_duplicates_of_a_hot_name(spark, small_splits):
    docs = hot(spark, 240000).select("id", F.col("k").alias("original_filename"),
                                     F.timestamp_seconds(F.col("id") * 7919 % 240000).alias("created_at"))
    found = stats.duplicate_documents(docs)
    rows = found.groupBy("original_filename").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kept").alias("kept")).cache()
    top = rows.where("original_filename = 'hot'").first()
    assert (top.n, top.kept) == (80000, 1)
    assert rows.agg(F.sum("n")).first()[0] == 240000 and rows.where("kept <> 1").count() == 0
    found.collect()
    assert "skew=true" in final_plan(found)
    assert m.dedupe_documents(docs).count() == 80001


def test_scores_of_a_hot_document(spark, small_splits):
    tests = hot(spark, 60000).select(
        F.col("id").alias("test_id"), F.col("k").alias("ground_truth_doc_id"), F.concat(
            F.lit('{"zones": [{"zone": "r-1", "interior_min_lot_area_sqft": '), F.col("id") % 7 * 1000 + 5000,
            F.lit(', "note": "'), F.sha2(F.col("id").cast("string"), 512), F.lit('"}]}')).alias("response_text"))
    truth = hot(spark, 60000).select(F.col("k").alias("ground_truth_doc_id"), F.lit("R-1").alias("zone"),
                                     F.lit(5000.0).alias("interior_min_lot_area_sqft")).distinct()
    scored = scoring.score_extractions(tests, truth)
    rows = scored.collect()
    assert len(rows) == 60000 and all(r.zone_accuracy == 1.0 for r in rows)
    want = {0: 1.0, 1: 0.8, 2: 0.6, 3: 0.4, 4: 0.2, 5: 0.0, 6: 0.0}
    assert all(abs(r.field_accuracy - want[r.test_id % 7]) < 1e-9 for r in rows)
    # The match of zones and the look-up of each document's zone count are both split.
    assert final_plan(scored).count("skew=true") == 2


def test_children_of_a_hot_parent(spark, small_splits):
    children = hot(spark, 240000)
    gone = children.where("k <> 'hot' AND id % 2 = 0").select(F.col("k").alias("id")).distinct()
    left = m.delete_children(children, gone.repartition(F.xxhash64("id")), "k")
    keys = left.groupBy("k").count().where("count > 2").collect()
    assert [(r.k, r["count"]) for r in keys] == [("hot", 80000)]
    left.collect()
    assert "skew=true" in final_plan(left)


def test_scores_shuffle_values_only(spark, folder):
    from parcelrules.plans import suite

    for name in ("score_extractions", "score_zone_results", "strict_accuracy"):
        df = suite.QUERIES[name](spark, folder)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan()
        found, stack = 0, [plan]
        while stack:
            node = stack.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                stack.append(node.initialPlan())
                continue
            if "Exchange" in node.nodeName():
                found += 1
                kinds = node.schema().simpleString()
                assert "variant" not in kinds and "map<" not in kinds
            children = node.children()
            stack += [children.apply(i) for i in range(children.size())]
        assert found


def test_work_folders_can_be_removed(spark, monkeypatch):
    import os

    from parcelrules import session

    monkeypatch.setattr(session, "_made", {})
    paths = [session.work_folder(spark, "try") for _ in range(2)]
    spark.range(3).write.parquet(paths[0])
    assert os.path.exists(paths[0]) and session.remove_work_folders(spark) == 2
    assert not os.path.exists(paths[0]) and session.remove_work_folders(spark) == 0
