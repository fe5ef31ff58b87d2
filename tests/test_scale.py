"""Bucketed assembly, sketches and deep pages: same rows as the plain ways, without their cost."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from lapsekit.operators import ordering as O
from lapsekit.plans import model_table as MT
from lapsekit.session import checkpoint_dir
from lapsekit.sources.tables import read_bucketed
from lapsekit.spec import TESTDATA_SPEC as SPEC

SF = "/root/testdata/sf0.001"


def folder(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def test_bucketed_assembly_moves_no_rows(spark):
    root = folder(spark, "buckets")
    tables = MT.bucketed_tables(spark, SF, root, SPEC, buckets=4)
    got = MT.assembled_bucketed(tables)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4
    want = MT.assembled(spark, SF)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    again = read_bucketed(spark, f"{root}/labels/", tables["labels"].schema, SPEC.key, 4)
    assert again.exceptAll(tables["labels"]).count() == 0


def test_a_folder_is_read_as_a_bucketed_table_by_another_name(spark):
    root = folder(spark, "buckets")
    own = MT.bucketed_tables(spark, SF, root, SPEC, buckets=4)["user_logs"]
    link = f"{root}-again"
    os.rename(root, link)  # a path that this session's catalog doesn't know
    logs = read_bucketed(spark, f"{link}/user_logs", own.schema, SPEC.key, 4)
    counts = logs.groupBy(SPEC.key).count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString() and counts.count() > 0


def scores(spark, n=1000):
    d = spark.range(n).select(F.concat(F.lit("c"), F.col("id")).alias("customer_id"), F.pmod(F.col("id") * 7919, F.lit(50)).alias("score"))
    return d.withColumn("score", F.when(F.col("score") < 20, 0).otherwise(F.col("score")))  # 40 % share one score


ORDER = [("score", False), ("customer_id", True)]


def test_pages_by_cursor_are_those_by_offset(spark):
    d = scores(spark)
    pages = O.SortedPages.write(d, folder(spark, "pages"), ORDER, partitions=16)
    columns = [F.col("score").desc(), F.col("customer_id").asc()]
    want = [tuple(r) for r in d.orderBy(*columns).collect()]
    cursor, seen = None, []
    for number in range(1, 8):
        page = pages.after(cursor, 150)
        rows = [tuple(r) for r in page.collect()]
        assert rows == [tuple(r) for r in pages.page(number, 150).collect()] == want[150 * (number - 1):150 * number]
        cursor, seen = pages.cursor(page), seen + rows
    assert seen == want and pages.after(cursor, 5).collect() == [] and pages.page(102, 10).collect() == []
    assert [tuple(r) for r in pages.after((49, "c"), 3).collect()] == want[:3]  # a key that no row has


def files_read(df):
    return len(df.inputFiles())


def test_a_deep_page_reads_what_the_first_one_reads(spark):
    d = scores(spark, 4000)
    pages = O.SortedPages.write(d, folder(spark, "pages"), ORDER, partitions=32)
    assert len(pages.parts) == 32 and max(pages.rows) < 2 * 4000 / 32
    deep = pages.page(180, 20)
    key = pages.cursor(deep)
    for page in (pages.page(1, 20), deep, pages.after(key, 20)):
        paths = [p for p in page._jdf.queryExecution().executedPlan().toString().split("\n") if "PartitionFilters" in p]
        assert paths and all("__part" in p for p in paths)
    read = [pages._from(at, 20) for at in range(32)]
    assert all(len(r) <= 2 for r in read)


def test_pages_of_nothing(spark):
    pages = O.SortedPages.write(scores(spark, 0), folder(spark, "pages"), ORDER)
    assert pages.page(1, 10).collect() == [] and pages.after(None, 10).collect() == [] and pages.after((1, "a"), 10).collect() == []


def test_sketch_quantiles_keep_their_rank_bound(spark):
    d = spark.range(60_000).select((F.xxhash64("id") % 1000).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 5.0).alias("y"),
                                   F.lit(None).cast("double").alias("z"), (F.col("id") % 2).alias("g")).repartition(7)
    got = O.sketch_quantiles(d, ["x", "y", "z"], [0.0, 0.1, 0.5, 0.99, 1.0])
    errors = O.quantile_rank_errors(d, got).collect()
    assert {(r["column"], r["p"]) for r in errors} == {(c, p) for c in "xy" for p in (0.0, 0.1, 0.5, 0.99, 1.0)}
    assert all(r["rank_error"] <= 2 * r["bound"] < 0.02 for r in errors)
    exact = {(r["g"], r["p"]): r["value"] for r in O.exact_quantiles(d, ["x"], [0.5], ["g"]).collect()}
    by = {(r["g"], r["p"]): r["value"] for r in O.sketch_quantiles(d, ["x"], [0.5], ["g"]).collect()}
    assert all(by[k] == pytest.approx(v, abs=30) for k, v in exact.items()) and len(by) == 2


def test_kpi_bundle_builds_the_model_table_once(spark, monkeypatch):
    from lapsekit.plans import q_campaign as Q

    built, build = [], MT.build_model_table
    monkeypatch.setattr(MT, "build_model_table", lambda *a, **k: (built.append(1), build(*a, **k))[1])
    assert set(Q.kpi_bundle(spark, SF)) == {"model_stats", "importance", "funnel", "drivers", "cohorts"}
    assert len(built) == 1


def test_forest_keeps_node_ids_and_the_same_trees(spark):
    from lapsekit.ml import models as M

    checkpoint_dir(spark)
    rows = spark.range(400).selectExpr("cast(id % 7 as double) a", "cast(id * 37 % 101 as double) b", "cast(id * 37 % 101 > 50 as int) is_churn")
    prep = M.preprocessing("rf", ["a", "b"]).fit(rows)
    clf = M.learner("rf", prep, ["a", "b"], params={"numTrees": 5, "maxDepth": 4, "minInstancesPerNode": 5})
    assert clf.getCacheNodeIds()
    data = prep.transform(rows)
    plain = clf.copy({clf.cacheNodeIds: False}).fit(data)
    assert clf.fit(data).toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]
