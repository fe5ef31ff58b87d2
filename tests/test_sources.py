"""Fixed-schema reads, pruned scans, stage writes, versioned publish."""

import os
import uuid

from pyspark.sql import functions as F

from lapsekit.session import checkpoint_dir
from lapsekit.sources import testdata as TD
from lapsekit.sources.tables import publish, read_published, read_table, write_stage
from lapsekit.spec import SCORES_SCHEMA

SF = "/root/testdata/sf0.001"


def test_read_write_roundtrip_and_pruning(spark):
    base = os.path.join(checkpoint_dir(spark), f"src-{uuid.uuid4().hex[:6]}")
    write_stage(TD.transactions(spark, SF), os.path.join(base, "txn"))
    t = read_table(spark, "transactions", os.path.join(base, "txn"), columns=["customer_id", "transaction_date"])
    plan = t.filter(F.col("transaction_date") <= 20010131)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<customer_id:string,transaction_date:int>" in plan
    assert t.count() == TD.transactions(spark, SF).count()


def test_csv_reader_fixed_schema(spark):
    base = os.path.join(checkpoint_dir(spark), f"csv-{uuid.uuid4().hex[:6]}")
    TD.members(spark, SF).write.option("header", True).csv(base)
    m = read_table(spark, "members", base, fmt="csv")
    assert dict(m.dtypes)["registration_init_time"] == "int" and m.count() == 150


def test_publish_swaps_pointer(spark):
    root = os.path.join(checkpoint_dir(spark), f"pub-{uuid.uuid4().hex[:6]}")
    df = spark.createDataFrame([("c1", 0.12345678, "high_risk")], "customer_id string, churn_proba double, risk_tier string")
    v1 = publish({"customer_churn_scores": df}, root, {"customer_churn_scores": SCORES_SCHEMA})
    got = read_published(spark, root, "customer_churn_scores")
    assert got.columns == [f.name for f in SCORES_SCHEMA.fields]
    assert str(got.first()["churn_proba"]) == "0.12346"
    v2 = publish({"customer_churn_scores": df}, root)
    assert v1 != v2 and open(os.path.join(root, "CURRENT")).read() == v2


def test_missing_column_is_refused(spark):
    import pytest
    base = os.path.join(checkpoint_dir(spark), f"src-{uuid.uuid4().hex[:6]}")
    write_stage(TD.transactions(spark, SF).drop("is_cancel"), base)
    with pytest.raises(ValueError, match="is_cancel"):
        read_table(spark, "transactions", base)
