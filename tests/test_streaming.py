import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import tenancy
from plumbline.sources import corpus
from plumbline.streaming import usage
from tests.compare import SF


def test_daily_usage(spark, tmp_path):
    corpus.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")).withColumnRenamed("event_type", "action")
    q = usage.daily_usage(s).writeStream.format("memory").queryName("daily").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == corpus.table(spark, SF, "events").count()


def test_billing_stream_in_any_order(spark, tmp_path):
    schema = "customer_id long, event_type string, status string, price_id string, period_end long, ts timestamp, seq long"
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "customer.subscription.updated", "active", "price_team", 0, t, 2), (1, "checkout.session.completed", "trialing", "price_pro", 0, t, 1), (2, "invoice.payment_failed", "active", "price_pro", 0, t, 3), (2, "other", "active", "price_pro", 0, t, 9), (3, "customer.subscription.deleted", "unpaid", None, 0, t, 4)]
    rows += [(4, "invoice.payment_failed", None, None, None, t, 7), (4, "invoice.payment_succeeded", None, None, None, t, 8), (4, "customer.subscription.updated", "active", "price_pro", 60, t, 5)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = usage.billing_stream(s).writeStream.format("memory").queryName("billing").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {r["customer_id"]: (r["status"], r["tier"]) for r in spark.table("billing").collect()}
    batch = {r["customer_id"]: (r["status"], r["tier"]) for r in tenancy.billing_state(spark.createDataFrame(rows, schema)).collect()}
    assert batch == {1: ("active", "team"), 2: ("past_due", "free"), 3: ("canceled", "free"), 4: ("past_due", "pro")}
    assert last == batch
