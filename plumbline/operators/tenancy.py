"""Users, quotas, saved repositories and subscription state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed

BILLING = ["checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_succeeded", "invoice.payment_failed"]


def quota_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, *x) for t, x in fixed.QUOTAS.items()], "tier string, repositories int, analyses_per_month int, history_days int")


def limit_of(tier: Column, action: Column) -> Column:
    """Limit of an action for a tier; null for an action not known."""
    pick = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for t, q in fixed.QUOTAS.items() for x in (t, q[i])]), tier)
    return F.when(action == "add_repository", pick(0)).when(action == "run_analysis", pick(1))


def allowed(tier: Column, action: Column, used: Column) -> Column:
    return F.coalesce(used < limit_of(tier, action), F.lit(False))


def month_to_date(usage: DataFrame, action: str, now: Column | None = None) -> DataFrame:
    """(user, used): uses of an action since the month of `now` began (the log's last time unless given)."""
    if now is None:
        now = F.lit(usage.agg(F.max("ts")).first()[0])
    return usage.where((F.col("action") == action) & (F.col("ts") >= F.date_trunc("month", now)) & (F.col("ts") <= now)).groupBy("user").agg(F.count(F.lit(1)).alias("used"))


def quota_status(users: DataFrame, used: DataFrame, action: str) -> DataFrame:
    """(user, tier, used, quota, can)."""
    x = users.join(used, "user", "left").fillna(0, ["used"])
    return x.select("user", "tier", "used", limit_of(F.col("tier"), F.lit(action)).alias("quota"), allowed(F.col("tier"), F.lit(action), F.col("used")).alias("can"))


def active_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.where("is_active").groupBy("user").agg(F.count(F.lit(1)).alias("used"))


def upsert(saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user, repo, is_active, change): saved rows, reactivated where wanted, and the wanted ones that are new."""
    key = ["user", "repo"]
    again = saved.join(wanted.select(*key).distinct().withColumn("__w", F.lit(True)), key, "left")
    kept = again.select(*key, (F.col("is_active") | F.col("__w").isNotNull()).alias("is_active"), F.when(F.col("__w").isNotNull() & ~F.col("is_active"), "reactivated").when(F.col("__w").isNotNull(), "present").otherwise("untouched").alias("change"))
    new = wanted.select(*key).distinct().join(saved, key, "left_anti").select(*key, F.lit(True).alias("is_active"), F.lit("inserted").alias("change"))
    return kept.unionByName(new)


def enrich(remote: DataFrame, saved: DataFrame) -> DataFrame:
    """remote with is_saved and last_analyzed (the latest), by user and repo; by repo only where a side has no users."""
    key = ["user", "repo"] if "user" in remote.columns and "user" in saved.columns else ["repo"]
    s = saved.groupBy(*key).agg(F.max("last_analyzed").alias("last_analyzed")).withColumn("__s", F.lit(True))
    return remote.join(s, key, "left").withColumn("is_saved", F.col("__s").isNotNull()).drop("__s")


def count_analyses(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """repositories with analysis_count raised by its runs and last_analyzed moved on."""
    r = runs.groupBy("repo").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__t"))
    x = repositories.join(r, "repo", "left")
    return x.withColumn("analysis_count", F.col("analysis_count") + F.coalesce("__n", F.lit(0))).withColumn("last_analyzed", F.greatest("last_analyzed", "__t")).drop("__n", "__t")


def append_usage(log: DataFrame, more: DataFrame) -> DataFrame:
    return log.unionByName(more, allowMissingColumns=True)


def subscription_status(status: Column) -> Column:
    return F.when(status == "active", "active").when(status == "past_due", "past_due").when(status.isin("canceled", "unpaid"), "canceled").otherwise("inactive")


def tier_of_price(price: Column) -> Column:
    return F.when(price.contains("pro"), "pro").when(price.contains("team"), "team").otherwise("free")


def billing_state(events: DataFrame) -> DataFrame:
    """(customer_id, status, tier, end_date): the state that each customer's events leave, in the order of (ts, seq).

    events: (customer_id, event_type, status, price_id, period_end, ts, seq). A failed payment sets the status to past due
    and nothing else; all others set status, tier and end date from their subscription. A succeeded invoice without a
    subscription (neither status nor price) is ignored. A customer without any subscription event is free, without an
    end date. Latest-wins is one aggregation with map-side combine, no window.
    """
    failed = F.col("event_type") == "invoice.payment_failed"
    bare = (F.col("event_type") == "invoice.payment_succeeded") & F.col("status").isNull() & F.col("price_id").isNull()
    known = events.where(F.col("event_type").isin(BILLING) & ~bare)
    at = F.struct("ts", "seq", "event_type", "status", "price_id", "period_end")
    last = known.groupBy("customer_id").agg(F.max(at).alias("e"), F.max(F.when(~failed, at)).alias("s"))
    status = F.when(F.col("e.event_type") == "invoice.payment_failed", "past_due").otherwise(subscription_status(F.col("e.status")))
    return last.select("customer_id", status.alias("status"), tier_of_price(F.col("s.price_id")).alias("tier"), F.timestamp_seconds("s.period_end").alias("end_date"))


def get_or_create_customers(users: DataFrame, customers: DataFrame) -> DataFrame:
    """(user, customer_id, created): existing customers, and an id made from the user for others."""
    x = users.select("user").distinct().join(customers.select("user", "customer_id"), "user", "left")
    return x.select("user", F.coalesce("customer_id", F.concat(F.lit("cus_"), F.substring(F.md5(F.col("user").cast("string")), 1, 14))).alias("customer_id"), F.col("customer_id").isNull().alias("created"))
