"""Usage counts and subscription state as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.common import ship
from plumbline.operators.tenancy import BILLING


def daily_usage(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(day, action, n) from a stream of (ts, action); events later than `lateness` are left out."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "action", "n")


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: time and status of the latest event, time and tier of the latest one that isn't a failed payment."""
    none = (-1 << 62, -1 << 62)
    at, status, of, tier = (state.get[:2], state.get[2], state.get[3:5], state.get[5]) if state.exists else (none, None, none, "free")
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            now, failed = (int(r.ts.value // 1000), int(r.seq)), r.event_type == "invoice.payment_failed"
            if r.event_type == "invoice.payment_succeeded" and r.status is None and r.price_id is None:
                continue
            if now > tuple(at):
                at, status = now, "past_due" if failed else {"active": "active", "past_due": "past_due", "canceled": "canceled", "unpaid": "canceled"}.get(r.status, "inactive")
            if not failed and now > tuple(of):
                of, tier = now, "pro" if "pro" in (r.price_id or "") else "team" if "team" in (r.price_id or "") else "free"
    if status is not None:
        state.update((*at, status, *of, tier))
        yield pd.DataFrame({"customer_id": [key[0]], "status": [status], "tier": [tier]})


def billing_stream(events: DataFrame) -> DataFrame:
    """(customer_id, status, tier) after each batch for the customers it touched; order of arrival doesn't matter."""
    ship(events.sparkSession)
    known = events.where(F.col("event_type").isin(BILLING))
    return known.groupBy("customer_id").applyInPandasWithState(_fold, "customer_id long, status string, tier string", "us long, seq long, status string, of_us long, of_seq long, tier string", "update", GroupStateTimeout.NoTimeout)
