"""Data-quality checks (A8, A14, A23, A40, A41): the statements' sanity queries, kept as
jobs whose one-row (or per-segment) results can be asserted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import attach_total, count_flagged
from tillroll.operators.geography import country_cancellation_metrics
from tillroll.plans.model import CART, PRODUCT_VIEW, Model, shared


@shared
def dq_product_event_identity(m: Model) -> DataFrame:
    """Product events and how many carry a user ('total_users' counts events)."""
    return m.events.filter(F.col("event_type") == PRODUCT_VIEW).agg(
        F.count(F.lit(1)).alias("total_users"),
        F.count("user_id").alias("non_null_user_events"))


def dq_funnel_users(m: Model) -> DataFrame:
    """Distinct product users, cart users and all users of fact_events (v2)."""
    kind = F.col("event_type")
    return count_flagged(m.fact_events_v2, [], "user_id", {
        "product_users": kind == PRODUCT_VIEW, "cart_users": kind == CART, "total_users": F.lit(True)})


def dq_country_cancellation(m: Model) -> DataFrame:
    """Identical to A6, not stored."""
    return country_cancellation_metrics(m)


@shared
def dq_null_event_users(m: Model) -> DataFrame:
    """A40."""
    return m.fact_events_all.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("user_id").isNull()).alias("null_user_events"))


def dq_sessions_users(m: Model) -> DataFrame:
    """A41. Events are reduced to one row per session and one per user, each counted by itself: no
    event is copied per distinct count."""
    sessions = count_flagged(m.fact_events_all, [], "session_id", {"sessions": F.lit(True)})
    users = count_flagged(m.fact_events_all, [], "user_id", {"users": F.lit(True)})
    return attach_total(sessions, users, "users")
