"""Audit-event analyses: latest events and failed-login bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.operators.common import prefix_sums, top_n


def audit_tail(df: DataFrame, n: int = 10, per: list[str] | None = None,
               ts: str = "timestamp", key: str = "event_id") -> DataFrame:
    """The ``n`` most recent events (per tenant when ``per`` is given); ties by key."""
    order = [F.col(ts).desc(), F.col(key).desc()]
    return top_n(df, order, n, per)


def failed_login_burst(df: DataFrame, k: int = 3, user: str = "user", ts: str = "timestamp",
                       action: str = "action", failure: str = "error", success: str = "signup",
                       key: str = "event_id", carry: DataFrame | None = None) -> DataFrame:
    """Per login event: failures since the user's last success, and a lock flag
    once that run reaches ``k`` (a success resets the run). ``carry``: (user, failures)
    that were open before these events.

    Skew-safe formulation (a user may own a third of all events): global running
    counts of successes and failures in (user, time, key) order come from
    ``prefix_sums`` (range partitions, so one user's history is split across
    tasks). A run is identified by (user, successes so far); its starting
    failure count is a grouped minimum (map-side combined), joined back on the
    run key. No window ever holds a whole user.
    """
    ev = (df.filter(F.col(action).isin(failure, success) & F.col(user).isNotNull())
            .select(key, user, ts, action)
            .withColumn("_s", (F.col(action) == success).cast("double"))
            .withColumn("_f", (F.col(action) == failure).cast("double")))
    p = prefix_sums(ev, [user, ts, key], ["_s", "_f"])
    base = p.groupBy(user, "cum__s").agg(F.min(F.col("cum__f") - F.col("_f")).alias("_base"))
    if carry is not None:       # a user's first run here goes on from the carried one
        first = p.groupBy(user).agg(F.min(F.col("cum__s") - F.col("_s")).alias("cum__s"))
        base = (base.join(first.join(carry.select(user, "failures"), user), [user, "cum__s"], "left")
                .withColumn("_base", F.col("_base") - F.coalesce("failures", F.lit(0))).drop("failures"))
    out = p.join(base, [user, "cum__s"])
    fails = (F.col("cum__f") - F.col("_base")).cast("long")
    return out.select(key, user, ts, action, fails.alias("failures_in_run"),
                      (fails >= k).alias("locked"))
