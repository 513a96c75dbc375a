"""The online lockout keeps a user's run across micro-batches and equals the batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators.audit import failed_login_burst
from claimlens.operators.common import prefix_sums
from claimlens.streaming import login_lockout as LL

SCHEMA = "event_id long, user string, timestamp timestamp, action string"
T0 = dt.datetime(2024, 1, 1, 12)


def _stream(spark, folder, batches):
    """Each batch arrives as a file and is taken by its own run of the query."""
    ids = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/src")
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{folder}/src")
        q = LL.start_lockout(src, folder, 3)
        q.awaitTermination()
        ids += [p["batchId"] for p in q.recentProgress if p["numInputRows"]]
    return ids, {tuple(r) for r in LL.read_lockouts(spark, folder).collect()}


def test_run_survives_three_batches(spark, tmp_path):
    batches = [[(1, "A", 0, "error"), (2, "B", 0, "error"), (3, "B", 1, "signup"), (4, "B", 2, "error")],
               [(5, "A", 3, "error")], [(6, "A", 5, "error"), (7, "B", 6, "error")]]
    _, got = _stream(spark, str(tmp_path), [[(e, u, T0 + dt.timedelta(minutes=m), a) for e, u, m, a in rows] for rows in batches])
    assert {r[0]: r[4:] for r in got} == {1: (1, False), 2: (1, False), 3: (0, False), 4: (1, False), 5: (2, False), 6: (3, True), 7: (2, False)}


def test_many_batches_equal_the_batch_form(spark, tmp_path, monkeypatch):
    """A user with over a third of the events, pauses of days, ties, other actions, null users;
    the carry is written whole in between."""
    monkeypatch.setattr(LL, "COMPACT", 3)
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        user = rnd.choice(["hot", "hot", "hot", *"abcdefg", None])
        rows.append((i, user, T0 + dt.timedelta(hours=6 * (i // 3)), rnd.choice(["error"] * 5 + ["signup", "view"])))
    batches = [rows[i:i + 150] for i in range(0, 900, 150)]
    ids, got = _stream(spark, str(tmp_path), batches)
    assert len(set(ids)) >= 5
    want = {tuple(r) for r in failed_login_burst(spark.createDataFrame(rows, SCHEMA), 3).select(
        "event_id", "user", "timestamp", "action", "failures_in_run", "locked").collect()}
    assert got == want and len(got) > 500


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    sink, carry = f"{tmp_path}/sink", f"{tmp_path}/carry"
    one = spark.createDataFrame([(1, "A", T0, "error"), (2, "A", T0 + dt.timedelta(1), "error")], SCHEMA)
    two = spark.createDataFrame([(3, "A", T0 + dt.timedelta(2), "error")], SCHEMA)
    LL.lockout_batch(one, 0, sink, carry)
    for _ in range(2):
        LL.lockout_batch(two, 1, sink, carry)
    LL.lockout_batch(one.limit(0), 2, sink, carry)
    got = {r["event_id"]: (r["failures_in_run"], r["locked"]) for r in LL.read_lockouts(spark, str(tmp_path)).collect()}
    assert got == {1: (1, False), 2: (2, False), 3: (3, True)}
    assert [tuple(r) for r in LL.read_carry(spark, carry, 3).collect()] == [("A", 3)]
    assert LL.read_carry(spark, f"{tmp_path}/none", 5).count() == 0


def test_a_user_is_split_over_tasks(spark):
    ev = spark.range(4000).select(F.col("id").alias("event_id"), F.lit("hot").alias("user"), F.lit(1.0).alias("_f"))
    parts = prefix_sums(ev, ["user", "event_id"], ["_f"], n_parts=8).select(F.spark_partition_id().alias("p"))
    assert parts.count() == 4000
    spread = ev.repartitionByRange(8, "user", "event_id").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1000


@pytest.mark.parametrize("carried", [0, 2])
def test_carry_only_reaches_the_first_run(spark, carried):
    rows = [(1, "A", T0, "error"), (2, "A", T0 + dt.timedelta(1), "signup"), (3, "A", T0 + dt.timedelta(2), "error"), (4, "B", T0, "error")]
    carry = spark.createDataFrame([("A", carried), ("C", 9)], "user string, failures long")
    got = {r["event_id"]: r["failures_in_run"] for r in failed_login_burst(spark.createDataFrame(rows, SCHEMA), 3, carry=carry).collect()}
    assert got == {1: 1 + carried, 2: 0, 3: 1, 4: 1}
