"""The build of the claims table: the rows of the SQL view, and work that keeps to the input's size."""

import datetime as dt

from claimlens.session import shuffle_partitions
from claimlens.sources import fixtures as fx

DAY = dt.datetime(1996, 3, 1)


def _tables(spark, d):
    """Six tables with keys that are null, repeated or without a partner."""
    rows = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(1, 1, 1, 1, 5.0, 10.5, 0.1, 0.0, "N", "O", DAY), (1, 1, 1, 1, 5.0, 10.5, 0.1, 0.0, "N", "O", DAY),
                      (1, 2, 2, 2, 1.0, None, 0.04, 0.0, "R", "F", None), (2, 20, 1, 3, None, 7.0, None, 0.0, None, None, DAY),
                      (None, 1, 1, 4, 5.0, 1.0, 0.1, 0.0, "N", "O", DAY), (2, None, 1, 5, 5.0, 1.0, 0.1, 0.0, "N", "O", DAY),
                      (2, 1, 99, 6, 5.0, 1.0, 0.1, 0.0, "N", "O", DAY), (9, 1, 1, 7, 5.0, 1.0, 0.1, 0.0, "N", "O", DAY)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string",
                   [(1, 1, DAY, "1-URGENT"), (1, 2, None, None), (2, 2, DAY, "2-HIGH"), (3, 1, DAY, "5-LOW"), (None, 1, DAY, "5-LOW")]),
        "customer": ("c_custkey long, c_nationkey long, c_mktsegment string", [(1, 1, "BUILDING"), (2, 2, None), (2, 1, "MACHINERY"), (None, 1, "x")]),
        "nation": ("n_nationkey long, n_name string", [(1, "KENYA"), (2, None), (None, "x")]),
        "supplier": ("s_suppkey long, s_name string", [(1, "S1"), (1, "S1b"), (2, None), (None, "x")]),
        "part": ("p_partkey long, p_brand string, p_type string", [(1, "B1", "T1"), (2, None, "T2"), (20, "B20", None), (None, "x", "x")]),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")


def test_claims_are_the_rows_of_the_sql_view(spark, tmp_path):
    _tables(spark, tmp_path)
    for t in fx._TABLES:
        spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(t)
    want = sorted(map(str, spark.sql(fx.CLAIMS_SQL).collect()))
    assert len(want) > 8
    assert sorted(map(str, fx.claims(spark, str(tmp_path)).collect())) == want
    assert sorted(map(str, fx.claims(spark, str(tmp_path), materialized=False).collect())) == want


def test_claims_table_is_not_shuffled_whole_again(spark, tmp_path, monkeypatch):
    """Partitions grow with the line items, and what is written comes from the last join."""
    _tables(spark, tmp_path)
    seen, view = [], fx.claims_view

    def watched(s, d):
        seen.append(int(s.conf.get("spark.sql.shuffle.partitions")))
        return view(s, d)

    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(fx, "claims_view", watched)
    monkeypatch.setattr(fx, "PARTITION_BYTES", 64)
    fx.materialize_claims(spark, str(tmp_path), f"{tmp_path}/claims")
    assert seen[0] > 20 and spark.conf.get("spark.sql.shuffle.partitions") == before
    plan = view(spark, str(tmp_path)).sortWithinPartitions("employer", "date")._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "MergeJoin" in plan
    by_supplier = [x for x in plan.splitlines() if "hashpartitioning(l_suppkey" in x]
    assert not by_supplier


def test_shuffle_partitions_are_put_back(spark):
    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, size = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(merged)
    try:
        with shuffle_partitions(spark, 77) as n:
            assert n == int(spark.conf.get("spark.sql.shuffle.partitions")) == max(77, int(before))
            raise KeyError
    except KeyError:
        pass
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(merged)) == (before, size)
