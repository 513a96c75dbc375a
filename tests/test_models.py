"""Property tests for the randomised operators (isolation forest, models,
Shapley values) and the stream = batch check."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import clean, iforest
from claimlens.operators import model as M
from claimlens.session import cut_lineage

AS_OF = dt.date(2002, 1, 1)


@pytest.fixture(scope="module")
def split(spark, claims_small):
    return cut_lineage(M.temporal_split(clean.clean_claims(claims_small, AS_OF), 0.2))


def test_iforest_planted_outliers_score_lowest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (2000, 2)))]
    rows += [(10_000 + i, 15.0 + i, -15.0) for i in range(10)]  # planted
    df = spark.createDataFrame(rows, "id long, a double, b double")
    forest = iforest.iforest_fit(df, ["a", "b"], n_trees=50, seed=7)
    flagged, thr = iforest.iforest_flag(iforest.iforest_score(df, forest), 0.01)
    planted = flagged.filter(F.col("id") >= 10_000)
    assert planted.filter(F.col("fraud_flag") == 1).count() == 10
    assert flagged.filter(F.col("fraud_flag") == 1).count() <= 21
    # deterministic under the seed
    again = iforest.iforest_fit(df, ["a", "b"], n_trees=50, seed=7)
    assert again.nodes.equals(forest.nodes)
    # every tree was grown from at most psi rows
    assert forest.nodes.groupby("tree")["size"].max().max() <= 256


def test_iforest_sample_independent_of_partitioning(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x"))
    f1 = iforest.iforest_fit(df.repartition(3), ["x"], n_trees=10, seed=1, key_cols=["id"])
    f2 = iforest.iforest_fit(df.repartition(11), ["x"], n_trees=10, seed=1, key_cols=["id"])
    assert f1.nodes.equals(f2.nodes)


def test_iforest_draws_each_copy_of_a_repeated_row(spark):
    """Half of the rows are one row: it fills about half of every tree, and no tree's
    group holds more than its bounded share."""
    df = spark.range(40000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("id"),
                                   F.when(F.col("id") % 2 == 0, -50.0).otherwise(F.col("id") % 97).cast("double").alias("x"))
    f = iforest.iforest_fit(df, ["x"], n_trees=20, seed=3)
    assert set(f.nodes[f.nodes.node == 0]["size"]) == {256}
    leaves = f.nodes[f.nodes.feature < 0].groupby("tree")["size"].max()
    assert 110 < leaves.mean() < 146 and leaves.min() > 90 and leaves.max() < 170
    again = iforest.iforest_fit(df.repartition(5), ["x"], n_trees=20, seed=3)
    assert again.nodes.equals(f.nodes)


def test_iforest_copies_below_and_above_the_tree_count_agree(spark):
    """The two ways to draw copies take the same share of the rows."""
    df = spark.range(30000).select((F.col("id") % 600).alias("id"), (F.col("id") % 600).cast("double").alias("x"))
    many = iforest.iforest_fit(df, ["x"], n_trees=40, seed=5)      # 50 copies each, above 40
    few = iforest.iforest_fit(df, ["x"], n_trees=60, seed=5)       # below 60
    for f in (many, few):
        assert set(f.nodes[f.nodes.node == 0]["size"]) == {256}
    mid = lambda f: f.nodes[f.nodes.node == 0]["threshold"].mean()
    assert abs(mid(many) - mid(few)) < 100


def test_temporal_split_oldest_rows_train(split):
    counts = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    n = sum(counts.values())
    assert counts["train"] == int(n * 0.8)
    last_train = split.filter(F.col("split") == "train").agg(F.max("submission_date")).first()[0]
    first_test = split.filter(F.col("split") == "test").agg(F.min("submission_date")).first()[0]
    assert last_train <= first_test


def test_unknown_category_maps_to_zero_vector(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double")
    fp = M.feature_pipeline(train, ["x"], ["c"])
    out = fp.transform(spark.createDataFrame([("zzz", 1.0), (None, 1.0), ("a", 1.0)], "c string, x double"))
    vecs = [r["features"].toArray().tolist() for r in out.collect()]
    assert len(vecs[0]) == 3  # 1 scaled + 2 categories
    assert vecs[0][1:] == [0.0, 0.0] and vecs[1][1:] == [0.0, 0.0] and vecs[2][1:] == [1.0, 0.0]
    slots = spark.createDataFrame([(i, n) for i, n in enumerate(M.feature_names(out))], "i int, feature string")
    assert [r["feature"] for r in M.label_slots(slots, fp).orderBy("i").collect()] == ["x_scaled", "c_ohe_a", "c_ohe_b"]


def test_dictionary_equals_string_indexer(spark, claims_small):
    """Same vectors as StringIndexer + OneHotEncoder; labels never come to the driver."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    from claimlens.operators.encode import DictionaryEncoder
    cols = ["treatment", "provider_id", "employer"]
    odd = spark.createDataFrame([(None, "z", "Ä"), ("b", None, "a b"), ("b", "x", None)], "treatment string, provider_id string, employer string")
    train = claims_small.select(*cols).limit(500).unionByName(odd)
    new = spark.createDataFrame([("never", "x", None), ("b", "", "Ä")], "treatment string, provider_id string, employer string")
    rows = train.unionByName(new).withColumn("i", F.monotonically_increasing_id())
    idx, ohe = [f"{c}_i" for c in cols], [f"{c}_o" for c in cols]
    last = OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error")
    got = Pipeline(stages=[DictionaryEncoder(inputCols=cols, outputCols=idx), last]).fit(train)
    want = Pipeline(stages=[StringIndexer(inputCols=cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"), last]).fit(train)
    a, b = ({r["i"]: r for r in m.transform(rows).select("i", *idx, *ohe).collect()} for m in (got, want))
    assert len(a) == len(b) == rows.count() and a == b
    path = tempfile.mkdtemp(prefix="dict-") + "/m"
    got.write().overwrite().save(path)
    again = M.load_model(path)
    assert {r["i"]: r for r in again.transform(rows).select("i", *idx, *ohe).collect()} == a
    empty = DictionaryEncoder(inputCols=cols, outputCols=idx).fit(train.limit(0)).transform(new)
    assert {tuple(r[c] for c in idx) for r in empty.collect()} == {(0.0, 0.0, 0.0)}


def test_gbt_beats_mean_predictor_and_importance(spark, split):
    t = M.train_and_evaluate(split, "gbt", M.gbt(maxIter=10))
    assert t.metrics["r2"] > 0.0
    imp = M.feature_importance(t.model, split).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6
    assert imp[0]["importance"] >= imp[-1]["importance"]


def test_mlp_learns(spark, split):
    t = M.train_and_evaluate(split, "mlp", M.mlp(hidden=(16,), maxIter=20, localEpochs=5))
    assert t.metrics["r2"] > 0.0
    # saved, loaded and scored again; searched over its parameters
    path = tempfile.mkdtemp(prefix="mlp-") + "/m"
    reg = t.model.stages[-1]
    reg.write().overwrite().save(path)
    rows = t.model.stages[0].transform(split.limit(20))
    assert (M.MLPRegressorModel.load(path).transform(rows).select("prediction").collect()
            == reg.transform(rows).select("prediction").collect())
    est = M.mlp(maxIter=5)
    maps = M.sample_param_maps(est, {"hidden": [[4], [8]], "stepSize": [1e-3]}, 2)
    _, table = M.random_search(split.filter(F.col("split") == "train"), est, maps, folds=2)
    assert table.count() == 2


def _dense_epochs(W, X, y, act, adam, lr, batch, epochs, rng):
    """Textbook mini-batch epochs over all columns."""
    m, v, t = [np.zeros_like(a) for a in W], [np.zeros_like(a) for a in W], 0
    for _ in range(epochs):
        order = rng.permutation(len(X))
        for s in range(0, len(X), batch):
            x, want, t = X[order[s:s + batch]], y[order[s:s + batch]], t + 1
            z = x @ W[0] + W[1]
            h = np.maximum(z, 0) if act == "relu" else np.tanh(z)
            d = ((h @ W[2] + W[3])[:, 0] - want)[:, None]
            back = (d @ W[2].T) * ((z > 0) if act == "relu" else 1 - h ** 2)
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                g = g / len(x)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g ** 2
                W[i] = W[i] - (lr * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8) if adam else lr * g)
    return W


@pytest.mark.parametrize("act, solver", [("relu", "adam"), ("tanh", "adam"), ("relu", "sgd")])
def test_mlp_epochs_without_zeros_equal_dense_ones(act, solver):
    rng = np.random.default_rng(3)
    n, wide = 500, 3000
    X = np.zeros((n, 4 + wide))
    X[:, :3] = rng.normal(size=(n, 3))
    X[np.arange(n), 4 + rng.integers(0, wide, n)] = 1.0         # a wide category, and a column without rows
    X[: n // 2, 4 + 7] = -2.5
    X[5] = 0.0
    y = X[:, 0] + X[:, 11] + rng.normal(size=n)
    W = [rng.normal(0, 0.3, (4 + wide, 6)), np.zeros(6), rng.normal(0, 0.3, (6, 1)), np.zeros(1)]
    row, col = np.nonzero(X)
    rows = M._SparseRows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), col, X[row, col])
    want = _dense_epochs(list(W), X, y, act, solver == "adam", 1e-2, 64, 40, np.random.default_rng(1))
    (w0, b0), (w1, b1) = M._local_epochs([(W[0], W[1]), (W[2], W[3])], rows, y, act, solver, 1e-2, 64, 40, np.random.default_rng(1))
    for a, b in zip(want, (w0, b0, w1, b1)):
        np.testing.assert_allclose(a, b, rtol=1e-6, atol=1e-8)
    assert (w0[3] == W[0][3]).all()                             # no row has this column
    common, values, rare, where, value = rows.split()
    assert values.shape[1] == 4 and where.shape == value.shape == (n, 1) and len(rare) < n   # not as wide as the table
    np.testing.assert_allclose(rows.times(W[0]), X @ W[0], atol=1e-12)


def test_mlp_scaled_moments_come_back_to_size(monkeypatch):
    g = np.random.default_rng(0).normal(size=(300, 4, 2))

    def after(limit):
        monkeypatch.setattr(M, "SCALED", limit)
        w = M._Weights(np.ones((4, 2)), True, 1e-2)
        for x in g:
            w.step(x[:2], np.array([0, 2]))
        return w.w

    np.testing.assert_allclose(after(1e100), after(1.5), rtol=1e-9)


def test_mlp_takes_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import DenseVector, SparseVector
    rng = np.random.default_rng(5)
    x = np.where(rng.random((60, 7)) < 0.5, rng.normal(size=(60, 7)), 0.0)
    rows = [(i, DenseVector(v) if i % 3 == 0 else SparseVector(7, np.flatnonzero(v), v[np.flatnonzero(v)]), float(v[0])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["i", "features", "label"])
    dense = spark.createDataFrame([(i, DenseVector(x[i]), y) for i, _, y in rows], ["i", "features", "label"])
    est = M.mlp(hidden=(5,), maxIter=20, batchSize=16)
    a, b = (est.fit(d.coalesce(1).orderBy("i").coalesce(1)).transform(df).orderBy("i").collect() for d in (df, dense))
    np.testing.assert_allclose([r["prediction"] for r in a], [r["prediction"] for r in b], rtol=1e-9)


def test_mlp_averages_weight_sets_by_rows():
    import pickle

    import pandas as pd
    sets = [[(np.full((2, 1), float(v)), np.array([v * 2.0]))] for v in (1, 5)]
    out = M._average(pd.DataFrame({"slot": [32, 40], "w": [pickle.dumps(s) for s in sets], "n": [3, 1]}))
    (w, b), = pickle.loads(out["w"][0])
    assert out["slot"][0] == 1 and out["n"][0] == 4
    assert w.tolist() == [[2.0], [2.0]] and b.tolist() == [4.0]


def test_auto_select_and_search(spark, split):
    board, best = M.auto_select(split, {"a": M.gbt(maxIter=5), "b": M.random_forest(numTrees=5)})
    rows = board.collect()
    assert len(rows) == 2 and rows[0]["r2"] >= rows[1]["r2"] and best.name == rows[0]["model"]
    est = M.random_forest()
    maps = M.sample_param_maps(est, M.RF_GRID, 3)
    assert len(maps) == 3 and len({tuple(sorted((p.name, v) for p, v in m.items())) for m in maps}) == 3
    model, table = M.random_search(split.filter(F.col("split") == "train"), est,
                                   M.sample_param_maps(est, {"numTrees": [3, 5], "maxDepth": [3]}, 2), folds=2)
    assert table.count() == 2
    ranges = M.sample_ranges(M.boosted_subsampled(), 4)
    assert all(0.001 <= [v for p, v in m.items() if p.name == "stepSize"][0] <= 0.1 for m in ranges)


def test_shapley_additivity(spark, split):
    t = M.train_and_evaluate(split, "gbt", M.gbt(maxIter=5))
    feats = t.numeric + t.categorical
    test = split.filter(F.col("split") == "test").withColumn("row_id", F.xxhash64("claim_id", "line_no", "amount"))
    ex = test.orderBy("row_id").limit(3)
    bg = split.filter(F.col("split") == "train").orderBy(F.xxhash64("claim_id", "line_no")).limit(1)
    sh = M.shapley_contributions(ex, bg, t.model, feats, permutations=5)
    fx = {r["row_id"]: r["prediction"] for r in t.model.transform(ex).select("row_id", "prediction").collect()}
    fz = t.model.transform(bg).first()["prediction"]
    for r in sh.groupBy("row_id").agg(F.sum("contribution").alias("s")).collect():
        assert r["s"] == pytest.approx(fx[r["row_id"]] - fz, rel=1e-6, abs=1e-6)


def test_score_claims_and_save_load(spark, split):
    t = M.train_and_evaluate(split, "gbt", M.gbt(maxIter=5))
    train = split.filter(F.col("split") == "train")
    fm = M.fit_fraud_model(train, t.model.stages[0], n_trees=10)
    sc = M.score_claims(split.filter(F.col("split") == "test"), t.model, fm)
    s = M.prediction_summary(sc).first()
    n = split.filter(F.col("split") == "test").count()
    assert s["fraud_count"] <= max(1, int(0.05 * n))
    path = tempfile.mkdtemp(prefix="model-") + "/m"
    M.save_model(t.model, path)
    back = M.load_model(path)
    a = t.model.transform(train.limit(5)).select("prediction").collect()
    b = back.transform(train.limit(5)).select("prediction").collect()
    assert a == b
    hist = tempfile.mkdtemp(prefix="hist-") + "/h"
    M.log_metrics(spark, hist, "gbt", t.metrics)
    M.log_metrics(spark, hist, "rf", t.metrics)
    assert M.model_history(spark, hist).count() == 2


def test_fill_defaults_columns(spark):
    df = spark.createDataFrame([(None, "x")], "employee_age double, employer string")
    r = M.fill_defaults(df, ["employee_age", "employer", "claim_weekday", "dental_cap_utilization", "other"],
                        AS_OF, ["employee_age", "other"]).first()
    assert r.asDict() == {"employee_age": 0.0, "employer": "x", "claim_weekday": "Tuesday",
                          "dental_cap_utilization": 0.5, "other": 0.0}


def test_stream_equals_batch(spark):
    from __spark_entry__ import queries
    from claimlens.sources.fixtures import audit_events
    out = queries()["audit_stream"](spark, "/root/testdata/sf0.001")
    ev = audit_events(spark, "/root/testdata/sf0.001")
    exp = ev.groupBy(F.window("timestamp", "1 hour").alias("w"), "action").count()
    assert out.count() == exp.count()
    assert out.agg(F.sum("events")).first()[0] == exp.agg(F.sum("count")).first()[0]


def test_random_split_fallback_is_partition_independent(spark, claims_small):
    c = claims_small.drop("submission_date")
    a = M.temporal_split(c, 0.2, date=None).groupBy("split").count().collect()
    b = M.temporal_split(c.repartition(5), 0.2, date=None).groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    n_test = dict((r["split"], r["count"]) for r in a)["test"]
    assert 0.1 * c.count() < n_test < 0.3 * c.count()


def test_stream_watermark_drops_late_rows(spark):
    """Second micro-batch brings rows older than the watermark: they are not
    counted, while on-time rows of the same batch are."""
    import json
    import os
    from claimlens.streaming import audit_stream as ST
    base = tempfile.mkdtemp(prefix="wm-")
    src = os.path.join(base, "source", "tenant=acme")
    os.makedirs(src)

    def write(name, rows):
        with open(os.path.join(src, name), "w") as f:
            for ts, action in rows:
                f.write(json.dumps({"timestamp": ts, "user": "u", "action": action, "target": None, "ip": ""}) + "\n")

    write("a.json", [("2024-01-01T00:10:00", "login"), ("2024-01-01T05:00:00", "login")])
    q = ST.start_counts(spark, os.path.join(base, "source"), os.path.join(base, "sink"),
                        os.path.join(base, "ckpt"))
    q.awaitTermination()
    write("b.json", [("2024-01-01T00:20:00", "late"), ("2024-01-01T09:30:00", "login")])
    q = ST.start_counts(spark, os.path.join(base, "source"), os.path.join(base, "sink"),
                        os.path.join(base, "ckpt"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "sink"))
    actions = {r["action"] for r in out.collect()}
    assert "late" not in actions
    hours = {r["window_start"].hour for r in out.collect()}
    assert {0, 5} <= hours  # windows closed by the advancing watermark were emitted once
    # the open window is read from the state: every accepted event is counted
    every = ST.all_counts(spark, os.path.join(base, "sink"), os.path.join(base, "ckpt")).collect()
    assert sorted((r["window_start"].hour, r["events"]) for r in every) == [(0, 1), (5, 1), (9, 1)]
