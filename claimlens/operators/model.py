"""Claim-amount modelling with Spark ML (M1 - M15).

Features are one ``pyspark.ml`` PipelineModel: a SQLTransformer that
standard-scales the numeric columns with statistics from one aggregate
(population std, zero std -> 1), a distributed dictionary + OneHotEncoder for
the categoricals (an unseen value maps to the all-zero vector), and a
VectorAssembler. Models, cross-validation and scoring are Spark ML jobs; the
fitted models are small objects on the driver.
"""

from __future__ import annotations

import datetime as _dt
import itertools
import json
import math
import pickle
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasSolver,
                                     HasStepSize)
from pyspark.ml.tuning import CrossValidator
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimlens.functions.exprs import money_mean, money_sum
from claimlens.operators import iforest as IF
from claimlens.operators import trees
from claimlens.operators.boosting import GradientBooster, SecondOrderBooster
from claimlens.operators.common import exact_percentile, global_rank, running_counts
from claimlens.operators.encode import DictionaryEncoder, DictionaryEncoderModel
from claimlens.operators.trees import ForestRegressor
from claimlens.session import cut_lineage

# ---------------------------------------------------------------- fixed values
# Feature lists of the original model (canonical names); absent ones are skipped.
CATEGORICAL_FEATURES = [
    "visit_type", "diagnosis", "treatment", "provider_id", "hospital_county", "employee_gender",
    "claim_weekday", "claim_month", "employer", "category", "age_group", "claim_size",
    "department", "tenure_group",
]
NUMERIC_FEATURES = [
    "employee_age", "co_payment", "is_pre_authorized",
    "inpatient_cap_utilization", "outpatient_cap_utilization", "optical_cap_utilization",
    "dental_cap_utilization", "maternity_cap_utilization", "claim_amount_to_mean",
    "same_day_claims", "employer_z_score",
]
# defaults used when a scoring frame lacks a required column
PREDICT_DEFAULTS = {"employer": "Unknown", "department": "Unknown", "age_group": "35-45",
                    "claim_size": "Medium", "tenure_group": "1-5yrs"}
UTILIZATION_DEFAULT = 0.5

# ---------------------------------------------------------------- M1


def select_features(df: DataFrame, target: str = "amount",
                    numeric: Sequence[str] = NUMERIC_FEATURES,
                    categorical: Sequence[str] = CATEGORICAL_FEATURES,
                    exclude_leaky: bool = True) -> tuple[list[str], list[str]]:
    """Features present in ``df``. ``claim_size`` is derived from the amount, so
    it is left out when the target is the amount (``exclude_leaky``)."""
    cols = set(df.columns)
    num = [c for c in numeric if c in cols and c != target]
    cat = [c for c in categorical if c in cols and c != target]
    if exclude_leaky and target == "amount":
        cat = [c for c in cat if c != "claim_size"]
    if not num and not cat:
        raise ValueError("no usable features")
    return num, cat


def feature_pipeline(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     features_col: str = "features") -> PipelineModel:
    """Fitted feature PipelineModel (scaling statistics from one aggregate)."""
    stages = []
    if numeric:
        st = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        exprs = []
        for i, c in enumerate(numeric):
            m = st[f"m{i}"] or 0.0
            s = st[f"s{i}"] or 1.0
            exprs.append(f"(COALESCE(CAST(`{c}` AS DOUBLE), 0D) - ({m!r}D)) / ({s!r}D) AS `{c}_scaled`")
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__"))
    idx = [f"{c}_idx" for c in categorical]
    ohe = [f"{c}_ohe" for c in categorical]
    if categorical:
        stages.append(DictionaryEncoder(inputCols=list(categorical), outputCols=idx))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[f"{c}_scaled" for c in numeric] + ohe,
                                  outputCol=features_col))
    return Pipeline(stages=stages).fit(df)


def scaled_columns(df: DataFrame, numeric: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The standard-scaled numeric columns (the part of M1 with an SQL oracle)."""
    model = feature_pipeline(df, numeric, [])
    return model.transform(df).select(*keys, *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled")
                                               for c in numeric])


def feature_names(transformed: DataFrame, features_col: str = "features") -> list[str]:
    """Slot names from the assembler's ML attribute metadata; a category's slot has the
    number of its code (``label_slots`` puts the label there)."""
    meta = transformed.schema[features_col].metadata.get("ml_attr", {})
    names: dict[int, str] = {}
    for group in meta.get("attrs", {}).values():
        for a in group:
            names[a["idx"]] = a["name"]
    n = meta.get("num_attrs", len(names))
    return [names.get(i, f"f{i}") for i in range(n)]


def label_slots(slots: DataFrame, feats: PipelineModel) -> DataFrame:
    """``slots`` (with a column feature of slot names) with labels instead of codes, joined
    from the dictionary table."""
    encoder = next((s for s in feats.stages if isinstance(s, DictionaryEncoderModel)), None)
    if encoder is None:
        return slots
    names = encoder.table(slots).select(F.concat_ws("_", "column", F.lit("ohe"), "code").alias("feature"),
                                        F.concat_ws("_", "column", F.lit("ohe"), "value").alias("__label"))
    return slots.join(names, "feature", "left").withColumn("feature", F.coalesce("__label", "feature")).drop("__label")


# ---------------------------------------------------------------- M2


def temporal_split(df: DataFrame, test: float = 0.2, date: str | None = "submission_date",
                   tie_break: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Adds ``split`` = 'train' for the oldest ``floor(n (1 - test))`` rows and
    'test' for the rest; ties on the date are broken by ``tie_break`` columns
    (default: all columns). Without a date column: seeded random split.

    Rows are counted per date, running sums find the date that holds the cut, and only
    that date's rows are ranked (``global_rank``: range partitions, no single task); the
    rest of the table is labelled by comparing dates and is not shuffled.
    """
    if not date or date not in df.columns:
        # seeded draw from a hash of the row: the same split under any partitioning
        u = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)).bitwiseAND(F.lit(2**53 - 1)) / F.lit(float(2**53))
        return df.withColumn("split", F.when(u < 1.0 - test, "train").otherwise("test"))
    tie = list(tie_break) if tie_break is not None else [c for c in df.columns if c != date]
    n = df.count()
    n_train = int(n * (1.0 - test))
    days = df.groupBy(F.col(date).isNull().alias("_z"), F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    cut = (running_counts(days, ["_z", "_d"])
           .filter((F.col("_before") < n_train) & (n_train <= F.col("_before") + F.col("_c"))).first()) if n_train else None
    if cut is None:
        return df.withColumn("split", F.lit("test"))
    if cut["_z"]:                               # the cut lies among the rows without a date
        older, same = F.col(date).isNotNull(), F.col(date).isNull()
    else:
        older, same = F.coalesce(F.col(date) < F.lit(cut["_d"]), F.lit(False)), F.col(date).eqNullSafe(F.lit(cut["_d"]))
    rest = df.filter(~same).withColumn("split", F.when(older, "train").otherwise("test"))
    day = global_rank(df.filter(same), tie, rank_col="_rank") if tie else df.filter(same).withColumn("_rank", F.lit(1))
    return rest.unionByName(day.withColumn("split", F.when(F.col("_rank") <= n_train - cut["_before"], "train")
                                           .otherwise("test")).drop("_rank"))


# ---------------------------------------------------------------- M3 – M6


def gbt(seed: int = 42, **kw) -> GradientBooster:
    return GradientBooster(seed=seed, **kw)


def random_forest(seed: int = 42, **kw) -> ForestRegressor:
    return ForestRegressor(seed=seed, **kw)


def boosted_subsampled(seed: int = 42, **kw) -> SecondOrderBooster:
    """Second-order boosting: all rows and columns by default, subsampled only where the
    caller or the search ranges ask for it."""
    return SecondOrderBooster(seed=seed, **kw)


class _SparseRows:
    """Rows of feature vectors without their zeros: ``starts``, ``cols``, ``vals`` as in CSR."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray):
        keep = vals != 0
        self.starts = np.concatenate([[0], np.cumsum(keep)])[starts]
        self.cols, self.vals = cols[keep], vals[keep]

    def __len__(self) -> int:
        return len(self.starts) - 1

    @classmethod
    def of_vectors(cls, vectors: pa.Array) -> _SparseRows:
        """From a column of Spark ML vectors as Arrow has them (type, size, indices, values); none is null."""
        wide, size, cols, vals = (vectors.field(i) for i in range(4))
        n = pc.list_value_length(vals).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(starts[-1]) - np.repeat(starts[:-1], n)               # a dense vector's columns
        sparse = np.repeat(wide.to_numpy(zero_copy_only=False) == 0, n)
        at[sparse] = cols.flatten().to_numpy(zero_copy_only=False)
        return cls(starts, at, vals.flatten().to_numpy(zero_copy_only=False))

    def split(self, share: float = 1 / 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(common columns, their values as a matrix, rare columns, per row the places of its rare columns and their
        values). A column is common that so large a share of the rows has; short rows end in values of 0."""
        used, at, often = np.unique(self.cols, return_inverse=True, return_counts=True)
        n, is_common = len(self), often >= share * len(self)
        row = np.repeat(np.arange(n), np.diff(self.starts))
        place = np.where(is_common, np.cumsum(is_common), np.cumsum(~is_common))[at] - 1
        many = is_common[at]
        common = np.zeros((n, int(is_common.sum())))
        common[row[many], place[many]] = self.vals[many]
        row, place, vals = row[~many], place[~many], self.vals[~many]
        length = np.bincount(row, minlength=n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        width = int(length.max()) if n else 0
        where, value = np.zeros((n, width), dtype=np.int64), np.zeros((n, width))
        where[row, k], value[row, k] = place, vals
        return used[is_common], common, used[~is_common], where, value

    def times(self, w: np.ndarray) -> np.ndarray:
        """The rows times a matrix."""
        common, values, rare, where, value = self.split()
        out, own = values @ w[common], w[rare]
        for k in range(where.shape[1]):
            out += own[where[:, k]] * value[:, k, None]
        return out


def _mlp_predict(W, X: _SparseRows, act: str) -> np.ndarray:
    h = X.times(W[0][0]) + W[0][1]
    for w, b in W[1:]:
        h = (np.maximum(h, 0) if act == "relu" else np.tanh(h)) @ w + b
    return h[:, 0]


SCALED = 1e100      # past this the scaled moments are brought back to their own size


class _Weights:
    """Weights with Adam's moments, or plain SGD.

    Adam shrinks the moments m and v of every weight in every step, also where the gradient is 0. Here they are
    kept as m / 0.9^t and v / 0.999^t, which only a gradient changes, and beside v its root: a step is one
    division a weight, the same up to rounding."""

    def __init__(self, w: np.ndarray, adam: bool, lr: float):
        self.w, self.adam, self.lr, self.t = np.array(w, dtype="float64"), adam, lr, 0
        self.m, self.v, self.root, self.room = (np.zeros_like(self.w) for _ in range(4))
        self.up_m = self.up_v = 1.0

    def step(self, g: np.ndarray, rows=slice(None)) -> None:
        """One step; ``rows`` have the gradient ``g``, all others 0."""
        if not self.adam:
            self.w[rows] -= self.lr * g
            return
        self.t += 1
        self.up_m, self.up_v = self.up_m / 0.9, self.up_v / 0.999
        for up, arrays in (("up_m", ((self.m, 1),)), ("up_v", ((self.v, 1), (self.root, 2)))):
            if getattr(self, up) > SCALED:
                for a, power in arrays:
                    a /= getattr(self, up) ** (1 / power)
                setattr(self, up, 1.0)
        self.m[rows] += 0.1 * self.up_m * g
        v = self.v[rows] + 0.001 * self.up_v * (g * g)
        self.v[rows], self.root[rows] = v, np.sqrt(v)
        back = math.sqrt(self.up_v * (1 - 0.999 ** self.t))             # root / back is Adam's root of v
        np.add(self.root, 1e-8 * back, out=self.room)
        np.divide(self.m, self.room, out=self.room)
        self.room *= self.lr * back / (self.up_m * (1 - 0.9 ** self.t))
        self.w -= self.room


def _local_epochs(W, X: _SparseRows, y, act, solver, lr, batch, epochs, rng):
    """Mini-batch epochs over one partition's rows (Adam or plain SGD).

    Weights of columns that no row has keep their value in each step and take no part."""
    common, values, rare, where, value = X.split()
    sizes = [(len(common), W[0][0].shape[1]), *[w.shape for w, _ in W[1:]]]
    ends = np.cumsum([0, *[s for a, b in sizes for s in (a * b, b)]])
    flat = _Weights(np.concatenate([W[0][0][common].ravel(), W[0][1], *[a.ravel() for layer in W[1:] for a in layer]]), solver == "adam", lr)
    seldom = _Weights(W[0][0][rare], solver == "adam", lr)
    g = np.zeros_like(flat.w)

    def layers(a: np.ndarray) -> list:
        return [(a[lo:mid].reshape(s), a[mid:hi]) for s, lo, mid, hi in zip(sizes, ends[0::2], ends[1::2], ends[2::2])]

    net, grads = layers(flat.w), layers(g)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            ix = order[s:s + batch]
            at, by = where[ix], value[ix]
            h = values[ix]
            acts = [h]
            for i, (w, b) in enumerate(net):
                z = h @ w
                if not i:
                    for k in range(at.shape[1]):
                        z += seldom.w[at[:, k]] * by[:, k, None]
                z += b
                h = z if i == len(net) - 1 else (np.maximum(z, 0) if act == "relu" else np.tanh(z))
                acts.append(h)
            delta = (acts[-1][:, 0] - y[ix])[:, None] / len(ix)         # d(0.5 * mse)/dout
            for i in range(len(net) - 1, -1, -1):
                np.matmul(acts[i].T, delta, out=grads[i][0])
                delta.sum(axis=0, out=grads[i][1])
                if i:
                    delta = delta @ net[i][0].T
                    delta = delta * (acts[i] > 0) if act == "relu" else delta * (1 - acts[i] ** 2)
            if len(rare):
                row, k = np.nonzero(by)
                o = np.argsort(at[row, k], kind="stable")
                place = at[row, k][o]
                first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, int)
                parts = delta[row[o]] * by[row, k][o][:, None]
                seldom.step(np.add.reduceat(parts, first) if len(first) else parts, place[first])
            flat.step(g)
    out = layers(flat.w)
    first = W[0][0].copy()
    first[common], first[rare] = out[0][0], seldom.w
    return [(first, out[0][1].copy()), *[(w.copy(), b.copy()) for w, b in out[1:]]]


class _MLPParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed, HasSolver):
    hidden = Param(Params._dummy(), "hidden", "sizes of the hidden layers", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "relu or tanh", TypeConverters.toString)
    localEpochs = Param(Params._dummy(), "localEpochs", "epochs between two averages", TypeConverters.toInt)
    batchSize = Param(Params._dummy(), "batchSize", "rows of a mini-batch", TypeConverters.toInt)


class MLPRegressorModel(Model, _MLPParams, DefaultParamsReadable, DefaultParamsWritable):
    """Scores with the averaged weights (Arrow UDF, one batch at a time, zeros left out)."""

    weights = Param(Params._dummy(), "weights", "layers and target scale as JSON", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        net = json.loads(self.getOrDefault(self.weights))
        layers = [(np.asarray(w), np.asarray(b)) for w, b in net["layers"]]
        act, mean, std = self.getOrDefault(self.activation), net["mean"], net["std"]

        @F.arrow_udf("double")
        def predict(vectors: pa.Array) -> pa.Array:
            return pa.array(_mlp_predict(layers, _SparseRows.of_vectors(vectors), act) * std + mean)

        return df.withColumn(self.getPredictionCol(), predict(F.col(self.getFeaturesCol())))


MERGE = 32      # weight sets averaged by one task


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Row-weighted mean of weight sets."""
    rows = pdf["n"].to_numpy(dtype="float64")
    sets = [pickle.loads(w) for w in pdf["w"]]
    mean = [tuple(sum(s[i][j] * r for s, r in zip(sets, rows)) / rows.sum() for j in (0, 1)) for i in range(len(sets[0]))]
    return pd.DataFrame({"slot": [int(pdf["slot"].iloc[0]) // MERGE], "w": [pickle.dumps(mean)], "n": [int(rows.sum())]})


class MLPRegressorEstimator(Estimator, _MLPParams, DefaultParamsReadable, DefaultParamsWritable):
    """Small multi-layer perceptron regressor trained data-parallel.

    Each round broadcasts the weights; every task runs ``localEpochs`` of mini-batches
    over its rows, one Arrow batch after another, and returns one weight set. The sets
    are averaged by rows in a tree of tasks (``MERGE`` at a time), so the driver gets at
    most ``MERGE`` of them. ``maxIter`` bounds rounds x local epochs. The rows are written once,
    without their zeros: a row costs what it holds, however many one-hot columns there are.
    """

    @keyword_only
    def __init__(self, *, hidden: Sequence[int] = (50,), activation: str = "relu", solver: str = "adam",
                 maxIter: int = 200, localEpochs: int = 5, stepSize: float = 1e-3, batchSize: int = 200,
                 seed: int = 42, featuresCol: str = "features", labelCol: str = "label",
                 predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(hidden=[50], activation="relu", solver="adam", maxIter=200, localEpochs=5, stepSize=1e-3,
                         batchSize=200, seed=42, featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**{k: list(v) if k == "hidden" else v for k, v in self._input_kwargs.items()})

    def _fit(self, df: DataFrame) -> MLPRegressorModel:
        get = self.getOrDefault
        label = F.col(self.getLabelCol()).cast("double")
        st = df.agg(F.avg(label).alias("m"), F.stddev_pop(label).alias("s")).first()
        y_mean, y_std = float(st["m"] or 0.0), float(st["s"] or 1.0) or 1.0

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    x = _SparseRows.of_vectors(b.column(0))
                    yield pa.RecordBatch.from_pylist([{
                        "dim": max(s or 0 for s in b.column(0).field(1).to_pylist()) or len(b.column(0).field(3)[0]),
                        "starts": x.starts.astype("<i8").tobytes(), "cols": x.cols.astype("<i4").tobytes(),
                        "vals": x.vals.astype("<f8").tobytes(), "y": b.column(1).to_numpy(zero_copy_only=False).astype("<f8").tobytes()}],
                        pa.schema([("dim", pa.int32()), *[(c, pa.binary()) for c in ("starts", "cols", "vals", "y")]]))

        data = cut_lineage(df.select(F.col(self.getFeaturesCol()).alias("x"), ((label - y_mean) / y_std).alias("y")).mapInArrow(
            pack, "dim int, starts binary, cols binary, vals binary, y binary"))
        dim = data.first()["dim"]
        seed, act, solver, lr = get(self.seed), get(self.activation), get(self.solver), get(self.stepSize)
        batch, epochs = get(self.batchSize), get(self.localEpochs)
        rng = np.random.default_rng(seed)
        sizes = [dim, *get(self.hidden), 1]
        W = [(rng.normal(0, math.sqrt(2.0 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])]
        sc, tasks, schema = df.sparkSession.sparkContext, data.rdd.getNumPartitions(), "slot long, w binary, n long"
        for r in range(max(1, get(self.maxIter) // epochs)):
            bw = sc.broadcast(W)

            def local(batches, _bw=bw, _r=r):
                from pyspark import TaskContext
                slot = TaskContext.get().partitionId()
                own, n = _bw.value, 0
                rng_local = np.random.default_rng([_r, slot])
                for pdf in batches:
                    for p in pdf.itertuples(index=False):
                        x = _SparseRows(np.frombuffer(p.starts, "<i8"), np.frombuffer(p.cols, "<i4"), np.frombuffer(p.vals, "<f8"))
                        own = _local_epochs(own, x, np.frombuffer(p.y, "<f8"), act, solver, lr, batch, epochs, rng_local)
                        n += len(x)
                if n:
                    yield pd.DataFrame({"slot": [slot], "w": [pickle.dumps(own)], "n": [n]})

            parts, left = data.mapInPandas(local, schema), tasks
            while left > MERGE:
                parts = parts.groupBy(F.floor(F.col("slot") / MERGE)).applyInPandas(_average, schema)
                left = -(-left // MERGE)
            W = pickle.loads(_average(parts.orderBy("slot").toPandas())["w"][0])   # at most MERGE rows
            bw.unpersist()
        net = {"layers": [(w.tolist(), b.tolist()) for w, b in W], "mean": y_mean, "std": y_std}
        model = MLPRegressorModel()
        model._set(weights=json.dumps(net), activation=act, featuresCol=self.getFeaturesCol(),
                   predictionCol=self.getPredictionCol())
        return model


def mlp(**kw) -> MLPRegressorEstimator:
    return MLPRegressorEstimator(**kw)


# ---------------------------------------------------------------- M7


def evaluate(df: DataFrame, label: str = "amount", prediction: str = "prediction") -> DataFrame:
    """MAE, RMSE and R^2 as plain aggregates (two passes: mean, then errors)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    ok = df.filter(y.isNotNull() & p.isNotNull())
    mean = ok.agg(F.avg(label).alias("_ybar"))
    e = ok.crossJoin(F.broadcast(mean))  # one-row side
    m = e.agg(F.avg(F.abs(y - p)).alias("mae"),
              F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
              F.sum((y - p) * (y - p)).alias("_ssr"),
              F.sum((y - F.col("_ybar")) * (y - F.col("_ybar"))).alias("_sst"))
    return m.select(F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"),
                    F.round(F.lit(1.0) - F.try_divide(F.col("_ssr"), F.col("_sst")), 6).alias("r2"))


# ---------------------------------------------------------------- M8 – M10


@dataclass
class Trained:
    name: str
    model: PipelineModel
    metrics: dict = field(default_factory=dict)
    numeric: list = field(default_factory=list)
    categorical: list = field(default_factory=list)


def _with_label(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double")).filter(F.col("label").isNotNull())


ON_COLUMNS = (ForestRegressor, SecondOrderBooster)      # these take raw columns, the others feature vectors


def _on_columns(estimator, numeric: Sequence[str], categorical: Sequence[str]):
    return estimator.copy({estimator.numericCols: list(numeric), estimator.categoricalCols: list(categorical)})


def _on_codes(estimator, numeric: Sequence[str], categorical: Sequence[str]):
    """The boosted trees read the numbers and codes that the feature pipeline makes its vectors of."""
    if not isinstance(estimator, GradientBooster):
        return estimator
    return estimator.copy({estimator.numericCols: [f"{c}_scaled" for c in numeric], estimator.codeCols: [f"{c}_idx" for c in categorical]})


def fit_model(train: DataFrame, estimator, numeric: Sequence[str], categorical: Sequence[str],
              target: str = "amount") -> PipelineModel:
    """The fitted model, over raw columns or feature vectors as its estimator takes them."""
    if isinstance(estimator, ON_COLUMNS):
        return PipelineModel(stages=[_on_columns(estimator, numeric, categorical).fit(_with_label(train, target))])
    feats = feature_pipeline(train, numeric, categorical)
    estimator = _on_codes(estimator, numeric, categorical)
    reg = estimator.fit(feats.transform(_with_label(train, target)))
    return PipelineModel(stages=[feats, reg])


def train_and_evaluate(split_df: DataFrame, name: str, estimator, target: str = "amount",
                       numeric: Sequence[str] | None = None,
                       categorical: Sequence[str] | None = None) -> Trained:
    num, cat = (list(numeric), list(categorical)) if numeric is not None else select_features(split_df, target)
    train = split_df.filter(F.col("split") == "train")
    test = split_df.filter(F.col("split") == "test")
    model = fit_model(train, estimator, num, cat, target)
    m = evaluate(model.transform(test), target).first().asDict()
    return Trained(name, model, m, num, cat)


#: the original estimators' settings; its forest grows without a depth limit (0)
GBT_PARAMS = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}
RF_PARAMS = {"numTrees": 100, "maxDepth": 0, "minSamplesSplit": 2}
BOOSTED_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.3}
MLP_PARAMS = {"hidden": [50], "maxIter": 500}


def default_estimators() -> dict:
    return {"GradientBoosting": gbt(**GBT_PARAMS), "RandomForest": random_forest(**RF_PARAMS),
            "BoostedSubsampled": boosted_subsampled(**BOOSTED_PARAMS), "NeuralNetwork": mlp(**MLP_PARAMS)}


def auto_select(split_df: DataFrame, estimators: dict | None = None, target: str = "amount", parallelism: int = 4,
                train: Callable[[str], Trained] | None = None) -> tuple[DataFrame, Trained]:
    """Train every estimator, ``parallelism`` at a time (their small jobs share the cluster),
    rank by R^2 (leaderboard DataFrame) and keep the best. ``train``: another way to get the
    trained model of a name, such as a registry of models."""
    estimators = estimators or default_estimators()
    spark = split_df.sparkSession
    make = inheritable_thread_target(spark)(train or (lambda n: train_and_evaluate(split_df, n, estimators[n], target)))
    with ThreadPool(max(1, min(parallelism, len(estimators)))) as pool:
        results = pool.map(make, list(estimators))
    board = spark.createDataFrame(
        [(r.name, r.metrics["mae"], r.metrics["rmse"], r.metrics["r2"]) for r in results],
        "model string, mae double, rmse double, r2 double").orderBy(F.col("r2").desc())
    best = max(results, key=lambda r: -math.inf if r.metrics["r2"] is None else r.metrics["r2"])
    return board, best


# grids of the original search
GBT_GRID = {"maxIter": [100, 200, 300], "stepSize": [0.01, 0.05, 0.1], "maxDepth": [3, 5, 7]}
RF_GRID = {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 0], "minSamplesSplit": [2, 5, 10]}


def sample_param_maps(estimator, grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct grid points drawn without replacement (all when the
    grid is smaller)."""
    keys = sorted(grid)
    points = list(itertools.product(*[grid[k] for k in keys]))
    rnd = random.Random(seed)
    chosen = points if len(points) <= n_iter else rnd.sample(points, n_iter)
    return [{estimator.getParam(k): v for k, v in zip(keys, pt)} for pt in chosen]


def sample_ranges(estimator, n_iter: int, seed: int = 42) -> list[dict]:
    """Random draws from the tuning ranges of the boosted model (log-uniform step size)."""
    rnd = random.Random(seed)
    maps = []
    for _ in range(n_iter):
        maps.append({
            estimator.getParam("maxIter"): rnd.randint(50, 500),
            estimator.getParam("maxDepth"): rnd.randint(3, 10),
            estimator.getParam("stepSize"): math.exp(rnd.uniform(math.log(0.001), math.log(0.1))),
            estimator.getParam("subsamplingRate"): rnd.uniform(0.5, 1.0),
            estimator.getParam("columnSamplingRate"): rnd.uniform(0.5, 1.0),
        })
    return maps


def random_search(train: DataFrame, estimator, param_maps: list[dict], folds: int = 5,
                  target: str = "amount", seed: int = 42, parallelism: int = 2,
                  numeric: Sequence[str] | None = None,
                  categorical: Sequence[str] | None = None) -> tuple[PipelineModel, DataFrame]:
    """k-fold cross-validated search minimising MAE on the training data only.
    Returns the refitted best model and a table of (params, mean MAE). The draws of a
    forest share the trees of each fold (``trees.search``)."""
    num, cat = (list(numeric), list(categorical)) if numeric is not None else select_features(train, target)
    spark, schema = train.sparkSession, "params string, cv_mae double"

    def table_of(maes) -> list[tuple[str, float]]:
        return [(";".join(f"{p.name}={v}" for p, v in sorted(pm.items(), key=lambda kv: kv[0].name)), float(m))
                for pm, m in zip(param_maps, maes)]

    if isinstance(estimator, ForestRegressor):
        forest = _on_columns(estimator, num, cat)
        maes = trees.search(_with_label(train, target), forest, [{p.name: v for p, v in pm.items()} for pm in param_maps], folds)
        best = param_maps[min(range(len(maes)), key=maes.__getitem__)]
        return fit_model(train, forest.copy(best), num, cat, target), spark.createDataFrame(table_of(maes), schema)
    if isinstance(estimator, ON_COLUMNS):
        feats, estimator = None, _on_columns(estimator, num, cat)
        data = cut_lineage(_with_label(train, target).select(*num, *cat, "label"))
    else:
        feats = feature_pipeline(train, num, cat)
        estimator = _on_codes(estimator, num, cat)
        read = [estimator.getOrDefault(p) for p in (estimator.numericCols, estimator.codeCols)] if isinstance(estimator, GradientBooster) else []
        data = cut_lineage(feats.transform(_with_label(train, target)).select("features", "label", *itertools.chain(*read)))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_maps,
                        evaluator=RegressionEvaluator(metricName="mae"), numFolds=folds,
                        parallelism=parallelism, seed=seed)
    cvm = cv.fit(data)
    return PipelineModel(stages=[feats, cvm.bestModel] if feats else [cvm.bestModel]), spark.createDataFrame(table_of(cvm.avgMetrics), schema)


def feature_importance(model: PipelineModel, sample: DataFrame) -> DataFrame:
    """(feature, importance) descending: tree importances, |coef| for linear
    models, uniform otherwise."""
    feats, reg = model.stages[0], model.stages[-1]
    if hasattr(reg, "importances"):                     # trees on raw columns
        return sample.sparkSession.createDataFrame(reg.importances(sample), "feature string, importance double").orderBy(
            F.col("importance").desc())
    names = feature_names(feats.transform(sample.limit(1)))
    if hasattr(reg, "featureImportances"):
        imp = reg.featureImportances.toArray().tolist()
    elif hasattr(reg, "coefficients"):
        imp = np.abs(reg.coefficients.toArray()).tolist()
    else:
        imp = [1.0 / len(names)] * len(names)
    slots = sample.sparkSession.createDataFrame(list(zip(names, [float(x) for x in imp])), "feature string, importance double")
    return label_slots(slots, feats).orderBy(F.col("importance").desc())


# ---------------------------------------------------------------- M11 – M13


def fill_defaults(df: DataFrame, required: Sequence[str], as_of: _dt.date,
                  numeric: Sequence[str] = ()) -> DataFrame:
    """Scoring frame with exactly ``required`` columns in order: an absent
    ``*_utilization`` column is 0.5, absent weekday/month are those of
    ``as_of``, other named defaults apply, anything else is 0; numeric nulls
    become 0 and other columns are cast to text."""
    defaults = dict(PREDICT_DEFAULTS)
    defaults["claim_weekday"] = as_of.strftime("%A")
    defaults["claim_month"] = as_of.strftime("%B")
    out = []
    for c in required:
        if c in df.columns:
            x = F.col(c)
            out.append((F.coalesce(x.cast("double"), F.lit(0.0)) if c in numeric else x.cast("string")).alias(c))
        elif c.endswith("_utilization"):
            out.append(F.lit(UTILIZATION_DEFAULT).alias(c))
        elif c in defaults:
            out.append(F.lit(defaults[c]).alias(c))
        else:
            out.append(F.lit(0.0 if c in numeric else "0").alias(c))
    return df.select(*out)


@dataclass
class FraudModel:
    forest: IF.Forest
    offset: float       # score percentile at the contamination share
    threshold: float    # 1st percentile of the decision values


def fit_fraud_model(train: DataFrame, feats: PipelineModel, n_trees: int = 100,
                    contamination: float = 0.01, seed: int = 42) -> FraudModel:
    """Isolation forest on the model's feature vectors (one-hot + scaled), read as the
    numbers and category codes they are made of, which are written once."""
    one_hot = _made_of(feats)
    x = cut_lineage(feats.transform(train).select(F.xxhash64(*[F.col(c) for c in train.columns]).alias("_row"), *one_hot.columns))
    forest = IF.iforest_fit(x, [], n_trees=n_trees, seed=seed, one_hot=one_hot, row_hash="_row")
    scored = cut_lineage(IF.iforest_score(x, forest).select("anomaly_score"))
    offset = exact_percentile(scored, "anomaly_score", contamination)
    thr = exact_percentile(scored.withColumn("_d", F.col("anomaly_score") - F.lit(offset)), "_d", 0.01)
    return FraudModel(forest, offset, thr)


def _made_of(feats: PipelineModel) -> IF.OneHot:
    """The columns that ``feature_pipeline`` makes its vectors of."""
    encoder = next((s for s in feats.stages if isinstance(s, DictionaryEncoderModel)), None)
    codes = encoder.getOutputCols() if encoder else []
    sizes = json.loads(encoder.getOrDefault(encoder.sizes)) if encoder else {}
    made = feats.stages[-1].getInputCols()
    return IF.OneHot(made[:len(made) - len(codes)], codes, [sizes[c] for c in encoder.getInputCols()] if encoder else [])


def score_claims(df: DataFrame, model: PipelineModel, fraud: FraudModel | None = None) -> DataFrame:
    """predicted_amount, is_potential_fraud (decision below the threshold) and
    fraud_confidence = 1 - decision."""
    scored = model.transform(df).withColumnRenamed("prediction", "predicted_amount")
    if fraud is None:
        return scored.withColumn("is_potential_fraud", F.lit(False))
    x = IF.iforest_score(scored, fraud.forest)
    d = F.col("anomaly_score") - F.lit(fraud.offset)
    return (x.withColumn("is_potential_fraud", d < F.lit(fraud.threshold))
             .withColumn("fraud_confidence", F.lit(1.0) - d))


def prediction_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(money_sum("predicted_amount").alias("total_predicted"),
                      money_mean("predicted_amount").alias("mean_predicted"),
                      F.count_if(F.col("is_potential_fraud")).alias("fraud_count"))


# ---------------------------------------------------------------- M14


def shapley_contributions(explain: DataFrame, background: DataFrame, model: PipelineModel,
                          features: Sequence[str], permutations: int = 20, seed: int = 42,
                          row_id: str = "row_id") -> DataFrame:
    """Monte-Carlo Shapley values per (row, raw feature).

    For each explained row and permutation a background row is drawn; the
    permutation order comes from hashing (row, permutation, feature), and the
    d + 1 hybrid rows (first j features from the explained row, the rest from
    the background row) are scored in one ``model.transform``. Marginal
    differences along each chain are averaged per (row, feature). The result is
    additive: sum of contributions = f(x) - mean f(background draws).
    """
    features = list(features)
    d = len(features)
    # the background is a small sample chosen by the caller; number its rows
    bg = background.select(*features).withColumn("_bid", F.row_number().over(
        Window.orderBy(F.xxhash64(*[F.col(c) for c in features], F.lit(seed)))) - 1)
    n_bg = bg.count()
    x = explain.select(row_id, *[F.col(c).alias(f"x__{c}") for c in features])
    x = x.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    x = x.withColumn("_bid", F.pmod(F.xxhash64(F.col(row_id), F.col("perm"), F.lit(seed)), F.lit(n_bg)))
    x = x.join(bg, "_bid")  # background rows are a small, bounded sample
    # position of every feature in this permutation
    keys = F.array(*[F.struct(F.xxhash64(F.col(row_id), F.col("perm"), F.lit(i), F.lit(seed)).alias("h"),
                              F.lit(i).alias("f")) for i in range(d)])
    x = x.withColumn("_order", F.transform(F.array_sort(keys), lambda s: s["f"]))
    x = x.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    # feature i comes from the explained row once the chain has reached its position
    hybrid = [F.when(F.array_position(F.col("_order"), F.lit(i)) <= F.col("step"), F.col(f"x__{c}"))
               .otherwise(F.col(c)).alias(c) for i, c in enumerate(features)]
    pts = x.select(row_id, "perm", "step", F.col("_order"), *hybrid)
    pred = model.transform(pts).select(row_id, "perm", "step", "_order", "prediction")
    w = Window.partitionBy(row_id, "perm").orderBy("step")  # d + 1 rows per chain
    marg = (pred.withColumn("delta", F.col("prediction") - F.lag("prediction").over(w))
                .filter(F.col("step") > 0)
                .withColumn("fidx", F.element_at(F.col("_order"), F.col("step").cast("int"))))
    names = F.array(*[F.lit(c) for c in features])
    return (marg.groupBy(row_id, "fidx").agg(F.avg("delta").alias("contribution"))
                .select(row_id, F.element_at(names, F.col("fidx") + 1).alias("feature"), "contribution"))


# ---------------------------------------------------------------- M15


def log_metrics(spark: SparkSession, path: str, model_name: str, metrics: dict,
                at: _dt.datetime | None = None) -> None:
    """Append one row to the metric history (parquet, append-only)."""
    ts = at or _dt.datetime.now()
    spark.createDataFrame([(ts, model_name, metrics.get("mae"), metrics.get("rmse"), metrics.get("r2"))],
                          "timestamp timestamp, model string, mae double, rmse double, r2 double") \
        .write.mode("append").parquet(path)


def model_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("timestamp")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
