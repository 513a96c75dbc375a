"""Building blocks shared by several operators.

* ``top_n``      – ordered limit (global: TakeOrderedAndProject) or per group
                   (row_number over the *aggregated* table).
* ``month_spine``– every month between the first and last month of a date
                   column (per group if asked), produced with ``sequence`` from a
                   one-row-per-group min/max aggregate, never from the raw rows.
* ``prefix_sums``– running totals in a global order without a one-partition
                   window: range partitioning, local cumulative sums, and a
                   per-partition offset table whose size is the partition count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from claimlens.session import cut_lineage


def _order(cols: Sequence[str | Column]) -> list[Column]:
    out = []
    for c in cols:
        out.append(F.col(c).asc_nulls_last() if isinstance(c, str) else c)
    return out


def top_n(df: DataFrame, order: Sequence[str | Column], n: int,
          per: Sequence[str] | None = None, rank_col: str | None = None,
          salt_buckets: int = 16) -> DataFrame:
    """First ``n`` rows by ``order``; with ``per`` the first ``n`` rows of each group.

    Without ``per`` this is ``orderBy().limit()`` which Spark executes as a
    per-partition top-k followed by a single merge of k rows per partition.
    With ``per`` it runs in two stages so a group holding a large share of the
    rows is never ranked by one task: rows are first ranked within
    (group, salt) buckets, where the salt is a hash of the row, keeping ``n``
    per bucket; the final per-group ranking then sees at most
    ``n x salt_buckets`` rows per group. The result is the exact top-n.
    """
    if not per:
        out = df.orderBy(*_order(order)).limit(n)
        if rank_col:
            w = Window.orderBy(*_order(order))  # at most n rows here
            out = out.withColumn(rank_col, F.row_number().over(w))
        return out
    rc = rank_col or "_rank"
    src = df
    if salt_buckets and salt_buckets > 1:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt_buckets))
        w1 = Window.partitionBy(*per, "_salt").orderBy(*_order(order))
        src = (df.withColumn("_salt", salt)
                 .withColumn("_r1", F.row_number().over(w1))
                 .filter(F.col("_r1") <= n).drop("_salt", "_r1"))
    w = Window.partitionBy(*per).orderBy(*_order(order))
    out = src.withColumn(rc, F.row_number().over(w)).filter(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)


def month_spine(df: DataFrame, date_col: str = "date", per: Sequence[str] | None = None,
                out_col: str = "month_start") -> DataFrame:
    """All month starts from the first to the last month of ``date_col`` (per group)."""
    per = list(per or [])
    bounds = (df.filter(F.col(date_col).isNotNull())
                .groupBy(*per)
                .agg(F.trunc(F.min(date_col), "MM").alias("_lo"),
                     F.trunc(F.max(date_col), "MM").alias("_hi")))
    return bounds.select(*per, F.explode(
        F.sequence(F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 MONTH"))).alias(out_col))


def monthly(df: DataFrame, aggs: Sequence[Column], date_col: str = "date",
            per: Sequence[str] | None = None, fill: dict | None = None) -> DataFrame:
    """Month-end resample: aggregates per calendar month, empty months included.

    Rows with a null date are dropped (as a time-indexed resample does); the
    result is labelled by the last day of the month.
    """
    per = list(per or [])
    base = df.filter(F.col(date_col).isNotNull()).withColumn(
        "month_start", F.trunc(F.col(date_col), "MM"))
    agg = base.groupBy(*per, "month_start").agg(*aggs)
    spine = month_spine(agg, "month_start", per)    # the months are known: no second scan of the rows
    keys = per + ["month_start"]
    out = spine.join(agg, keys, "left")
    if fill:
        out = out.fillna(fill)
    return out.select(*per, F.last_day("month_start").alias("month"),
                      *[c for c in agg.columns if c not in keys])


def _sort_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in cols]


def prefix_sums(df: DataFrame, order_cols: Sequence[str | Column], sum_cols: Sequence[str],
                n_parts: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in the global order of ``order_cols``.

    1. range-partition on the order columns (so no single task sees a large
       share of the rows unless one order key does),
    2. per partition: sort and take local cumulative sums (Arrow batches),
    3. checkpoint, so partition ids are stable, then add the totals of all
       earlier partitions from a table with one row per partition.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sum_cols = list(sum_cols)
    cum_names = [prefix + c for c in sum_cols]
    order = _sort_cols(order_cols)
    ranged = df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    out_schema = T.StructType(
        list(ranged.schema.fields)
        + [T.StructField(n, T.DoubleType(), False) for n in cum_names]
        + [T.StructField("_pid", T.IntegerType(), False),
           T.StructField("_pos", T.LongType(), False)])

    def local(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = [0.0] * len(sum_cols)
        pos = 0
        for pdf in batches:
            for i, (c, cn) in enumerate(zip(sum_cols, cum_names)):
                cs = pdf[c].astype("float64").fillna(0.0).cumsum() + carry[i]
                if len(cs):
                    carry[i] = float(cs.iloc[-1])
                pdf[cn] = cs
            pdf["_pid"] = pid
            pdf["_pos"] = range(pos, pos + len(pdf))
            pos += len(pdf)
            yield pdf

    local_df = cut_lineage(ranged.mapInPandas(local, out_schema))
    part_tot = local_df.groupBy("_pid").agg(*[F.max_by(cn, "_pos").alias(cn) for cn in cum_names])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_tot.select(
        "_pid", *[F.coalesce(F.sum(cn).over(w), F.lit(0.0)).alias("_off_" + cn)
                  for cn in cum_names])  # one row per partition
    out = local_df.join(F.broadcast(offsets), "_pid")
    return out.select(*df.columns, *[(F.col(cn) + F.col("_off_" + cn)).alias(cn)
                                     for cn in cum_names])


def global_rank(df: DataFrame, order_cols: Sequence[str | Column], n_parts: int | None = None,
                rank_col: str = "rank") -> DataFrame:
    """1-based position of each row in the total order of ``order_cols``, JVM-only.

    Range-partition and sort within partitions; in the same stage
    ``monotonically_increasing_id`` is (partition id << 33) + the row's position
    inside its sorted partition. The ranged rows are materialised once (stable
    partition ids), the per-partition row counts (one row per partition) give
    each partition's offset, and rank = offset + position + 1.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _sort_cols(order_cols)
    ranged = (df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                .withColumn("__pid", F.spark_partition_id())
                .withColumn("__mid", F.monotonically_increasing_id()))
    mat = cut_lineage(ranged)
    counts = mat.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (mat.join(F.broadcast(offsets), "__pid")   # one row per partition
               .withColumn(rank_col, (F.col("__off") + pos + 1).cast("long"))
               .drop("__pid", "__mid", "__off"))


def running_counts(counts: DataFrame, order_cols: Sequence[str], n_col: str = "_c") -> DataFrame:
    """``counts`` (one row per distinct value) with ``_before``: the sum of ``n_col``
    over all earlier values in the total order of ``order_cols``.

    Range partitions hold distinct values, so a frequent value is one row; the running
    sum is a window per partition plus an offset per partition (one row each)."""
    ranged = cut_lineage(counts.repartitionByRange(*order_cols).withColumn("__pid", F.spark_partition_id()))
    local = Window.partitionBy("__pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__pid").agg(F.sum(n_col).alias("__n"))
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__pid", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    return (ranged.withColumn("__in", F.coalesce(F.sum(n_col).over(local), F.lit(0)))
                  .join(F.broadcast(offsets), "__pid")   # one row per partition
                  .withColumn("_before", F.col("__off") + F.col("__in")).drop("__pid", "__in", "__off"))


def exact_percentiles(df: DataFrame, specs: Sequence[tuple[str, float]],
                      accuracy: int = 10000) -> dict[tuple[str, float], float | None]:
    """Exact linear-interpolated percentiles (numpy's default) of one or more
    columns, without holding a column's values in one task.

    Three passes shared by all requested (column, q) pairs:
      1. one aggregate: non-null counts and sketch brackets around each q
         (``percentile_approx``: bounded memory, partial aggregation);
      2. one aggregate: rows below each bracket and rows inside it;
      3. the bracketed values are counted per distinct value (pre-aggregated, so a
         value that most rows share costs one row per task) and running sums of the
         counts (``running_counts``) find the two order statistics around each q.
    If a bracket misses (the sketch's error bound exceeded) that column's values are
    counted whole, still distributed.
    """
    specs = list(dict.fromkeys(specs))
    cols = list(dict.fromkeys(c for c, _ in specs))
    x = {c: F.col(c).cast("double") for c in cols}
    ok = {c: x[c].isNotNull() & ~F.isnan(x[c]) for c in cols}
    eps = 2.0 / accuracy
    bq = {sp: (max(0.0, sp[1] - eps), min(1.0, sp[1] + eps)) for sp in specs}
    aggs = [F.count_if(ok[c]).alias(f"n{i}") for i, c in enumerate(cols)]
    aggs += [F.min(F.when(ok[c], x[c])).alias(f"mn{i}") for i, c in enumerate(cols)]
    aggs += [F.max(F.when(ok[c], x[c])).alias(f"mx{i}") for i, c in enumerate(cols)]
    # one sketch per column, asked for every bracket edge of that column
    edges = {c: sorted({e for sp in specs if sp[0] == c for e in bq[sp]}) for c in cols}
    for i, c in enumerate(cols):
        aggs.append(F.percentile_approx(F.when(ok[c], x[c]), edges[c], accuracy).alias(f"b{i}"))
    st = df.agg(*aggs).first()
    n = {c: st[f"n{i}"] for i, c in enumerate(cols)}
    lohi = {}
    for sp in specs:
        c = sp[0]
        got_edges = dict(zip(edges[c], st[f"b{cols.index(c)}"] or [None] * len(edges[c])))
        lo = None if bq[sp][0] == 0.0 else got_edges[bq[sp][0]]
        hi = None if bq[sp][1] == 1.0 else got_edges[bq[sp][1]]
        lohi[sp] = (lo, hi)

    def inside(sp):
        c = sp[0]
        lo, hi = lohi[sp]
        cond = ok[c]
        if lo is not None:
            cond = cond & (x[c] >= F.lit(lo))
        if hi is not None:
            cond = cond & (x[c] <= F.lit(hi))
        return cond

    aggs2 = []
    for j, sp in enumerate(specs):
        lo = lohi[sp][0]
        below = F.count_if(ok[sp[0]] & (x[sp[0]] < F.lit(lo))) if lo is not None else F.lit(0)
        aggs2 += [below.alias(f"u{j}"), F.count_if(inside(sp)).alias(f"w{j}")]
    st2 = df.agg(*aggs2).first()
    want = {}
    bands = []
    out: dict[tuple[str, float], float | None] = {sp: None for sp in specs}
    for j, sp in enumerate(specs):
        c, q = sp
        if not n[c]:
            continue
        if q in (0.0, 1.0):  # the extremes are exact aggregates
            out[sp] = st[f"{'mn' if q == 0.0 else 'mx'}{cols.index(c)}"]
            continue
        pos = q * (n[c] - 1)
        r1, r2 = int(pos // 1), int(-(-pos // 1))
        below, width = st2[f"u{j}"], st2[f"w{j}"]
        cond, base, size = inside(sp), below, width
        if not (below <= r1 and r2 < below + width):
            cond, base, size = ok[c], 0, n[c]
        want[j] = (pos, r1, r2, base, size)
        bands.append(F.when(cond, F.struct(F.lit(j).alias("_spec"), x[c].alias("_v"))))
    if not bands:
        return out
    # every band from a single scan: each row contributes to the brackets it falls in
    band = (df.select(F.explode(F.array(*bands)).alias("_b"))
              .filter(F.col("_b").isNotNull()).select("_b._spec", "_b._v"))
    counts = band.groupBy("_spec", "_v").agg(F.count(F.lit(1)).alias("_c"))
    cum, first = 0, {}
    for j in sorted(want):  # bands follow one another in _spec order
        first[j] = cum
        cum += want[j][4]
    wanted = [F.when((F.col("_spec") == j) & (F.col("_before") <= at) & (F.lit(at) < F.col("_before") + F.col("_c")), r)
              for j, (pos, r1, r2, base, _) in want.items()
              for r, at in {(r, first[j] + r - base) for r in (r1, r2)}]
    picks = running_counts(counts, ["_spec", "_v"]).select(
        "_spec", "_v", F.explode(F.array_compact(F.array(*[w.cast("long") for w in wanted]))).alias("_r"))
    got = {(p["_spec"], p["_r"]): p["_v"] for p in picks.collect()}   # two values per percentile
    for j, (pos, r1, r2, base, _) in want.items():
        v1, v2 = got[(j, r1)], got[(j, r2)]
        out[specs[j]] = v1 + (v2 - v1) * (pos - r1)
    return out


def exact_percentile(df: DataFrame, col: str, q: float, accuracy: int = 10000) -> float | None:
    return exact_percentiles(df, [(col, q)], accuracy)[(col, q)]


DIGITS = 64             # buckets of a power of two: a bucket is about one per cent wide


def value_bucket(x: Column) -> Column:
    """The leading digits of a number, in its order: equal numbers share a bucket, and a
    greater number never has a smaller one."""
    size = F.floor(F.least(F.log2(F.abs(x) + F.lit(1.0)), F.lit(2000.0)) * F.lit(float(DIGITS)))
    return F.when(x < 0, -size).otherwise(size)


def grouped_percentile(df: DataFrame, keys: Sequence[str], col: str, q: float, out_col: str = "percentile",
                       sums: dict[str, Column] | None = None) -> DataFrame:
    """Exact linear-interpolated percentile of ``col`` per group by radix selection: no
    group's values are gathered in one task (a group may hold a large share of the rows).

    Values are counted per (group, leading digits), a map-side combined aggregate; running
    counts over a group's few buckets name those that hold the wanted order statistics. Only
    values of these buckets are counted one by one, which costs one row per distinct value.
    ``sums`` (name -> aggregate ``sum`` or ``count``) are added up in the first pass. The
    buckets named, one row per group, are written, so that their size decides the join.
    Returns one row per group: keys, ``out_col`` (null without a number), sums.
    """
    keys, sums = list(keys), dict(sums or {})
    x = F.col(col).cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    rows = df.withColumn("_v", F.when(ok, x)).withColumn("_b", value_bucket(F.col("_v")))
    counts = rows.groupBy(*keys, "_b").agg(F.count("_v").alias("_c"), *[c.alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*keys)
    before = group.orderBy(F.col("_b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    pos = F.lit(q) * (F.col("_n") - 1)
    placed = (counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
              .withColumn("_n", F.sum("_c").over(group)).withColumn("_qpos", pos))
    holds = (F.col("_before") <= F.ceil("_qpos")) & (F.floor("_qpos") < F.col("_before") + F.col("_c")) & F.col("_b").isNotNull()
    named = cut_lineage(placed.groupBy(*keys).agg(
        F.min(F.when(holds, F.col("_b"))).alias("_lo"), F.max(F.when(holds, F.col("_b"))).alias("_hi"),
        F.min(F.when(holds, F.col("_before"))).alias("_base"), F.first("_qpos").alias("_qpos"), *[F.sum(n).alias(n) for n in sums]))
    # keys joined null-safely: a null key is a group like others
    side = named.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_lo", "_hi", "_base", "_qpos")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = rows.select(*keys, "_v", "_b").filter("_b IS NOT NULL").join(side, same).filter("_b BETWEEN _lo AND _hi")
    values = near.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"), F.first("_base").alias("_base"), F.first("_qpos").alias("_qpos"))
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    at = values.withColumn("_k", F.col("_base") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("_k") <= rank) & (rank < F.col("_k") + F.col("_c")), F.col("_v")))

    low, part = F.floor("_qpos"), F.first("_qpos") - F.floor(F.first("_qpos"))
    picks = at.groupBy(*keys).agg(value(low).alias("_v1"), value(F.ceil("_qpos")).alias("_v2"), part.alias("_part"))
    picks = picks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         (F.col("_v1") + (F.col("_v2") - F.col("_v1")) * F.col("_part")).alias(out_col))
    return named.join(picks, same, "left").select(*keys, out_col, *sums)
