"""Mixing sources to target weights over a tree of levels (domain, language, source).

The token budget goes down the tree. At every node the children share their parent's
budget by weight; a child that cannot use its share (its subtree holds fewer tokens,
times the allowed epochs) is filled up, and what it leaves goes to its siblings by
weight. So a shortage is met by siblings first; only what a whole subtree cannot use
returns to the siblings of its ancestor. A leaf then takes its documents in seeded
order, epoch by epoch (each epoch has its own order): whole epochs first, and in the
last one the longest prefix whose tokens fit.

Documents are ordered by md5 of seed, epoch and key. The prefix sums are made over
range partitions of (leaf, order), so a leaf that holds a third of the corpus is spread
over as many tasks.

Defined cases: null level values are a value of their own; a weight that is not listed
is 1, one of 0 or less excludes the child; null text has no tokens; documents without
tokens are taken where the prefix reaches them; rows of one key and text are taken or
left together; null keys are ordered as the text ``null``; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.llm.common import cut_lineage, partitions


def n_words(text: Column) -> Column:
    """Tokens of a text: runs without blank, tab or line break."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\r\n]+")).cast("long")


def _weight(name: str, weights: Mapping[str, float]) -> Column:
    w = F.lit(1.0)
    for value, x in weights.items():
        w = F.when(F.col(name) == value, F.lit(float(x))).otherwise(w)
    return F.greatest(w, F.lit(0.0))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]],
                 budget: Column, epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with the whole tokens each may take (``budget``)."""
    tree = leaves.withColumn("b", F.lit(0.0)).withColumn("cap", F.col("tokens").cast("double") * epochs)
    # a child with weight 0 takes nothing, and neither does all below it
    for name, w in zip(levels, weights):
        tree = tree.withColumn("cap", F.when(_weight(name, w) > 0, F.col("cap")).otherwise(0.0))
    parent_budget = None
    for depth, name in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("c"))
        nodes = nodes.withColumn("w", _weight(name, weights[depth]))
        if parent_budget is None:
            nodes = nodes.withColumn("top", budget.cast("double"))
            siblings: list = [F.lit(1)]
        else:
            on = [nodes[c].eqNullSafe(parent_budget["_" + c]) for c in levels[:depth]]
            nodes = nodes.join(parent_budget, on).drop(*["_" + c for c in levels[:depth]])
            siblings = [F.col(c) for c in levels[:depth]]
        live = nodes.filter((F.col("w") > 0) & (F.col("c") > 0)).withColumn("r", F.col("c") / F.col("w"))
        order = Window.partitionBy(*siblings).orderBy("r", name)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        # the share per weight if all smaller children are filled up
        live = live.withColumn("lam", (F.col("top") - F.coalesce(F.sum("c").over(before), F.lit(0.0)))
                               / F.sum("w").over(rest))
        full = F.col("r") <= F.col("lam")
        level = F.max(F.when(~full, F.col("lam"))).over(Window.partitionBy(*siblings))
        live = live.withColumn("top", F.when(full, F.col("c")).otherwise(F.greatest(F.lit(0.0), level * F.col("w"))))
        parent_budget = live.select(*[F.col(c).alias("_" + c) for c in path], "top")
    on = [leaves[c].eqNullSafe(parent_budget["_" + c]) for c in levels]
    return leaves.join(parent_budget, on).select(
        *[leaves[c] for c in leaves.columns], F.floor(F.round("top", 3)).cast("long").alias("budget"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Sequence[Mapping[str, float]], fraction: float,
        epochs: int = 2, seed: int = 17, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents taken for a budget of ``fraction`` times the corpus tokens.

    Returns doc_id, the levels, n_tokens, h (text hash), and times (how often the
    document is taken, at least once)."""
    names = list(levels)
    rows = docs.withColumn("n_tokens", n_words(F.col(text))).select(
        F.col(key).alias("doc_id"), *[c.alias(n) for n, c in levels.items()], "n_tokens",
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    units = cut_lineage(rows.groupBy("doc_id", "h", *names, "n_tokens").agg(F.count(F.lit(1)).alias("copies"))
                        .withColumn("tokens", F.col("n_tokens") * F.col("copies")))
    leaves = cut_lineage(units.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = cut_lineage(leaf_budgets(leaves, names, weights, F.lit(float(int(total * fraction))), epochs)
                       .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")))
                                   .otherwise(F.lit(0)).cast("long"))
                       .withColumn("left", F.col("budget") - F.col("whole") * F.col("tokens")).drop("tokens"))
    on = [units[c].eqNullSafe(plan[c]) for c in names]
    placed = units.join(plan, on).select(*[units[c] for c in units.columns], plan["whole"], plan["left"])
    # a seeded order of its own for the epoch that is taken in part
    placed = placed.withColumn("pick", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("whole").cast("string"),
                                                         F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    order = [*[F.col(c) for c in names], F.col("pick"), F.col("h")]
    placed = cut_lineage(placed.repartitionByRange(partitions(docs.sparkSession), *order)
                         .withColumn("pid", F.spark_partition_id()))
    parts = placed.groupBy("pid", *names).agg(F.sum("tokens").alias("in_part"))
    before = Window.partitionBy(*names).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("pid").alias("_pid"), *[F.col(c).alias("_" + c) for c in names],
                         F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pid", *names).orderBy("pick", "h").rowsBetween(Window.unboundedPreceding, 0)
    run = placed.withColumn("upto", F.sum("tokens").over(inside))
    on = [run["pid"] == parts["_pid"], *[run[c].eqNullSafe(parts["_" + c]) for c in names]]
    last = (F.col("base") + F.col("upto") <= F.col("left")) & (F.col("whole") < epochs)
    return (run.join(parts, on).withColumn("times", F.col("whole") + last.cast("long")).filter("times > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("doc_id", *names, "n_tokens", "h", "times"))
