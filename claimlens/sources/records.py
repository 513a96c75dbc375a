"""CSV records of splittable text files, also where quoted cells hold line breaks.

A line break ends a record unless it lies inside a quoted cell, and whether it does depends
on everything before it in the file. Each line is therefore a function on two states, outside
and inside of a quoted cell: it leaves the state as it is, swaps it, or sets it (a line that
holds a whole quoted cell, or a stray quote, sets it). Such functions are composed per split
from both states at once, and a prefix over the few splits of a file picks the state each
split starts in: the file stays splittable, however long it is.

Only lines of records with breaks are gathered, by record. Lines of files without any such
record are records as they are and are not shuffled.

Defined cases: a quoted cell that the file never closes is no quoted cell, and its lines are
records of their own; a quote that does not open a cell is text; ``""`` inside a quoted cell
is a quote; a break inside a cell becomes ``\\n``; blank lines outside of cells are no records.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_QUOTED = re.compile(r'"[^"]*+(?:""[^"]*+)*+"')
_CLOSING = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
KEEPS, SWAPS, OUTSIDE, INSIDE = 0, 1, 2, 3       # what a line does to the state


def line_effect(line: str, sep: str = ",") -> int:
    """The function of one line on the two states."""
    def end(pos: int, at_start: bool) -> int:
        """1 if the line ends inside a quoted cell, read from ``pos`` outside of one."""
        while True:
            if at_start and line.startswith('"', pos):
                m = _QUOTED.match(line, pos)
                if not m:
                    return 1
                pos = m.end()
            pos = line.find(sep, pos)
            if pos < 0:
                return 0
            pos, at_start = pos + len(sep), True

    from_out = end(0, True)
    close = _CLOSING.match(line)
    from_in = end(close.end(), False) if close else 1
    return {(0, 1): KEEPS, (1, 0): SWAPS, (0, 0): OUTSIDE, (1, 1): INSIDE}[from_out, from_in]


def _effect(sep: str):
    @F.pandas_udf(T.IntegerType())
    def run(lines: pd.Series) -> pd.Series:
        return pd.Series([KEEPS if s is None else line_effect(s, sep) for s in lines], dtype="int32")

    return run


def text_lines(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> DataFrame:
    """(file_path, block, i, value, effect): the lines of all files; ``i`` rises within a block."""
    rows = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("i"), "value")
    # only lines with a quote go through Python, as text that is valid in any encoding
    shown = F.when(F.contains("value", F.lit('"')), F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return rows.withColumn("effect", _effect(sep)(shown))


def file_table(lines: DataFrame) -> DataFrame:
    """Per file: place of its first line that is not blank, whether all lines are UTF-8, and
    whether some line opens a cell that it does not close."""
    blank = F.length(F.trim("value")) == 0
    at = F.struct("block", "i")
    return lines.groupBy("file_path").agg(
        F.min(F.when(~blank, at)).alias("first"), F.min_by("value", F.when(~blank, at)).alias("head"),
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.col("effect").isin(SWAPS, INSIDE)).alias("breaks"))


def _state_before(rows: DataFrame, group: list[str], order: list[str], start) -> DataFrame:
    """``rows`` (with ``effect``) and the state (0 or 1) before each, from state ``start``."""
    earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("effect") == SWAPS).cast("int")).over(earlier), F.lit(0))
    rows = rows.withColumn("__s", swaps)
    sets = F.when(F.col("effect") >= OUTSIDE, F.struct((F.col("effect") - OUTSIDE).alias("v"), F.col("__s").alias("s")))
    rows = rows.withColumn("__r", F.last(sets, ignorenulls=True).over(earlier))
    since = F.when(F.col("__r").isNotNull(), F.col("__r.v") + F.col("__s") - F.col("__r.s")).otherwise(start + F.col("__s"))
    return rows.withColumn("state", F.pmod(since, F.lit(2))).drop("__s", "__r")


def _composed(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """The function of all rows of a key together, as one ``effect``."""
    last = F.max(F.when(F.col("effect") >= OUTSIDE, F.struct(order.alias("o"), (F.col("effect") - OUTSIDE).alias("v"))))
    sets = rows.groupBy(*keys).agg(last.alias("__l"))
    rows = rows.join(sets, keys) if keys else rows.crossJoin(sets)
    after = F.col("__l").isNull() | (order > F.col("__l.o"))
    swaps = F.sum(((F.col("effect") == SWAPS) & after).cast("int")) % 2
    value = F.first("__l.v")
    return rows.groupBy(*keys).agg(F.when(value.isNull(), swaps).otherwise(F.lit(OUTSIDE) + (value + swaps) % 2).cast("int").alias("effect"))


def joined_records(lines: DataFrame) -> DataFrame:
    """(file_path, block, i, value): the records of files with breaks inside of cells, at the
    place of their first line."""
    blocks = _composed(lines.select("file_path", "block", "i", "effect"), ["file_path", "block"], F.col("i"))
    starts = _state_before(blocks, ["file_path"], ["block"], F.lit(0)).select("file_path", "block", F.col("state").alias("start"))
    rows = lines.join(starts, ["file_path", "block"])
    rows = _state_before(rows, ["file_path", "block"], ["i"], F.col("start"))
    begins = F.when(F.col("state") == 0, F.struct("block", "i"))
    here = Window.partitionBy("file_path", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("record", F.last(begins, ignorenulls=True).over(here))
    # lines before the first record start of a block belong to the last one of an earlier block
    ends = rows.groupBy("file_path", "block").agg(F.max(begins).alias("last"))
    earlier = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file_path", "block", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    # a cell that the file never closes is none: its lines are records
    whole = _composed(blocks, ["file_path"], F.col("block"))
    open_ = (rows.groupBy("file_path").agg(F.max(begins).alias("open"))
             .join(whole.filter(F.col("effect").isin(SWAPS, INSIDE)).select("file_path"), "file_path"))
    rows = rows.join(ends, ["file_path", "block"]).join(open_, "file_path", "left")
    record = F.coalesce("record", "before")
    own = F.struct("block", "i")
    rows = rows.withColumn("record", F.when(F.col("open").isNotNull() & (record == F.col("open")), own).otherwise(record))
    # records of one line need no gathering
    following = Window.partitionBy("file_path", "block").orderBy("i")
    single = (F.col("record") == own) & F.coalesce(F.lead("record").over(following) == F.lead(own).over(following), F.lit(False))
    rows = rows.withColumn("single", single)
    parts = F.array_sort(F.collect_list(F.struct("block", "i", "value")))
    gathered = (rows.filter(~F.col("single")).groupBy("file_path", "record").agg(
        F.array_join(F.transform(parts, lambda p: F.coalesce(p["value"], F.lit(""))), "\n").alias("value"))
        .select("file_path", "record.block", "record.i", "value"))
    return rows.filter("single").select("file_path", "block", "i", "value").unionByName(gathered)


def records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file_path, block, i, value) of every record that is not blank, header records included."""
    broken = files.filter("breaks").select("file_path")
    plain = lines.join(files.filter("NOT breaks").select("file_path"), "file_path", "left_semi").select("file_path", "block", "i", "value")
    out = plain if broken.isEmpty() else plain.unionByName(joined_records(lines.join(broken, "file_path", "left_semi")))
    return out.filter(F.length(F.trim("value")) > 0)
