"""Global ranks, positions and quantiles without a single-task sort.

A window over a whole table puts all rows in one task. Here rows are range-partitioned, numbered or summed inside each
partition, and each partition's start is the sum of the partitions before it: a table of one row a partition. Range
borders are sampled when a plan runs, so two runs of one plan may deal rows differently; the dealt rows are therefore
materialised once (``keep``) before anything is derived from them twice.

Ranks of ties depend only on how many rows have smaller values, so only the distinct values are ranked: a value that a
third of all rows hold is one row here.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.storage import keep

_ROW_BITS = 33


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the place 1..N of every row in a total order (``order`` must tell any two rows apart)."""
    # In range-partitioned, sorted rows this id grows with the order: the partition above, the row in it below.
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    numbered = keep(numbered)
    part = F.shiftright("__id", _ROW_BITS).alias("__part")
    sizes = numbered.groupBy(part).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    start = sizes.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__start"))
    own = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return numbered.withColumn("__part", part).join(F.broadcast(start), "__part").withColumn(name, F.col("__start") + own).drop("__part", "__id", "__start")


def running(counts: DataFrame, order: list[str], totals: list[str]) -> DataFrame:
    """Add ``before_<t>`` to rows with distinct ``order``: the sum of t over all rows before."""
    dealt = keep(counts.repartitionByRange(*map(F.col, order)).withColumn("__part", F.spark_partition_id()))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = dealt.groupBy("__part").agg(*[F.sum(t).alias(t) for t in totals])
    start = sums.select("__part", *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"__start_{t}") for t in totals])
    own = dealt.select("*", *[F.coalesce(F.sum(t).over(within), F.lit(0)).alias(f"__own_{t}") for t in totals])
    return own.join(F.broadcast(start), "__part").select(*counts.columns, *[(F.col(f"__start_{t}") + F.col(f"__own_{t}")).alias(f"before_{t}") for t in totals])


def value_ranks(df: DataFrame, value: str, **sums: Column) -> DataFrame:
    """Distinct non-null values with ``ties`` (rows with this one) and ``before`` (rows with a smaller one).

    For every further sum: its total over the rows with the value, and ``before_<name>`` over those with smaller ones.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("ties"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return running(counts, [value], ["ties", *sums]).withColumnRenamed("before_ties", "before")


def column_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, ties, before and n (rows with a value) for the distinct values of several columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("ties"))
    ranked = keep(running(counts, ["column", "value"], ["ties"]))
    of_column = ranked.groupBy("column").agg(F.sum("ties").alias("n"), F.min("before_ties").alias("__first"))  # a row a column
    return ranked.join(F.broadcast(of_column), "column").select("column", "value", "ties", (F.col("before_ties") - F.col("__first")).alias("before"), "n")


def _share(ranks: DataFrame) -> Column:
    return (ranks["before"] + (ranks["ties"] + 1) / 2.0) / ranks["n"]


def with_rank_shares(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add, per column, the average-tie rank of its value divided by the number of rows that have one; null for null."""
    ranks = column_ranks(df, list(names))
    for column, name in names.items():
        own = ranks.where(F.col("column") == column).select(F.col("value").alias("__value"), _share(ranks).alias(name))
        df = df.join(own, df[column].cast("double") == F.col("__value"), "left").drop("__value")
    return df


def with_rank_share(df: DataFrame, value: str, name: str) -> DataFrame:
    return with_rank_shares(df, {value: name})


def column_quantiles(df: DataFrame, columns: list[str], levels: list[float]) -> DataFrame:
    """column, n (its values), quantiles (one a level, between neighbours by straight lines); no row without values."""
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    marks = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(place(q)).alias("low"), F.ceil(place(q)).alias("high"), (place(q) - F.floor(place(q))).alias("part")) for i, q in enumerate(levels)])
    inside = lambda at: (at >= F.col("before")) & (at < F.col("before") + F.col("ties"))
    met = column_ranks(df, columns).select("column", "value", "n", F.explode(F.filter(marks, lambda m: (m["low"] < F.col("before") + F.col("ties")) & (m["high"] >= F.col("before")))).alias("m"), "before", "ties")
    parts = met.groupBy("column", "m.i").agg(F.max(F.when(inside(F.col("m.low")), F.col("value"))).alias("low"), F.max(F.when(inside(F.col("m.high")), F.col("value"))).alias("high"), F.max("m.part").alias("part"), F.max("n").alias("n"))
    value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
    in_order = F.sort_array(F.collect_list(F.struct("i", value.alias("v"))))  # a row a level
    return parts.groupBy("column").agg(in_order.alias("q"), F.max("n").alias("n")).select("column", "n", F.col("q.v").alias("quantiles"))


def quantiles_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row: per name the quantile (column, level) of a column; null where the column has no values."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    levels = list(dict.fromkeys(q for _, q in wanted.values()))
    found = column_quantiles(df, columns, levels)
    pick = lambda c, q: F.max(F.when(F.col("column") == c, F.get("quantiles", F.lit(levels.index(q)))))
    return found.agg(*[pick(c, q).alias(name) for name, (c, q) in wanted.items()])


def medians(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, float | None]]:
    """The number of rows, and the exact median of every column (null without values); ``df`` is read twice and not shuffled.

    The first pass brackets each median between two approximate quantiles, the second counts the values below the bracket and
    those in it by value: where values differ these are some thousandths of the rows. If a bracket misses, all values are ranked.
    """
    width, accuracy = 0.001, 5000
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))) for c in columns}  # as in an order, NaN comes last
    bracket = lambda c: F.percentile_approx(value[c], [0.5 - width, 0.5 + width], accuracy).alias(c)
    row = df.agg(F.count("*").alias("__rows"), *[bracket(c) for c in columns]).first()
    found: dict[str, float | None] = {c: None for c in columns}
    ends = {c: row[c] for c in columns if row[c]}
    if not ends:
        return row["__rows"], found
    low, inside = F.lit(-math.inf), lambda c: (value[c] >= ends[c][0]) & (value[c] <= ends[c][1])
    marks = [F.struct(F.lit(c).alias("column"), F.when(inside(c), value[c]).when(value[c] < ends[c][0], low).otherwise(F.lit(None)).alias("value"), F.col(c).isNotNull().alias("known")) for c in ends]
    counts = df.select(F.explode(F.array(*marks)).alias("m")).select("m.*").where("known").groupBy("column", "value").agg(F.count("*").alias("ties"))
    place = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())  # the values in a bracket
    placed = counts.select("column", "value", F.sum("ties").over(place).alias("upto"), "ties", F.sum("ties").over(Window.partitionBy("column")).alias("n"))
    at = lambda x: F.max(F.when((x >= F.col("upto") - F.col("ties")) & (x < F.col("upto")), F.col("value")))
    middle = placed.groupBy("column").agg(at(F.floor((F.col("n") - 1) / 2)).alias("low"), at(F.ceil((F.col("n") - 1) / 2)).alias("high"))
    for r in middle.collect():
        if r["low"] is None or r["high"] is None or math.isinf(r["low"]) or math.isinf(r["high"]):
            missed = column_quantiles(df, [r["column"]], [0.5]).first()
            found[r["column"]] = missed["quantiles"][0] if missed else None
        else:
            found[r["column"]] = r["low"] + (r["high"] - r["low"]) * 0.5
    return row["__rows"], found


def numbered_within(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """Add the place 1..n of every row within its group (few groups, of any size) in a total order."""
    placed = with_position(df, [F.col(group), *order], "__place")
    sizes = df.groupBy(group).agg(F.count("*").alias("__size"))
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    start = sizes.select(F.col(group).alias("__group"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(start), F.col(group).eqNullSafe(F.col("__group"))).withColumn(name, F.col("__place") - F.col("__before")).drop("__place", "__group", "__before")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
