"""Connected components of a table of links by alternating star steps, with no component ever in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep_plan_short

MAX_ROUNDS = 60


def _stars(links: DataFrame, larger_only: bool) -> DataFrame:
    """Tie neighbours to the smallest id around their centre: (a, b) with b < a.

    The minimum per centre is pre-aggregated before its shuffle; the join back is an inner equi-join whose link side
    AQE may split, so a centre with very many links does not land in one task.
    """
    if larger_only:  # every centre with all its neighbours
        around = links.select(F.col("a").alias("centre"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a")))
    else:  # every centre with its smaller neighbours
        around = links.select(F.col("a").alias("centre"), F.col("b").alias("other"))
    least = around.groupBy("centre").agg(F.min("other").alias("least")).withColumn("least", F.least("least", "centre"))
    met = around.join(least, "centre")
    if larger_only:
        pairs = met.where(F.col("other") > F.col("centre")).select(F.col("other").alias("a"), F.col("least").alias("b"))
        # A centre that is itself no minimum stays tied to its own.
        pairs = pairs.union(least.where(F.col("least") < F.col("centre")).select(F.col("centre"), F.col("least")))
    else:
        pairs = met.select(F.col("other").alias("a"), F.col("least").alias("b")).union(least.select(F.col("centre"), F.col("least")))
    return pairs.where(F.col("b") < F.col("a")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: orderable ids, any order, repeats and self-links allowed) to (node, root), root the smallest id.

    Nodes without a link to another node do not appear. Null ids are left out.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    stars = keep_plan_short(links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(most.alias("a"), least.alias("b")).distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())
    before = print_of(stars)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        stars = keep_plan_short(_stars(_stars(stars, larger_only=True), larger_only=False))
        now = print_of(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b")).distinct())
