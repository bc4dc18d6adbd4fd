"""Cycles among parent links, by pointer doubling.

Each node has one parent at most, so following parents for as many steps as there are nodes ends at a root
or on a cycle, and every node of a cycle is where some walk ends. Doubling makes those steps in a
logarithmic number of joins; walks that have reached a root drop out, so links without a cycle end early.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_state, state_path


def find_cycles(links: DataFrame, child_col: str = "name", parent_col: str = "parent") -> DataFrame:
    """(cycle, node, parent, length): the nodes of every cycle; cycle is its smallest node. A link to itself is a cycle of 1.

    A node with several parents goes by the smallest; null children and parents are no links."""
    spark = links.sparkSession
    old: str | None = None

    def put(df: DataFrame) -> DataFrame:
        nonlocal old
        path = state_path(spark, "walks")
        df.write.parquet(path)
        if old is not None:
            drop_state(spark, old)
        old = path
        return spark.read.parquet(path)

    base = links.select(F.col(child_col).alias("node"), F.col(parent_col).alias("parent"))
    path = state_path(spark, "parents")
    base.where("node IS NOT NULL AND parent IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent")).write.parquet(path)
    parents = spark.read.parquet(path)
    steps, n = 1, parents.count()
    walk = put(parents.select("node", F.col("parent").alias("at"), F.least("node", "parent").alias("low")))
    while steps < n and not walk.isEmpty():
        further = walk.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("low").alias("low2"))
        walk = put(walk.join(further, "at").select("node", F.col("to").alias("at"), F.least("low", "low2").alias("low")))
        steps *= 2
    on_cycle = walk.select(F.col("at").alias("node")).distinct()
    found = walk.join(on_cycle, "node", "left_semi").select("node", F.col("low").alias("cycle")).join(parents, "node")
    sizes = found.groupBy("cycle").agg(F.count(F.lit(1)).alias("length"))
    return found.join(sizes, "cycle").select("cycle", "node", "parent", "length")
