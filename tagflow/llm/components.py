"""Connected components of a graph of links, by alternating large and small stars.

Each round hangs a node's larger neighbours on its smallest one (large star), then the smaller ones
(small star); both keep the components and at most the number of links. Rounds go on until a round
changes nothing, which takes about the logarithm of a component's size. Links are state in the
shared checkpoint folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_state, state_path


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """links have a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"))
    hung = least.select(F.col("m").alias("x"), F.col("b").alias("y"))
    return (moved.unionByName(hung).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root): every linked node that isn't the smallest of its component, with that one."""
    spark = links.sparkSession

    def kept(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = state_path(spark, "links")
        df.write.parquet(path)
        back = spark.read.parquet(path)
        return path, back, tuple(back.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).collect()[0])

    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    path, now, mark = kept(ordered)
    while mark[0]:
        new_path, new, new_mark = kept(_small_star(_large_star(now)))
        drop_state(spark, path)
        path, now, same, mark = new_path, new, new_mark == mark, new_mark
        if same:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
