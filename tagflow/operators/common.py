"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_state, state_path
from ..session import materialize

#: Shares of the rows whose border values the first pass of ``first_rows`` estimates, and the accuracy of its sketch.
SHARES = [1.2 ** -k for k in range(100, 0, -1)]
ACCURACY = 10_000


def row_count(df: DataFrame) -> Column:
    """Number of rows as a lazy scalar subquery (no cross join, no driver round trip)."""
    return df.select(F.count(F.lit(1))).scalar()


def non_empty(df: DataFrame) -> Column:
    """True when df has a row, as a lazy EXISTS subquery."""
    return df.exists()


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with name = 0, 1, ... in the given order, ranked in parallel.

    Rows are range-partitioned and sorted, numbered inside their partition, and moved up by the
    counts of the partitions before (a row for each partition).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id()
    placed = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                         .withColumn("_at", inside.bitwiseAND(F.lit((1 << 33) - 1))).withColumn("_part", F.spark_partition_id()),
                         "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (placed.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_at"))
            .drop("_part", "_at", "_base"))


def first_rows(df: DataFrame, lead: Column, order: list[Column], n: int, name: str) -> tuple[DataFrame, int]:
    """(the first n rows of df in an order, with name = 0, 1, ..., the rows of df). lead: a number that rises along the order.

    By threshold: one pass counts the rows and sketches where shares of them end; rows up to the border that
    surely holds n are written, and only they are ranked, in parallel. A border that holds too few after
    all (they are counted) gives way to the next. Nulls of lead stand last, equal values are ranked by the whole order.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_lead", lead.cast("double"))
    total, known, borders = keyed.agg(F.count(F.lit(1)), F.count("_lead"), F.percentile_approx("_lead", SHARES, ACCURACY)).collect()[0]
    least = n + 2 * known // ACCURACY
    tries = [b for share, b in zip(SHARES, borders or []) if share * known >= least] if n < known else []
    while True:
        cut = tries.pop(0) if tries else None
        path = state_path(spark, "first-rows")
        (keyed if cut is None else keyed.where(F.col("_lead") <= cut)).drop("_lead").write.parquet(path)
        some = spark.read.parquet(path)
        if cut is None or some.count() >= n:
            break
        drop_state(spark, path)
    return numbered(some, order, name).where(F.col(name) < n), total
