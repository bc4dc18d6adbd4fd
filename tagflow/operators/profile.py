"""Column profiles from sketches that are stored and merged.

Each part of a table (a month, a load) leaves one row of sketches for each column: a HyperLogLog sketch of
its distinct values and, for whole numbers, a KLL sketch of its quantiles, with counts. A profile of any set of
parts merges those rows and reads no table again.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of an HLL sketch (2^LG_K) and size of a KLL sketch.
LG_K, KLL_K = 12, 400
#: Bounds of the merged sketches: three standard errors of HLL, and the rank error of KLL at 99 % confidence.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
RANK_ERROR = 2.446 / KLL_K ** 0.9433 + 0.002


def sketched(df: DataFrame, part: Column, columns: Iterable[str], numbers: Iterable[str]) -> DataFrame:
    """part, column, rows, nulls, distinct (HLL), quantiles (KLL; null but for numbers): a row for each part and column."""
    aggs, numbers = [], set(numbers)
    for c in columns:
        aggs += [F.count(F.lit(1)).alias(f"{c}_rows"), F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls"),
                 F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LG_K)).alias(f"{c}_hll")]
        aggs += [F.kll_sketch_agg_bigint(F.col(c).cast("long"), F.lit(KLL_K)).alias(f"{c}_kll")] if c in numbers else []
    wide = df.groupBy(part.alias("part")).agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}_rows").alias("rows"), F.col(f"{c}_nulls").alias("nulls"),
                     F.col(f"{c}_hll").alias("distinct"),
                     (F.col(f"{c}_kll") if c in numbers else F.lit(None).cast("binary")).alias("quantiles")) for c in columns]
    return wide.select("part", F.explode(F.array(*rows)).alias("x")).select("part", "x.*")


def merged_profile(sketches: DataFrame, shares: Iterable[float] = (0.5, 0.9)) -> DataFrame:
    """column, rows, nulls, distinct (estimate), quantiles (estimates at shares, null but for numbers) over the parts there are."""
    both = sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                                          F.hll_union_agg("distinct").alias("hll"), F.kll_merge_agg_bigint("quantiles").alias("kll"))
    marks = F.array(*[F.kll_sketch_get_quantile_bigint("kll", F.lit(float(s))) for s in shares])
    some = F.coalesce(F.kll_sketch_get_n_bigint("kll") > 0, F.lit(False))
    return both.select("column", "rows", "nulls", F.hll_sketch_estimate("hll").alias("distinct"), F.when(some, marks).alias("quantiles"))
