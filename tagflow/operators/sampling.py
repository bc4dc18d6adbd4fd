"""Active-post sampling: score per hour, top-N, several sizes, random-N."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import parse_created_lenient, per_hour, whole_hours_since
from .common import first_rows


def with_score_per_hour(active: DataFrame, ts_col: str = "created_datetime") -> DataFrame:
    """Parse created_at (leniently: null where it can't), whole hours since the earliest post (+1), score / hours.

    The origin is the true global minimum, taken as a scalar subquery (trap 5).
    """
    df = active.withColumn(ts_col, parse_created_lenient("created_at"))
    origin = df.select(F.min(ts_col)).scalar()
    return (df.withColumn("hours_since_start", whole_hours_since(ts_col, origin))
              .withColumn("score_per_hour", per_hour("score", "hours_since_start")))


def rank_order() -> list[Column]:
    """Total order of the top-N: score_per_hour desc, then id asc (fixes trap 6 ties)."""
    return [F.col("score_per_hour").desc(), F.col("id").asc()]


def top_n(scored: DataFrame, n: int) -> DataFrame:
    """K1/K2: exact top n, by threshold: neither n rows of every split in one reducer nor a sort of all rows."""
    return top_ranked(scored, n).drop("rank")


def top_ranked(scored: DataFrame, n: int) -> DataFrame:
    """K1/K2 with rank (from 1, long)."""
    return first_rows(scored, -F.col("score_per_hour"), rank_order(), n, "rank")[0].withColumn("rank", F.col("rank") + 1)


def sample_label(n: Column, method: str = "top") -> Column:
    """1,000,000 -> top1m, 500,000 -> top500k; a size that isn't whole thousands is written out."""
    return (F.when(n % 1_000_000 == 0, F.format_string(method + "%dm", F.floor(n / 1_000_000).cast("bigint")))
             .when(n % 1000 == 0, F.format_string(method + "%dk", F.floor(n / 1000).cast("bigint")))
             .otherwise(F.format_string(method + "%d", n)))


def ranked_sizes(df: DataFrame, lead: Column, order: list[Column], sizes: Iterable[int], method: str) -> DataFrame:
    """The first rows of df in an order, once for each size: rank, sample_size, sample_label. lead: as in first_rows.

    Rows are ranked once, in parallel, and only as far as the largest size that df can fill: a size above the
    rows there are is skipped, as in the studied project.
    """
    total = df.count()
    wanted = sorted({int(x) for x in sizes if int(x) <= total})
    ranked, _ = first_rows(df, lead, order, max(wanted, default=0), "rank")
    size_col = F.explode(F.array(*[F.lit(s).cast("bigint") for s in wanted]).cast("array<bigint>")).alias("sample_size")
    out = ranked.withColumn("rank", F.col("rank") + 1).select("*", size_col).where(F.col("rank") <= F.col("sample_size"))
    return out.withColumn("sample_label", sample_label(F.col("sample_size"), method))


def top_n_sizes(scored: DataFrame, sizes: Iterable[int]) -> DataFrame:
    """K6: the best by score per hour, for several sizes."""
    return ranked_sizes(scored, -F.col("score_per_hour"), rank_order(), sizes, "top")


def rebased_sample(sample: DataFrame) -> DataFrame:
    """Trap 4: the stored sample re-bases hours on the sample's own minimum.

    Keeps the ranking value as rank_score_per_hour next to the re-based score_per_hour.
    """
    origin = sample.select(F.min("created_datetime")).scalar()
    return (sample.withColumnRenamed("score_per_hour", "rank_score_per_hour")
                  .withColumn("hours_since_start", whole_hours_since("created_datetime", origin))
                  .withColumn("score_per_hour", per_hour("score", "hours_since_start")))


def random_order(id_col: str = "id", seed: int = 42) -> list[Column]:
    """A random order of ids that depends on seed and id alone (not on partitions): by MD5 of both."""
    return [_md5(id_col, seed), F.col(id_col)]


def _md5(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(id_col).cast("string")).cast("binary"))


def random_lead(id_col: str = "id", seed: int = 42) -> Column:
    """The first 52 bits of the random order, as a number."""
    return F.conv(F.substring(_md5(id_col, seed), 1, 13), 16, 10).cast("double")


def random_n(active: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """K5: n rows without replacement (all rows when n >= size), exact and layout-stable."""
    return first_rows(active, random_lead("id", seed), random_order("id", seed), n, "rank")[0].drop("rank")
