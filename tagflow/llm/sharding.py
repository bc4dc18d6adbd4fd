"""Sharding by a Feistel permutation of global row numbers (DataFrame functions only).

Every row gets a global row number, the permutation maps it to a position, and the position gives
the shard (position mod shards) and the slot in it (position div shards). Counts differ by one at
most, slots have no gaps, and anyone who knows a row number and the total can compute its place.

Row numbers need no global sort: rows are bucketed by a hash, numbered within their bucket, and the
buckets' bases are prefix sums over one row for each bucket. Rows that are alike in id, size and
checksum are counted before the shuffle, so a group of repeated rows never meets in one task.

The permutation works on the smallest grid a x b that holds all N rows (a about the root of N), with
rounds that alternate between both coordinates. Positions from N to a*b - 1 are walked on until they
fall below N; there are fewer than a of them, which bounds every walk.

Defined cases: a null text has no bytes (size 1, checksum 0); a null id is a value like any other;
repeated rows get a place each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, pick

#: Buckets of the numbering; also the row bound of the broadcast table of bases.
BUCKETS = 4096
#: Copies of one row that are written out from one array.
CHUNK = 65_536


def permuted(x: Column, a: Column, b: Column, seed: int, rounds: int) -> Column:
    """The Feistel permutation of x in 0 .. a*b-1; rounds is even."""
    def turn(state: Column, i: Column) -> Column:
        radix = F.when(i % 2 == 0, a).otherwise(b)
        return F.struct(state["v"].alias("u"),
                        F.pmod(state["u"] + F.pmod(F.xxhash64(F.lit(seed), i, state["v"]), radix), radix).alias("v"))

    start = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("u"), F.pmod(x, b).alias("v"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), start, turn,
                       lambda s: s["u"] * b + s["v"])


def numbered(rows: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """rows (keys and nothing else) with row_no (0 .. N-1, in an order that only the keys decide) and total (N)."""
    counted = (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
               .withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.groupBy("bucket").agg(F.sum("copies").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(W.partitionBy(F.lit(0))).alias("total"))
    inside = W.partitionBy("bucket").orderBy(*[F.col(k).asc_nulls_first() for k in keys]).rowsBetween(
        W.unboundedPreceding, -1)
    placed = (counted.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
              .join(F.broadcast(bases), "bucket"))  # at most one row for each bucket
    chunks = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / CHUNK))))
    first = F.col("chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("copies")) - 1
    each = chunks.withColumn("copy", F.explode(F.sequence(first, last)))
    return each.select(*keys, (F.col("base") + F.col("inside") + F.col("copy")).alias("row_no"), "total")


def feistel_shards(docs: DataFrame, shards: int = 16, seed: int = 20_240_611, rounds: int = 8,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, row_no, position, shard, slot."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    grid = (numbered(rows, ["doc_id", "size", "text_crc32"])
            .withColumn("a", F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long"))
            .withColumn("b", F.expr("(total + a - 1) div a")))
    a, b, total = F.col("a"), F.col("b"), F.col("total")
    once = grid.withColumn("position", permuted(F.col("row_no"), a, b, seed, rounds))
    walk = F.aggregate(F.sequence(F.expr("1L"), a * b - total), F.col("position"),
                       lambda x, _: F.when(x < total, x).otherwise(permuted(x, a, b, seed, rounds)))
    done = once.withColumn("position", F.when(F.col("position") < total, F.col("position")).otherwise(walk))
    return done.select("doc_id", "size", "text_crc32", "row_no", "position",
                       F.pmod(F.col("position"), F.lit(shards)).cast("int").alias("shard"),
                       F.expr(f"position div {int(shards)}").alias("slot"))


def op10_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law of equal row counts."""
    placed = feistel_shards(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "row_no", "position")


QUERIES = {"op10_feistel_shards": op10_feistel_shards}
ORACLE_SQL: dict[str, str] = {}
