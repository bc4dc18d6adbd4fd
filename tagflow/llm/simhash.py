"""SimHash near-duplicates: fingerprints of word shingles, linked by multi-index hashing.

Fingerprints: a bit is one if it is one in over half the XXH64 hashes of a text's shingles.

Links join fingerprints that differ in at most d bits. A fingerprint is cut into segments; if d bits
are spread over m segments, the first d - m*(d div m) + 1 of them can be probed with radius d div m
and the others with one less, and some segment always has so few. A table has each distinct
fingerprint under each segment's value; every fingerprint enumerates the small Hamming ball of each
of its segments, fetches the matching rows of the table, and the complete distance is verified in
the join, so only links leave it.

A value that very many fingerprints share (copies with small changes) would make as many candidates
as the square of their number. Whoever probes such a value is linked another way that is exact as
well: two fingerprints differ in at most 2r bits exactly if their full balls of radius r meet, so
each writes down its ball, and those that meet at a point are hung on the smallest of them. At most
1 + 64 (r = 1) fingerprints meet at a point, and each link that the table would give is among them.

Texts are read once; fingerprints are state in the shared checkpoint folder, equal ones are one row
from there on, and the components come from alternating stars.

Defined cases: a null text is an empty one; a text without words has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; repeated rows get a row each; a null id
is kept, and a component's id is its smallest id that isn't null (null if there is none); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from .common import arrow_rows, column, documents, keep_nothing, pick, slices, unused, workers_ready
from .components import components

SHINGLE, DISTANCE, SEED, SEGMENTS = 3, 2, 42, 2
#: Distinct fingerprints under one segment value from which on the full balls are used.
CROWD = 24
#: Shingles whose bits a task unpacks at once.
BLOCK = 65_536
#: Rows of an Arrow batch of texts.
BATCH = 1_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().translate(_LOWER).split()  # of bytes: at blanks and \x09 to \x0D
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k, n in enumerate(ones.tolist()) if 2 * n > len(hashes))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text_col: str = "text",
                 out_col: str = "fp") -> DataFrame:
    """docs with the text column replaced by its fingerprint, a long with the same 64 bits."""
    workers_ready(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for part in slices(batches):
            fps = np.array([simhash(t, shingle, seed) for t in part.column(at).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)) if i == at else c for i, c in enumerate(part.columns)],
                                             [out_col if i == at else c for i, c in enumerate(part.schema.names)])

    schema = ", ".join(f"`{out_col}` long" if i == at else f"`{f.name}` {f.dataType.simpleString()}"
                       for i, f in enumerate(docs.schema.fields))
    return docs.mapInArrow(run, schema)


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most radius of the lowest bits."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(bits), r)]


def segments(m: int, distance: int) -> list[tuple[int, int, int]]:
    """First bit, number of bits and radius of each segment."""
    radius = distance // m
    wide = distance - m * radius + 1
    edges = [64 * k // m for k in range(m + 1)]
    return [(a, b - a, radius if k < wide else radius - 1) for k, (a, b) in enumerate(zip(edges, edges[1:]))
            if k < wide or radius]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = DISTANCE, m: int = SEGMENTS, crowd: int = CROWD) -> DataFrame:
    """Distinct fingerprints (column fp) -> pairs (a, b) whose components are those of all links.

    Under segment values of at most ``crowd`` fingerprints these are all links, else enough of them.
    """
    parts = segments(m, distance)

    def value(first: int, bits: int) -> Column:
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    table = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("seg"), value(first, bits).alias("key")) for k, (first, bits, _) in enumerate(parts)])).alias("s")
    ).select("fp", "s.seg", "s.key")
    probes = None
    for k, (first, bits, radius) in enumerate(parts):
        masks = F.array(*[F.lit(x).cast("long") for x in ball(bits, radius)])
        own = fps.select("fp", F.lit(k).alias("seg"), value(first, bits).alias("own"), F.explode(masks).alias("mask")).select(
            "fp", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key"))
        probes = own if probes is None else probes.unionByName(own)
    crowded = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("seg", "key")
    calm = table.join(crowded, ["seg", "key"], "left_anti")
    other = calm.select(F.col("fp").alias("b"), "seg", "key")
    near = (probes.select(F.col("fp").alias("a"), "seg", "key").join(other, ["seg", "key"])
            .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
            .select("a", "b"))
    # whoever probes a crowded value: points of the full ball, and those who meet there
    half = -(-distance // 2)
    masks = F.array(*[F.lit(signed(x)).cast("long") for x in ball(64, half)])
    among = probes.join(crowded, ["seg", "key"], "left_semi").select("fp").distinct()
    points = among.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    met = points.groupBy("point").agg(F.min("fp").alias("low"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    star = met.select(F.col("low").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    if distance % 2:  # balls of the rounded-up radius meet one bit too far as well
        star = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).where(
            (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
                    id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, row, fp, component_id and first (the row that stands for its component: smallest id, then row).

    row_col: a long that tells rows apart, if docs has one; else rows are numbered.
    """
    spark = docs.sparkSession
    path = state_path(spark, "fingerprints")
    if row_col:
        rows = pick(docs, doc_id=id_col, text=text_col, row=row_col)
    else:
        rows = pick(docs, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id())
    with arrow_rows(spark, BATCH):
        fingerprints(rows, shingle, seed, "text", "fp").write.parquet(path)
    state = spark.read.parquet(path)
    # of equal fingerprints: the smallest id, and the row that has it
    each = state.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                   F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    each_path = state_path(spark, "distinct-fingerprints")
    each.write.parquet(each_path)
    each = spark.read.parquet(each_path)
    roots = components(links(each.select("fp"), distance)).withColumnsRenamed({"node": "fp"})
    grouped = each.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    tops = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.min("head").alias("top"))
    found = grouped.select("fp", "root").join(tops, "root").select("fp", "component_id", F.col("top.row").alias("first"))
    return state.join(found, "fp").select("doc_id", "row", "fp", "component_id", "first")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each component that stands for it, with all its columns."""
    spark = docs.sparkSession
    row = unused(docs, "row_number")
    path = state_path(spark, "numbered")  # numbers hold for good once they are written
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    numbered = spark.read.parquet(path)
    found = near_duplicates(numbered, shingle, distance, seed, id_col, text_col, row)
    first = found.where(F.col("row") == F.col("first")).select(F.col("row").alias(row))
    return numbered.join(first, row, "left_semi").select(*[column(c) for c in docs.columns])


def op2_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash_multi_index": op2_simhash_multi_index}
ORACLE_SQL: dict[str, str] = {}
