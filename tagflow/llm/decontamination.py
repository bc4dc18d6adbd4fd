"""Benchmark decontamination: an FM-index over each shard of documents, searched for benchmark phrases.

A task reads its documents in shards of bounded size, numbers the words that a shard shares with the
benchmark and builds one FM-index over them. A word that no phrase has ends a run, and a run shorter
than every phrase can't hold one, so only runs that could are indexed; nothing else is left out. Each
phrase is searched backward through wavelet-tree ranks, its occurrences are located by sampled suffix
positions, and overlapping occurrences merge into spans of words to be removed. Documents are not
shuffled.

The benchmark is compiled by Spark into blocks of bounded size (vocabulary, distinct phrases, items of
each phrase), a table in the shared folder that stays there until ``session.clear_state``. A task reads
it from there and holds one block at a time: first the vocabularies, for the numbers, then the phrases,
for the search. The driver sees the number and the shortest phrase of each block.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters beyond ASCII. A
phrase is a window of 10 consecutive words of an item, or the whole item if it is shorter.

Defined cases: a null or empty text has no words; a null item id counts as the empty string; items
with one id count as one; an item without words has no phrase; repeated documents get a row each; a
document longer than a shard is a shard of its own; other columns are ignored; empty tables give no
rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import state_path
from ..sources.tables import read_table
from .arrays import replaced
from .common import documents, keep_nothing, pick, workers_ready
from .fm_index import GAP, FMIndex
from .token_files import file_system

WINDOW = 10
#: Bytes of text in a shard, and benchmark bytes in a block.
SHARD_BYTES, BLOCK_BYTES = 8_000_000, 4_000_000

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                  for c in range(256))
_MARK = b" \x01 "


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


class Block(NamedTuple):
    """Of one block of items: its words, its item ids, and for each length (length, phrases, starts, owners).

    A phrase is a row of places in the vocabulary; its items are owners[starts[p]:starts[p + 1]].
    """

    vocabulary: list[bytes]
    items: list[str]
    phrases: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


#: A block's row without a length holds its vocabulary and items; one more for each length holds its phrases.
BLOCK_KINDS = ("block int, length int, vocabulary array<binary>, items array<string>, "
               "phrases binary, starts binary, owners binary")
BLOCK = pa.schema([("block", pa.int32()), ("length", pa.int32()), ("vocabulary", pa.list_(pa.binary())),
                   ("items", pa.list_(pa.string())), ("phrases", pa.binary()), ("starts", pa.binary()), ("owners", pa.binary())])


def compiled(block: int, rows: list[tuple[str, str]], window: int) -> list[dict]:
    """Items as rows of BLOCK."""
    vocabulary: dict[bytes, int] = {}
    items: dict[str, int] = {}
    windows: dict[int, list[tuple[np.ndarray, int]]] = {}
    for item, text in sorted(rows):
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], dtype=np.int32)
        if len(numbers):
            length = min(window, len(numbers))
            windows.setdefault(length, []).append(
                (np.lib.stride_tricks.sliding_window_view(numbers, length), items.setdefault(item, len(items))))
    out = [{"block": block, "vocabulary": list(vocabulary), "items": list(items)}]
    for length, parts in sorted(windows.items()):
        phrases, which = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
        owner = np.repeat([i for _, i in parts], [len(p) for p, _ in parts])
        which, owner = np.divmod(np.unique(which.ravel() * len(items) + owner), len(items))
        starts = np.searchsorted(which, np.arange(len(phrases) + 1))
        out.append({"block": block, "length": length, "phrases": phrases.astype("<i4").tobytes(),
                    "starts": starts.astype("<i8").tobytes(), "owners": owner.astype("<i4").tobytes()})
    return out


class Blocks:
    """The compiled benchmark in its folder. An only block is kept once read."""

    def __init__(self, folder: str, numbers: list[int], shortest: int):
        self.folder, self.numbers, self.shortest = folder, numbers, shortest
        self.only: Block | None = None

    def read(self, number: int, columns: list[str]) -> list[dict]:
        system, path = file_system(self.folder)
        return pq.read_table(f"{path}/block={number}", columns=columns, filesystem=system, partitioning=None).to_pylist()

    def vocabularies(self) -> Iterator[list[bytes]]:
        if len(self.numbers) == 1:
            yield next(self.blocks()).vocabulary
            return
        for number in self.numbers:
            yield next(r["vocabulary"] for r in self.read(number, ["vocabulary"]) if r["vocabulary"] is not None)

    def blocks(self) -> Iterator[Block]:
        for number in self.numbers:
            block = self.only
            if block is None:
                rows = self.read(number, [n for n in BLOCK.names if n != "block"])
                words = next(r for r in rows if r["length"] is None)
                block = Block(words["vocabulary"], words["items"], [
                    (r["length"], np.frombuffer(r["phrases"], "<i4").reshape(-1, r["length"]), np.frombuffer(r["starts"], "<i8"),
                     np.frombuffer(r["owners"], "<i4")) for r in rows if r["length"] is not None])
                if len(self.numbers) == 1:
                    self.only = block
            yield block


def compile_benchmark(benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> Blocks:
    """Write the benchmark's blocks to the shared folder; hashing makes them about equal."""
    spark = benchmark.sparkSession
    workers_ready(spark)
    items = pick(benchmark, item=item_col, text=text_col).select(
        F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 16)).collect()[0][0] or 0
    folder = state_path(spark, "benchmark")
    if not total:
        return Blocks(folder, [], 0)

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True))
        return pa.Table.from_pylist(compiled(table.column("block")[0].as_py(), rows, window), BLOCK)

    n_blocks = -(-int(total) // BLOCK_BYTES)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)).cast("int"))
    dealt.groupBy("block").applyInArrow(run, BLOCK_KINDS).write.partitionBy("block").parquet(folder)
    shortest = spark.read.parquet(folder).where("length IS NOT NULL").groupBy("block").agg(F.min("length")).collect()
    return Blocks(folder, sorted(int(k) for k, _ in shortest), min((n for _, n in shortest), default=0))


def search_shard(texts: list[str | None], benchmark: Blocks) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set[str]]]:
    """For each text: its number of words, the merged spans of words hit (first, end), and the items found."""
    joined = _MARK.join((t or "").encode().translate(_TO_WORDS) for t in texts)
    words = joined.split()
    distinct = set(words)
    known: dict[bytes, int] = {}
    for vocabulary in benchmark.vocabularies():
        for word in sorted(distinct.intersection(vocabulary)):
            known.setdefault(word, len(known) + 2)
    numbers = np.fromiter(map(known.get, words, repeat(0)), dtype=np.int32, count=len(words))
    marks = np.fromiter((i for i, w in enumerate(words) if w == b"\x01"), dtype=np.int64) if len(texts) > 1 else np.array([], dtype=np.int64)
    del words, distinct
    begins = np.concatenate(([0], marks + 1))
    counts = np.concatenate((marks, [len(numbers)])) - begins
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    inside = np.concatenate(([0], (numbers > 0).astype(np.int8), [0]))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_enough = (ends - starts) >= benchmark.shortest
    starts, ends = starts[long_enough], ends[long_enough]
    if not len(starts):
        return counts, spans, found
    # the runs, each followed by a gap, and the place of every number among the shard's words
    lengths = ends - starts + 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, lengths)
    sequence = numbers[np.minimum(places, len(numbers) - 1)].astype(np.int64)
    sequence[offsets[1:] - 1] = GAP
    index = FMIndex(sequence, len(known) + 1)
    hit = np.zeros(len(numbers) + 1, dtype=np.int64)
    for block in benchmark.blocks():
        here = np.fromiter(map(known.get, block.vocabulary, repeat(0)), dtype=np.int64, count=len(block.vocabulary))
        for length, phrases, first_owner, owners in block.phrases:
            rows = here[phrases]
            possible = np.flatnonzero(rows.all(axis=1))  # all words stand in this shard
            low, high = index.search(rows[possible])
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            n = (high - low)[some]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[some], n)
            at = places[index.locate(each)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            texts_hit = np.searchsorted(begins, at, side="right") - 1
            pairs = np.unique(np.stack((texts_hit, np.repeat(possible[some], n))), axis=1)
            for t, p in pairs.T.tolist():
                found[t].update(block.items[i] for i in owners[first_owner[p]:first_owner[p + 1]])
    covered = np.diff(np.concatenate(([0], (np.cumsum(hit)[:-1] > 0).astype(np.int8), [0])))
    firsts, ends = np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)
    for t, a, b in zip(np.searchsorted(begins, firsts, side="right") - 1, firsts, ends, strict=True):
        spans[t].append((int(a - begins[t]), int(b - begins[t])))
    return counts, spans, found


def in_code_points(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as spans of code points."""
    data = text.encode()
    places = [(m.start(), m.end()) for m in _WORD.finditer(data.translate(_TO_WORDS))]
    out, byte, point = [], 0, 0
    for a, b in spans:
        ends = []
        for at in (places[a][0], places[b - 1][1]):
            point += len(data[byte:at].decode())
            byte = at
            ends.append(point)
        out.append((ends[0], ends[1]))
    return out


RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT_KINDS = ("long", "long", "array<string>", "array<struct<start:long,end:long>>")


def shards(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about SHARD_BYTES of text; one row at least."""
    for batch in batches:
        sizes = np.cumsum(np.array([0, *[x or 0 for x in pc.binary_length(batch.column(text_at)).to_pylist()]]))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SHARD_BYTES, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, n_hit, items (found, sorted) and spans (code points to remove); see RESULT.

    prefix stands before these names, for docs that have columns so called.
    """
    workers_ready(docs.sparkSession)
    compiled_benchmark = compile_benchmark(benchmark, window, item_col, item_text_col)
    text_at = docs.columns.index(text_col)
    names = [prefix + n for n in RESULT.names]
    added = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, RESULT_KINDS, strict=True))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for shard in shards(batches, text_at):
            texts = shard.column(text_at).to_pylist()
            counts, spans, found = search_shard(texts, compiled_benchmark)
            points = [[{"start": a, "end": b} for a, b in in_code_points(t, x)] if x else []
                      for t, x in zip(texts, spans, strict=True)]
            more = [pa.array(counts, pa.int64()), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
                    pa.array([sorted(x) for x in found], RESULT.field("items").type),
                    pa.array(points, RESULT.field("spans").type)]
            yield pa.RecordBatch.from_arrays([*shard.columns, *more], [*shard.schema.names, *names])

    return docs.mapInArrow(run, schema)


def cut_out(text: Column, spans: Column) -> Column:
    """The text without its spans (in order, apart), by code points; a blank is left in place of each."""
    return replaced(text, spans, lambda x: F.lit(" "))


def op6_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    found = find_passages(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op6_fm_index_decontamination": op6_fm_index_decontamination}
ORACLE_SQL = {"op6_fm_index_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
windows AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n)),
found AS (SELECT r, i, windows.n, item FROM windows JOIN phrases USING (phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""}
