"""Token ids in flat binary files with 64-bit document offsets.

A table of texts becomes parts in ascending id order. Each part is three files: ``.bin`` has the ids
of its documents one after another as little-endian unsigned integers (16 bits if the vocabulary
fits, else 32), ``.idx`` has n + 1 offsets into them as 64-bit integers, ``.doc`` has the n document
ids as 64-bit integers (those that are null come first and are counted). A manifest table has a row
for each part with its base, the number of ids in all parts before it: a prefix sum over the parts.

Tasks write to names of their own attempt and only a successful attempt's row reaches the manifest,
so a lost executor leaves no half part behind that anyone reads. Files are written and mapped
through the file system of the folder's URI (a local or shared path is memory-mapped).

Defined cases: a null text is empty and is written as the end id alone; rows with one id follow each
other in the order of a hash of their text; an empty table gives no part and reads as no row; other
columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import state_path
from .common import documents, kept_object, partitions, pick, slices, workers_ready
from .pretokens import WordIds
from .token_counts import byte_letters

END_ID = 2
#: Words whose ids a worker keeps in the younger half of its memory.
WORDS = 500_000


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def numbers(uri: str, dtype: str, count: int) -> np.ndarray:
    """A flat file's numbers, memory-mapped where the folder is a path."""
    system, path = file_system(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", shape=(count,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype, count=count)


class IdsOfTexts(WordIds):
    """Ids by the tokenizers library: its model encodes the pre-tokens, which is what it does with a text's anyway.

    A text that holds an added token's string goes to the library whole.
    """

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.kind = ("<u4", "I") if wide else ("<u2", "H")
        self.letters = dict(enumerate(byte_letters()))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        super().__init__(regex.compile(pattern).findall, WORDS, added)

    def text(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def pretoken(self, text: str) -> bytes:
        shown = text.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(shown)]).tobytes()


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Write the files and their manifest (folder/manifest); return the manifest."""
    spark = docs.sparkSession
    workers_ready(spark)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    order = ["doc_id", "h", "n"]  # h and n only part rows of one id, so that these need not meet in one task
    dealt = keys.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, there = file_system(folder)
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        encoder = kept_object(("ids", path), lambda: IdsOfTexts(path))
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        width = np.dtype(encoder.dtype).itemsize
        lengths: list[int] = []
        ids: list[int | None] = []
        out = None
        for part in slices(batches):
            out = out or system.open_output_stream(f"{there}/{name}.bin", compression=None)
            for data in encoder.batch([t or "" for t in part.column(1).to_pylist()]):
                out.write(data)
                out.write(end)
                lengths.append((len(data) + len(end)) // width)
            ids.extend(part.column(0).to_pylist())
        if out is None:
            return
        out.close()
        offsets = np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64)))).astype("<i8")
        for suffix, array in (("idx", offsets), ("doc", np.array([i or 0 for i in ids], dtype="<i8"))):
            with system.open_output_stream(f"{there}/{name}.{suffix}", compression=None) as f:
                f.write(array.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "name": [name], "dtype": [encoder.dtype],
                                          "n_docs": [len(ids)], "n_null": [sum(i is None for i in ids)],
                                          "n_ids": [int(offsets[-1])]},
                                         schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("dtype", pa.string()),
                                                           ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64())]))

    dealt.mapInArrow(run, "part int, name string, dtype string, n_docs long, n_null long, n_ids long").write.parquet(
        f"{folder}/parts")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    parts = spark.read.parquet(f"{folder}/parts")
    parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids before it in all parts), n_tokens and ids_crc32 of each document."""
    workers_ready(spark)
    manifest = spark.read.parquet(f"{folder}/manifest").repartition(partitions(spark), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem, n = f"{folder}/{row['name']}", row["n_docs"]
                offsets = numbers(f"{stem}.idx", "<i8", n + 1)
                ids = numbers(f"{stem}.doc", "<i8", n)
                tokens = numbers(f"{stem}.bin", row["dtype"], row["n_ids"])
                crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(ids), pa.int64(), mask=np.arange(n) < row["n_null"]), pa.array(row["base"] + offsets[:-1]),
                     pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = state_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, folder)


QUERIES = {"op8_token_files": op8_token_files}
ORACLE_SQL: dict[str, str] = {}
