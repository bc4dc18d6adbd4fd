"""Byte-level BPE encoding and decoding of a table's texts, by the transducer of ``bpe_transducer``.

``encode`` gives each text's token ids: the text is split by the pattern, and each match goes
through the transducer. ``decode`` turns ids back into text by an incremental UTF-8 state machine.
``encode_decode`` does both in one pass. They run in Arrow batches without a shuffle; a worker keeps the compiled vocabulary and the pieces
it has seen from task to task, in bounded memory.

Defined cases: a null text encodes as an empty one (no ids); special strings inside a text are
ordinary text; ids of null decode to null, ids that don't end a character to U+FFFD; an unknown id
is an error; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_transducer import Ranks, Transducer, Utf8Stream
from .common import documents, keep_nothing, kept_object, slices, workers_ready
from .pretokens import WordIds

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words whose ids a worker keeps in the younger half of its memory.
WORDS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder(WordIds):
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.table = Ranks(ranks)
        self.transducer = Transducer(self.table)
        super().__init__(regex.compile(pattern).findall, WORDS, [])

    def pretoken(self, text: str) -> bytes:
        return array("i", self.transducer.encode(text.encode())).tobytes()


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """docs with the text column replaced by ids_col, the token ids of each text."""
    spark = docs.sparkSession
    workers_ready(spark)
    table = spark.sparkContext.broadcast(read_ranks(path))  # a vocabulary
    key = ("bpe", path, pattern)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_object(key, lambda: Encoder(table.value, pattern))
        for part in slices(batches):
            data = encoder.batch([t or "" for t in part.column(at).to_pylist()])
            ids = id_lists(data)
            yield pa.RecordBatch.from_arrays([ids if i == at else c for i, c in enumerate(part.columns)],
                                             [ids_col if i == at else c for i, c in enumerate(part.schema.names)])

    schema = ", ".join(f"`{ids_col}` array<int>" if i == at else f"`{f.name}` {f.dataType.simpleString()}"
                       for i, f in enumerate(docs.schema.fields))
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with out_col, the text that the ids stand for."""
    spark = encoded.sparkSession
    workers_ready(spark)
    table = spark.sparkContext.broadcast(read_ranks(path))
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        stream = Utf8Stream({n: b for b, n in table.value.items()})
        for part in slices(batches):
            texts = [None if x is None else stream.feed(x) + stream.end() for x in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                             [*part.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, `{out_col}` string")


def encode_decode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text_col: str = "text",
                  ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """docs with the text column replaced by ids_col, and out_col, the text decoded from these ids; in one pass."""
    spark = docs.sparkSession
    workers_ready(spark)
    table = spark.sparkContext.broadcast(read_ranks(path))
    key = ("bpe", path, pattern)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_object(key, lambda: Encoder(table.value, pattern))
        stream = Utf8Stream(encoder.table.bytes_of)
        for part in slices(batches):
            data = encoder.batch([t or "" for t in part.column(at).to_pylist()])
            ids = id_lists(data)
            texts = pa.array([stream.feed(np.frombuffer(x, dtype=np.int32).tolist()) + stream.end() for x in data], pa.string())
            yield pa.RecordBatch.from_arrays([*(ids if i == at else c for i, c in enumerate(part.columns)), texts],
                                             [*(ids_col if i == at else c for i, c in enumerate(part.schema.names)), out_col])

    schema = ", ".join(f"`{ids_col}` array<int>" if i == at else f"`{f.name}` {f.dataType.simpleString()}"
                       for i, f in enumerate(docs.schema.fields))
    return docs.mapInArrow(run, f"{schema}, `{out_col}` string")


def id_lists(data: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, data)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), dtype=np.int32)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of texts (columns doc_id and text)."""
    back = encode_decode(docs.select("doc_id", "text"), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir), public_tokenizers.path(RANKS))


QUERIES = {"op9_bpe_transducer": op9_bpe_transducer}
ORACLE_SQL: dict[str, str] = {}
