"""Token counts with a whole-token shortcut.

Before any text is read, the driver proves which strings of the vocabulary the merges turn into
exactly one token (a vocabulary may hold strings that its merges never reach). A pre-token among
them counts as one; only the others go through the merges. Both tables have the vocabulary's size,
which bounds what is sent to the tasks.

Counts are those of the tokenizers library for a byte-level BPE file: the texts of added tokens
inside a text count as one token each, none is put around it, nothing is cut off or padded.

Defined cases: a null text is an empty one (0 bytes, 0 tokens); every row gets its row, repeated or
not; a null id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, kept_object, pick, slices, workers_ready
from .pretokens import Pieces, Recent

LIMIT = 512
#: Parts up to which the next merge is looked for one by one.
SHORT = 48


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones for themselves, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The parts after all merges, the lowest rank first and the leftmost of equals."""
    if len(parts) > SHORT:
        return merge_long(parts, ranks)
    none = len(ranks)
    rank = [ranks.get(p, none) for p in zip(parts, parts[1:])]
    while rank and (lowest := min(rank)) < none:
        i = rank.index(lowest)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get((parts[i], parts[i + 1]), none)
        if i:
            rank[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
    return parts


def merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same through a heap: its time hardly grows faster than the length."""
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    alive = parts[:]
    heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j >= len(parts) or alive[i] != pair[0] or alive[j] != pair[1]:
            continue
        alive[i], alive[j] = pair[0] + pair[1], ""
        after[i] = k = after[j]
        if k < len(parts):
            before[k] = i
            if (p := (alive[i], alive[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, p))
        if (h := before[i]) >= 0 and (p := (alive[h], alive[i])) in ranks:
            heapq.heappush(heap, (ranks[p], h, p))
    return [x for x in alive if x]


class Vocabulary:
    """Merges of a tokenizers file, the strings proved to be whole tokens, and the added tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        file = json.load(open(path, encoding="utf-8"))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        self.ranks = {p: n for n, p in enumerate(pairs)}
        self.added = [t["content"] for t in file["added_tokens"]]
        self.pattern = pattern
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        split = regex.compile(pattern)
        whole = set()
        for name in file["model"]["vocab"]:
            try:
                text = bytes(back[c] for c in name).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # an added token, or not whole characters: no pre-token is that
            if split.findall(text) == [text] and len(merge(list(name), self.ranks)) == 1:
                whole.add(text)
        self.whole = frozenset(whole)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    def __init__(self, vocab: Vocabulary):
        self.vocab, self.letters = vocab, byte_letters()
        self.added = re.compile("|".join(map(re.escape, sorted(vocab.added, key=len, reverse=True)))) if vocab.added else None
        self.merged = Recent(self.merge)
        self.pieces = Pieces(regex.compile(vocab.pattern).findall, self.of_pretokens)

    def of_pretokens(self, pretokens: list[str]) -> int:
        whole = self.vocab.whole
        return sum([1 if p in whole else self.merged[p] for p in pretokens])

    def merge(self, pretoken: str) -> int:
        return len(merge([self.letters[b] for b in pretoken.encode()], self.vocab.ranks))

    def __call__(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return sum(self.pieces.of_text(text))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(self.pieces.of_text(p)) for p in parts if p)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each text, by the tokenizers file at path."""
    spark = docs.sparkSession
    workers_ready(spark)
    table = spark.sparkContext.broadcast(vocabulary(path))
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_object(("counts", path), lambda: Counter(table.value))
        for part in slices(batches):
            counts = [counter(t) if t else 0 for t in part.column(1).to_pylist()]
            sizes = [x or 0 for x in pc.binary_length(part.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)


def op5_whole_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op5_whole_token_counts": op5_whole_token_counts}
ORACLE_SQL: dict[str, str] = {}
