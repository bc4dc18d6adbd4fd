"""Conversation structure repair: the cheapest edits that make the roles (s?(ua)+)?, by auction prices.

Equal rows of a conversation are counted first, so what goes on is distinct and no conversation, however
long, meets in one task: rows are dealt by ranges of (conversation, turn, role, text) and cut into blocks
of at most BLOCK rows or BYTES of text. ``auction_path`` gives the cost of each block from each role state
to each; the prices at the borders of blocks are passed backwards along each conversation (16 numbers a block),
every block traces its least cheapest word from each state under those prices, and the states are passed
forwards. A conversation of one block takes the same way. Blocks are a written table whose columns are read
as needed: costs, then codes, then texts. Only the query's digest streams a conversation through one task, since
SHA-256 is sequential; it holds a block at a time.

Defined cases: a null role or text is one blank; a null turn stands first; null ids are one conversation;
rows of one turn stand in the order of role and text (bytes); repeated rows count each; a role that begins
with none of s, u, a can't be kept, an empty one neither; a row with 0 copies only names its conversation; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import read_table
from . import auction_path as ap
from .common import keep_nothing, partitions, pick, slices, workers_ready

#: Rows of a block, and bytes of text after which one ends.
BLOCK, BYTES = 32, 4_000_000
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def distinct_rows(rows: DataFrame) -> DataFrame:
    """c, t (structs of id and turn, so that nulls are equal and first), role, text, copies, first.

    rows: conv_id, turn, role, text, copies. first: no earlier turn of the conversation has this role and text.
    """
    here = F.col("copies") > 0
    blank = F.lit(" ")
    clean = rows.select(
        F.struct("conv_id").alias("c"), F.struct(F.when(here, F.col("turn")).alias("turn")).alias("t"),
        F.when(here, F.coalesce(F.col("role").cast("string"), blank)).alias("role"),
        F.when(here, F.coalesce(F.col("text").cast("string"), blank)).alias("text"), F.col("copies").cast("long").alias("copies"))
    hashed = clean.withColumn("h", F.sha2("text", 256))
    once = hashed.groupBy("c", "t", "role", "h").agg(F.sum("copies").alias("copies"), F.max("text").alias("text"))
    # the earliest turn of each role and text, and then who it is: both keys are spread however long a conversation is
    firsts = hashed.groupBy("c", "role", "h").agg(F.min("t").alias("t")).withColumn("first", F.lit(True))
    joined = once.join(firsts, ["c", "t", "role", "h"], "left")
    return joined.select("c", "t", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))


class Block:
    """Rows of one conversation that stand together."""

    def __init__(self, conv, seq: int):
        self.conv, self.seq, self.bytes = conv, seq, 0
        self.codes, self.copies, self.roles, self.texts = bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.ends: list = [None] * 4  # first and last initial, first and last turn

    def add(self, turn, role: str, text: str, copies: int, first: bool) -> None:
        body = text.rstrip(BLANKS)
        blank, truncated = not body, bool(body) and body[-1] not in ".!?"
        initial = role[:1]
        self.blank += copies * blank
        self.duplicate += (copies - first) * (not blank)
        self.truncated += truncated and first
        self.illegal += copies - 1 + (bool(self.copies) and (self.ends[1], initial) not in LEGAL)
        if turn is not None:
            self.turns += turn != self.ends[3]
            self.ends[2:] = [turn if self.ends[2] is None else self.ends[2], turn]
        self.ends[:2] = [initial if not self.copies else self.ends[0], initial]
        self.codes.append(ap.code(initial, truncated and first, blank or not first))
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def row(self, part: int) -> dict:
        return {"conv_id": self.conv, "part": part, "seq": self.seq, "codes": bytes(self.codes), "copies": self.copies,
                "roles": self.roles, "texts": self.texts, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "turns": self.turns, "first_initial": self.ends[0],
                "last_initial": self.ends[1], "first_turn": self.ends[2], "last_turn": self.ends[3],
                "costs": list(ap.costs(bytes(self.codes)))}


def as_batches(rows: Iterator[dict], schema: pa.Schema, many: int = 256) -> Iterator[pa.RecordBatch]:
    held: list = []
    size = 0
    for r in rows:
        held.append(r)
        size += r.get("size", 0) if "size" in r else sum(map(len, r.get("texts", ())))
        if len(held) >= many or size > BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def arrow_schema(ddl: str, conv: pa.DataType, turn: pa.DataType | None = None) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "longs": pa.list_(pa.int64()),
             "strings": pa.list_(pa.string()), "conv": conv, "turn": turn}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def spark_schema(ddl: str, conv: str, turn: str = "long") -> str:
    kinds = {"longs": "array<long>", "strings": "array<string>", "conv": conv, "turn": turn}
    return ", ".join(f"{name} {kinds.get(kind, kind)}" for name, kind in (x.split() for x in ddl.split(", ")))


BLOCKS = ("conv_id conv, part long, seq long, codes binary, copies longs, roles strings, texts strings, blank long, "
          "duplicate long, truncated long, illegal long, turns long, first_initial string, last_initial string, "
          "first_turn turn, last_turn turn, costs longs")
PRICES = "conv_id conv, part long, seq long, prices longs"
CHOICES = "conv_id conv, part long, seq long, words strings, states longs"
CHOSEN = "conv_id conv, part long, seq long, state long, word string, after string"
REPAIRED = "conv_id conv, part long, seq long, audit string, cost long, new_roles strings, new_texts strings"
DIGESTS = ("conv_id conv, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def blocks_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """distinct_rows cut into blocks, numbered (part, seq) in the order of rows. A conversation without rows has an empty block."""
    spark = rows.sparkSession
    kinds = rows.schema["c"].dataType["conv_id"].dataType.simpleString(), rows.schema["t"].dataType["turn"].dataType.simpleString()
    order = ["c", "t", "role", "text"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep_nothing()
        part = TaskContext.get().partitionId()
        types: list = []

        def packed() -> Iterator[dict]:
            at: Block | None = None
            for batch in slices(batches):
                types[:] = [batch.schema.field("c").type.field(0).type, batch.schema.field("t").type.field(0).type]
                for r in batch.to_pylist():
                    conv = r["c"]["conv_id"]
                    if at is None or conv != at.conv or len(at.codes) >= block or at.bytes > BYTES:
                        if at is not None:
                            yield at.row(part)
                        at = Block(conv, 0 if at is None else at.seq + 1)
                    if r["role"] is not None:
                        at.add(r["t"]["turn"], r["role"], r["text"], r["copies"], r["first"])
            if at is not None:
                yield at.row(part)

        rows_out = packed()
        head = next(rows_out, None)
        if head is not None:
            def whole():
                yield head
                yield from rows_out
            yield from as_batches(whole(), arrow_schema(BLOCKS, *types))

    return dealt.mapInArrow(run, spark_schema(BLOCKS, *kinds))


def along(df: DataFrame, step, ddl: str, backwards: bool = False) -> DataFrame:
    """Streams rows of conversations in the order of blocks. step(conversation's rows) -> rows; both are iterators."""
    spark = df.sparkSession
    kind = df.schema["conv_id"].dataType.simpleString()
    place = [F.col("part").desc(), F.col("seq").desc()] if backwards else [F.col("part"), F.col("seq")]
    dealt = df.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", *place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import chain, groupby

        first = next(batches, None)
        if first is None:
            return
        rows = (r for b in slices(chain([first], batches), 64) for r in b.to_pylist())
        out = (x for _, group in groupby(rows, key=lambda r: r["conv_id"]) for x in step(group))
        yield from as_batches(out, arrow_schema(ddl, first.schema.field("conv_id").type))

    return dealt.mapInArrow(run, spark_schema(ddl, kind))


def each(df: DataFrame, step, ddl: str) -> DataFrame:
    """Block by block, in any order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            if batch.num_rows:
                yield pa.RecordBatch.from_pylist([step(r) for r in batch.to_pylist()],
                                                 schema=arrow_schema(ddl, batch.schema.field("conv_id").type))

    return df.mapInArrow(run, spark_schema(ddl, df.schema["conv_id"].dataType.simpleString()))


def border_prices(rows: Iterator[dict]) -> Iterator[dict]:
    prices = ap.AT_END
    for r in rows:
        yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "prices": list(prices)}
        prices = ap.before(r["costs"], prices)


def block_choices(r: dict) -> dict:
    least = min(p for p in r["prices"] if p != ap.NO_WAY)  # equal blocks meet the same prices up to a constant
    ways = ap.traced(r["codes"], tuple(p if p == ap.NO_WAY else p - least for p in r["prices"]))
    return {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "words": [w for w, _ in ways], "states": [s for _, s in ways]}


def border_states(rows: Iterator[dict]) -> Iterator[dict]:
    state, last = 0, None
    for r in rows:
        if last is not None:
            yield last
        last = {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "state": state, "word": r["words"][state], "after": ""}
        state = r["states"][state]
    yield last | {"after": ap.LETTERS_AT_END[state]}


def repaired_block(r: dict) -> dict:
    state, at, cost = r["state"], 0, 0
    audit, roles, texts = [], [], []
    for letter in r["word"] + r["after"]:
        audit.append(letter)
        cost += ap.DELETE if letter == "D" else ap.INSERT if letter in "IR" else 0
        cost += ap.CUT if letter in "KR" and r["codes"][at] & ap.TRUNCATED else 0
        if letter != "D":
            kept = letter == "K"
            state = ap.kept_state(r["codes"][at] & 3, state) if kept else ap.NEXT[state]
            roles.append(r["roles"][at] if kept else ap.ROLE[state])
            texts.append("" if letter == "I" else r["texts"][at])
        if letter != "I":
            audit.append("D" * (r["copies"][at] - 1))  # the other copies of a row
            cost += ap.DELETE * (r["copies"][at] - 1)
            at += 1
    return {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "audit": "".join(audit), "cost": cost,
            "new_roles": roles, "new_texts": texts}


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", copies_col: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, repaired): blocks as in BLOCKS; repaired has each block's audit and its new roles and texts, by part and seq."""
    spark = conversations.sparkSession
    workers_ready(spark)
    names = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col} | ({"copies": copies_col} if copies_col else {})
    rows = pick(conversations, **names)
    rows = rows if copies_col else rows.withColumn("copies", F.lit(1))
    rows = materialize(distinct_rows(rows), "conversation-rows")
    blocks = materialize(blocks_of(rows, block), "conversation-blocks")
    place = ["conv_id", "part", "seq"]
    prices = along(blocks.select(*place, "costs"), border_prices, PRICES, backwards=True)
    met = blocks.select(*place, "codes").join(prices.select("part", "seq", "prices"), ["part", "seq"])
    choices = each(met, block_choices, CHOICES)
    chosen = along(choices, border_states, CHOSEN)
    full = blocks.select(*place, "codes", "copies", "roles", "texts").join(chosen.drop("conv_id"), ["part", "seq"])
    return blocks, each(full, repaired_block, REPAIRED)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """conv_id, part, seq, at, role, text: the repaired conversations, a row for each turn, ordered by part, seq and at."""
    return repaired.select("conv_id", "part", "seq", F.posexplode(F.arrays_zip("new_roles", "new_texts")).alias("at", "x")).select(
        "conv_id", "part", "seq", "at", F.col("x.new_roles").alias("role"), F.col("x.new_texts").alias("text"))


def digests(rows: Iterator[dict]) -> Iterator[dict]:
    """One row for a conversation from its blocks, in their order."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
    sha, audit, lines, turns = hashlib.sha256(), [], 0, 0
    first = last = initial = None
    for r in rows:
        for name in out:
            out[name] += r[name]
        if r["first_initial"] is not None:
            out["illegal"] += initial is not None and (initial, r["first_initial"]) not in LEGAL
            initial = r["last_initial"]
        if r["first_turn"] is not None:
            turns += r["turns"] - (r["first_turn"] == last)
            first, last = r["first_turn"] if first is None else first, r["last_turn"]
        audit.append(r["audit"])
        for role, text in zip(r["new_roles"], r["new_texts"]):
            sha.update(f"{chr(10) * (lines > 0)}{role}:{text}".encode())
            lines += 1
    yield out | {"conv_id": r["conv_id"], "gaps": 0 if first is None else last - first + 1 - turns, "audit": "".join(audit),
                 "repaired_sha256": sha.hexdigest()}


def report(blocks: DataFrame, repaired: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, faults, cost, audit and the digest of its repaired turns."""
    counts = ["blank", "duplicate", "truncated", "illegal", "turns", "first_initial", "last_initial", "first_turn", "last_turn"]
    return along(repaired.join(blocks.select("part", "seq", *counts), ["part", "seq"]), digests, DIGESTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies after the contract's damage, by crc32 of id and turn."""
    blank = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return report(*repair(damaged(rows), copies_col="copies"))


QUERIES = {"op11_auction_repair": op11_auction_repair}
ORACLE_SQL: dict[str, str] = {}
