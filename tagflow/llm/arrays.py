"""Running folds over long arrays and cuts of long texts, as column expressions.

A fold that appends to an array copies it at every step. Here arrays are folded CHUNK elements at a time, so
what is copied stays short; a value that a lambda reads more than once is bound to a variable first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def chunks(values: Column) -> Column:
    """values (bound) in arrays of CHUNK elements."""
    last = F.greatest(F.size(values) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(CHUNK)), lambda i: F.slice(values, i + 1, CHUNK))


def scan(values: Column, state: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step gives for each element: step(state, x) -> (next state, out). out_type: the SQL type of out. values: bound."""
    empty = F.array().cast(f"array<{out_type}>")

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["s"], x)
        return F.struct(new.alias("s"), F.concat(acc["out"], F.array(out.cast(out_type))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), empty.alias("out")), one)
        return bound(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["all"], F.array(r["out"])).alias("all")))

    first = F.struct(state.alias("s"), F.array().cast(f"array<array<{out_type}>>").alias("all"))
    return F.aggregate(chunks(values), first, chunk, lambda acc: F.flatten(acc["all"]))


def replaced(text: Column, spans: Column, mark: Callable[[Column], Column]) -> Column:
    """text with every run of overlapping spans (start, end; by start; code points) replaced by the mark of its first."""
    nothing = F.array().cast("array<string>")

    def per_chunk(t: Column) -> Callable[[Column, Column], Column]:
        def chunk(acc: Column, part: Column) -> Column:
            until = F.element_at(part, -1)["start"]
            local = F.substring(t, (acc["at"] + 1).cast("int"), F.greatest(until - acc["at"], F.lit(0)).cast("int"))

            def one(here: Column, base: Column) -> Callable[[Column, Column], Column]:
                def cut(a: Column, x: Column) -> Column:
                    piece = F.concat(F.substring(here, (a["at"] - base + 1).cast("int"), (x["start"] - a["at"]).cast("int")), mark(x))
                    new = F.when(x["start"] >= a["at"], F.array(piece)).otherwise(nothing)
                    return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["parts"], new).alias("parts"))
                return cut

            done = bound(local, lambda here: F.aggregate(part, F.struct(acc["at"].alias("at"), nothing.alias("parts")), one(here, acc["at"])))
            return bound(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(r["parts"], ""))).alias("parts")))
        return chunk

    def whole(both: Column) -> Column:
        t = both["t"]
        first = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("parts"))
        return F.aggregate(chunks(both["spans"]), first, per_chunk(t), lambda acc: F.concat(
            F.array_join(acc["parts"], ""), F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))

    return F.when(F.size(spans) > 0, bound(F.struct(text.alias("t"), spans.alias("spans")), whole)).otherwise(text)
