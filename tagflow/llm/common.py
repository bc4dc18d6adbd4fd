"""Helpers shared by the operators: column selection, unused names, slicing of Arrow batches."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table

#: Rows that a task turns into Python objects at once.
SLICE = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two columns of ``documents`` that the queries read."""
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def column(name: str) -> Column:
    """A column by its literal name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns can't clash."""
    return df.select(*[column(old).alias(new) for new, old in names.items()])


def unused(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"{base}_{uuid.uuid4().hex[:8]}"
    return name


def workers_ready(spark: SparkSession) -> None:
    ship_package(spark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that a task's Python objects stay small next to the Arrow batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict[Any, Any] = {}


def kept_object(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one object, such as a compiled vocabulary with its memory of words."""
    many_objects()
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def keep_nothing() -> None:
    """For tasks of other operators: workers serve all of them, and an idle one holds on to what it has."""
    many_objects()
    _KEPT.clear()


def many_objects() -> None:
    """For workers that keep large tables without cycles: look for cyclic garbage rarely."""
    gc.set_threshold(1_000_000, 50, 1000)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what runs inside: less memory outside the heap, in each of an executor's tasks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
