"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orrery.storage import durable, release, replicated, shared_folder

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "UPPER", "WORD", "ascii_lower", "chunked", "durable", "held", "map_batches", "quoted", "release", "replicated", "shared_folder", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a run without space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a Python worker gets at once; one row may be longer.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null stays null.

    ``lower`` does just this where every character is one byte, and is much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def quoted(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


_HELD: list = [None, None]


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept by a worker for its next tasks; a worker keeps one thing, and the old goes before the new is made."""
    if _HELD[0] is None or _HELD[0] != key:
        drop()
        _HELD[:] = [key, make()]
    return _HELD[1]


def drop() -> None:
    _HELD[:] = [None, None]
    trim()


def trim() -> None:
    """Hands freed memory back: a worker serves tasks of several operators in turn."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def map_batches(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, holds: bool = False) -> DataFrame:
    """``mapInArrow`` over batches of at most BATCH_ROWS rows and about BATCH_BYTES.

    The session's Arrow limits are lowered to these, since what exceeds them is built up in the JVM before Python sees it.
    ``holds``: the kernel keeps a thing by ``held``; other kernels drop what the worker still has.
    """
    conf = rows.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def sliced(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)

    def run(batches):
        if not holds:
            drop()
        try:
            yield from kernel(sliced(batches))
        finally:
            trim()

    return rows.mapInArrow(run, schema)


def chunked(rows: Iterator[tuple], weigh: Callable[[tuple], int], most: int = BATCH_BYTES, count: int = 8192) -> Iterator[list[tuple]]:
    """Rows in lists of at most ``count``, each closed once its rows weigh ``most``."""
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += weigh(row)
        if size >= most or len(part) >= count:
            yield part
            part, size = [], 0
    if part:
        yield part
