"""Vectors as matrices: Arrow batches to NumPy and back, rows packed to blocks, each query's best as tasks go."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

BLOCK = 512  # rows of a key that stand together
#: Bytes of queries that every task gets at once; more queries take several passes.
QUERY_BYTES = 1 << 26
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()), "array<long>": pa.list_(pa.int64())}


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long number lists as rows of a matrix."""
    if len(column) == 0:
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or len(flat) % len(column):
        raise ValueError("vectors are null or differ in length")
    return flat.reshape(len(column), -1)


def lists(rows: np.ndarray, kind=pa.float64()) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def bytes_of(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    rows = np.ascontiguousarray(rows, dtype=np.uint8)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def map_arrow(df: DataFrame, kernel: Callable[[dict], dict], schema: str) -> DataFrame:
    """Applies a kernel to each Arrow batch: a dict of columns to a dict of arrays (lists or NumPy) under ``schema``."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = [(n, _ARROW[k]) for n, k in fields]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = kernel({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], k) for n, k in kinds], names=[n for n, _ in kinds])

    return df.mapInArrow(run, schema)


def packed(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], ranged: bool = False) -> DataFrame:
    """Rows to blocks: ``keys`` (longs), then each column's values of the rows with equal keys, in ``order``, one after another.

    Numbers become arrays, equally long binaries and arrays are joined. The keys have to bound their rows, like a
    cluster and a stretch of ``BLOCK`` places in it, so that a hot cluster is many blocks. One shuffle; with
    ``ranged`` blocks of neighbouring keys end up in the same files.
    """
    rows = df.select(*[F.col(x).cast("long").alias(x) for x in keys], *dict.fromkeys([*columns, *[x for x in order if x not in keys]]))
    dealt = rows.repartitionByRange(*keys) if ranged else rows.repartition(*keys)
    dealt = dealt.sortWithinPartitions(*keys, *order)
    n = len(keys)

    def kind(field: StructField):
        return field.dataType if isinstance(field.dataType, (ArrayType, BinaryType)) else ArrayType(field.dataType)

    schema = StructType([*[StructField(x, LongType()) for x in keys], *[StructField(x, kind(rows.schema[x])) for x in columns]])
    place = [rows.columns.index(x) for x in columns]

    def block(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        out = [pa.array([x], pa.int64()) for x in key]
        for at in place:
            values = pa.concat_arrays([p.column(at) for p in parts])
            if pa.types.is_binary(values.type):
                out.append(pa.array([None if values.null_count else b"".join(values.to_pylist())], pa.binary()))
                continue
            missing = values.null_count > 0
            values = values.flatten() if pa.types.is_list(values.type) else values
            ends = pa.array([0, 0 if missing else len(values)], pa.int32())
            out.append(pa.array([None], pa.list_(values.type)) if missing else pa.ListArray.from_arrays(ends, values))
        return pa.RecordBatch.from_arrays(out, names=schema.names)

    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            named = [batch.column(i).to_numpy() for i in range(n)]
            cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in named], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                now = tuple(int(x[lo]) for x in named)
                if parts and now != key:
                    yield block(key, parts)
                    parts = []
                key = now
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield block(key, parts)

    return dealt.mapInArrow(run, schema)


class Best:
    """Each query's k best of what is added, by (value, id); holds k rows a query and a buffer."""

    def __init__(self, k: int, buffer: int = 1 << 19) -> None:
        self.k, self.buffer, self.parts, self.size, self.kept = k, buffer, [], 0, 0

    def add(self, query: np.ndarray, value: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, value, ids, *more))
            self.size += len(query)
            if self.size > self.buffer + 2 * self.kept:
                self.parts = [self.take()]
                self.size = self.kept = len(self.parts[0][0])

    def take(self) -> tuple[np.ndarray, ...]:
        """The columns as they were added, query by query from the best on; none if nothing was added."""
        if not self.parts:
            return ()
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        q = columns[0][order]
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < self.k]
        return tuple(c[order] for c in columns)


def local_rows(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix on the driver, by id; the caller bounds the rows."""
    table = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v")).toArrow()
    ids = table.column("i").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table.column("v").combine_chunks())[order]


def query_chunks(queries: DataFrame, per_query: int, id_col: str = "vec_id", limit: int = QUERY_BYTES) -> list[DataFrame]:
    """The queries in parts by a hash of the id, so that ``per_query`` bytes each stay below the limit."""
    n = queries.count()
    parts = max(1, -(-n * per_query // limit))
    if parts == 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == i) for i in range(parts)]
