"""Vector file formats as Spark data sources.

``spark.read.format("vectorfile").load(path)`` reads .fvecs, .bvecs, .ivecs, .fbin, .u8bin and .bin as (vec_id, embedding);
with ``option("kind", "assignment")`` .cid64 and .ivecs as (vec_id, cid), with ``option("kind", "truth")`` .gt64, .ivecs, type 1
and ids alone as (query_id, rank, vec_id, dist). Files are split by row ranges, so each task reads its own bytes. A folder of
vector files is one collection, numbered through in the order of the files' names.

``df.write.format("vectorfile")`` writes the vector formats, rows in the order of vec_id: as one file, whose parts the driver
joins at the end, or with ``option("parts", "true")`` as a folder of whole files, which nothing joins.

Paths are local or URIs of pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Element type by extension; formats with a size per row, and with one header.
ROWWISE = {".fvecs": "<f4", ".ivecs": "<i4", ".bvecs": "u1"}
HEADED = {".fbin": "<f4", ".u8bin": "u1", ".bin": "<f4"}
SPLIT_ROWS = 1 << 18


class VectorFileError(ValueError):
    """The file's size or header doesn't fit its format."""


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return pafs.LocalFileSystem(), os.path.abspath(path)


def _size(path: str) -> int:
    system, name = _at(path)
    return system.get_file_info(name).size


def _bytes(path: str, start: int, n: int) -> bytes:
    system, name = _at(path)
    with system.open_input_file(name) as f:
        return f.read_at(n, start)


def files_of(path: str) -> list[str]:
    """The file itself, or the vector files of a folder by name."""
    system, name = _at(path)
    if system.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    found = sorted(x.base_name for x in system.get_file_info(pafs.FileSelector(name)) if os.path.splitext(x.base_name)[1] in ROWWISE | HEADED and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{x}" for x in found]


@dataclass
class Layout:
    rows: int
    dim: int
    kind: str
    first: int  # byte of the first row
    stride: int  # bytes from row to row
    skip: int  # bytes of a row before its values

    def read(self, path: str, start: int, stop: int) -> np.ndarray:
        raw = np.frombuffer(_bytes(path, self.first + start * self.stride, (stop - start) * self.stride), np.uint8).reshape(stop - start, self.stride)
        return np.ascontiguousarray(raw[:, self.skip :]).view(self.kind).reshape(stop - start, self.dim)


def layout(path: str, partial: bool = False) -> Layout:
    """Format from the extension, else from which size equation holds; ``partial`` takes the whole rows of a cut file."""
    size, ext = _size(path), os.path.splitext(path)[1].lower()
    if ext == ".i8bin":
        raise VectorFileError("signed 8-bit vectors are not supported")
    head = _bytes(path, 0, 8)
    if len(head) < 8:
        raise VectorFileError("the file is too short for a header")
    a, b = struct.unpack("<ii", head)
    if ext in ROWWISE:
        kind, dim = ROWWISE[ext], a
        stride = 4 + dim * np.dtype(kind).itemsize
        if dim <= 0 or (size % stride and not partial):
            raise VectorFileError("the file doesn't hold whole rows")
        return Layout(size // stride, dim, kind, 0, stride, 4)
    kinds = [HEADED[ext]] if ext in HEADED else ["<f4", "u1"]
    for kind in kinds:
        stride = b * np.dtype(kind).itemsize
        if a >= 0 and b > 0 and (size >= 8 + a * stride if ext in HEADED else size == 8 + a * stride):
            return Layout(a, b, kind, 8, stride, 0)
        if ext in HEADED and partial and b > 0:
            return Layout(min(a, (size - 8) // stride), b, kind, 8, stride, 0)
    if ext not in HEADED and a > 0 and size % (4 + 4 * a) == 0:
        return Layout(size // (4 + 4 * a), a, "<f4", 0, 4 + 4 * a, 4)
    raise VectorFileError("the file is smaller than its header says")


@dataclass
class RowRange(InputPartition):
    start: int
    stop: int
    path: str = ""
    base: int = 0  # number of the file's first row


class VectorReader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.partial = path, str(options.get("mode", "")).upper() == "PERMISSIVE"
        self.step = int(options.get("splitrows", options.get("splitRows", SPLIT_ROWS)))
        self.ints = str(options.get("elements", "")).lower() == "own"

    def partitions(self) -> list[RowRange]:
        found, base = [], 0
        for path in files_of(self.path):
            n = layout(path, self.partial).rows
            found += [RowRange(at, min(n, at + self.step), path, base) for at in range(0, n, self.step)]
            base += n
        return found or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        if part.start == part.stop:
            return
        form = layout(part.path, self.partial)
        kind = np.dtype(form.kind) if self.ints else np.dtype(np.float32)
        kind = np.dtype(np.int16) if kind == np.uint8 else kind
        for at in range(part.start, part.stop, 8192):
            x = form.read(part.path, at, min(part.stop, at + 8192))
            ends = np.arange(len(x) + 1, dtype=np.int32) * form.dim
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel().astype(kind)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.base + at, part.base + at + len(x))), values], names=["vec_id", "embedding"])


class VectorWriter(DataSourceArrowWriter):
    """Each task writes a part as its rows come; committing joins the parts behind the header, or names them."""

    def __init__(self, path: str, overwrite: bool, parts: bool = False) -> None:
        self.path, self.parts = path, parts
        self.ext = os.path.splitext(path.rstrip("/"))[1].lower()
        if self.ext not in ROWWISE | HEADED:
            raise VectorFileError("the extension doesn't name a format that can be written")
        system, name = _at(path)
        if system.get_file_info(name).type != pafs.FileType.NotFound:
            if not overwrite:
                raise VectorFileError("the file is there already")
            if parts:
                system.delete_dir_contents(name, missing_dir_ok=True)

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        kind = (ROWWISE | HEADED)[self.ext]
        system, name = _at(self.path)
        if self.parts:
            system.create_dir(name, recursive=True)
        name = f"{name}{'/.' if self.parts else '.'}part-{task.partitionId():05d}-{task.taskAttemptId()}"
        first, last, rows, dim = 0, None, 0, 0
        with system.open_output_stream(name, compression=None) as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy()
                x = batch.column(batch.schema.get_field_index("embedding"))
                lengths = np.unique(np.diff(x.offsets.to_numpy()))
                if x.null_count or len(lengths) > 1 or rows and lengths[0] != dim:
                    raise VectorFileError("vectors are null or differ in length")
                if (np.diff(ids) <= 0).any() or last is not None and ids[0] <= last:
                    raise VectorFileError("a task's rows aren't in the order of vec_id; write with write_vectors")
                dim, first, last = int(lengths[0]), first if rows else int(ids[0]), int(ids[-1])
                flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim)
                if kind == "u1" and ((flat < 0) | (flat > 255) | (flat != np.floor(flat))).any():
                    raise VectorFileError("values aren't whole numbers from 0 to 255")
                flat = np.ascontiguousarray(flat.astype(kind)).view(np.uint8).reshape(len(ids), -1)
                if self.ext in ROWWISE:
                    flat = np.concatenate((np.tile(np.frombuffer(struct.pack("<i", dim), np.uint8), (len(ids), 1)), flat), axis=1)
                out.write(flat.tobytes())
                rows += len(ids)
        return Part(name, first, -1 if last is None else last, rows, dim)

    def commit(self, messages) -> None:
        system, name = _at(self.path)
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        if any(a.last >= b.first for a, b in zip(parts, parts[1:], strict=False)) or len({m.dim for m in parts}) > 1:
            self.abort(messages)
            raise VectorFileError("tasks' ids overlap, or vectors differ in length; write with write_vectors")
        head = lambda rows: struct.pack("<ii", rows, parts[0].dim if parts else 0) if self.ext in HEADED else b""
        if self.parts:
            for i, m in enumerate(parts):
                to = f"{name}/part-{i:05d}{self.ext}"
                if self.ext in HEADED:
                    self.join(system, f"{name}/.draft", head(m.rows), [m])
                    system.move(f"{name}/.draft", to)
                else:
                    system.move(m.name, to)
        else:
            self.join(system, name + ".draft", head(sum(m.rows for m in parts)), parts)
            system.move(name + ".draft", name)
        self.abort(messages)

    def join(self, system, to: str, head: bytes, parts: list) -> None:
        with system.open_output_stream(to, compression=None) as out:
            out.write(head)
            for m in parts:
                with system.open_input_stream(m.name, compression=None) as f:
                    while data := f.read(1 << 22):
                        out.write(data)

    def abort(self, messages) -> None:
        system, _ = _at(self.path)
        for m in messages:
            if m and system.get_file_info(m.name).type != pafs.FileType.NotFound:
                system.delete_file(m.name)


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int
    last: int
    rows: int
    dim: int


#: The first eight bytes of assignment and of ground truth files, as little-endian numbers.
CID64, GT64 = (0x3436444943444E44).to_bytes(8, "little"), (0x343654474F4E4944).to_bytes(8, "little")


@dataclass
class Ids:
    """Where a file of ids has them: n rows of k, and distances of the same shape if it has any."""

    n: int
    k: int
    kind: str
    first: int
    stride: int
    dists: int | None = None  # byte of the first distance
    clusters: int | None = None

    def read(self, path: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray | None]:
        width = self.k * np.dtype(self.kind).itemsize
        raw = np.frombuffer(_bytes(path, self.first + start * self.stride, (stop - start - 1) * self.stride + width), np.uint8)
        rows = np.lib.stride_tricks.as_strided(raw, (stop - start, width), (self.stride, 1))
        ids = np.ascontiguousarray(rows).view(self.kind).astype(np.int64)
        if self.clusters is not None and len(ids) and ids.max() >= self.clusters:
            raise VectorFileError(f"cluster {ids.max()} is not among the {self.clusters}")
        if self.dists is None:
            return ids, None
        return ids, np.frombuffer(_bytes(path, self.dists + 4 * self.k * start, 4 * self.k * (stop - start)), "<f4").reshape(-1, self.k)


def assignment_layout(path: str) -> Ids:
    """.cid64 (magic, version, n, C, n ids) or .ivecs."""
    if not path.endswith(".cid64"):
        form = layout(path)
        return Ids(form.rows, 1, form.kind, form.skip, form.stride)
    head = _bytes(path, 0, 32)
    if len(head) < 32 or head[:8] != CID64:
        raise VectorFileError("no assignment file")
    version, n, clusters = struct.unpack_from("<QQQ", head, 8)
    if version != 1 or _size(path) != 32 + 4 * n:
        raise VectorFileError("no whole assignment file")
    return Ids(n, 1, "<u4", 32, 4, clusters=clusters)


def truth_layout(path: str) -> Ids:
    """.gt64, .ivecs, type 1 (ids then ascending distances), or ids alone."""
    size, head = _size(path), _bytes(path, 0, 32)
    if head[:8] == GT64:
        version, n, k = struct.unpack_from("<QQQ", head, 8)
        if version != 1 or size != 32 + 8 * n * k:
            raise VectorFileError("no whole ground truth file")
        return Ids(n, k, "<u8", 32, 8 * k)
    if len(head) < 8:
        raise VectorFileError("the file is too short for a header")
    n, k = struct.unpack_from("<ii", head)
    if path.endswith(".ivecs") and n > 0 and size % (4 + 4 * n) == 0:
        form = layout(path)
        return Ids(form.rows, form.dim, "<u4", 4, form.stride)
    if size == 8 + 8 * n * k:
        return Ids(n, k, "<u4", 8, 4 * k, dists=8 + 4 * n * k)
    if size == 8 + 4 * n * k:
        return Ids(n, k, "<u4", 8, 4 * k)
    raise VectorFileError("the size fits no form of ground truth")


class IdReader(DataSourceReader):
    def __init__(self, path: str, kind: str, options: dict) -> None:
        self.path, self.kind, self.step = path, kind, int(options.get("splitrows", options.get("splitRows", SPLIT_ROWS)))

    def form(self) -> Ids:
        return assignment_layout(self.path) if self.kind == "assignment" else truth_layout(self.path)

    def partitions(self) -> list[RowRange]:
        n = self.form().n
        return [RowRange(at, min(n, at + self.step)) for at in range(0, n, self.step)] or [RowRange(0, 0)]

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        form = self.form()
        for at in range(part.start, part.stop, 8192):
            stop = min(part.stop, at + 8192)
            ids, dist = form.read(self.path, at, stop)
            if self.kind == "assignment":
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, stop)), pa.array(ids[:, 0])], names=["vec_id", "cid"])
                continue
            n = stop - at
            found = [np.repeat(np.arange(at, stop), form.k), np.tile(np.arange(1, form.k + 1), n), ids.ravel()]
            last = pa.nulls(n * form.k, pa.float64()) if dist is None else pa.array(dist.ravel().astype(float))
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), last], names=["query_id", "rank", "vec_id", "dist"])


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def kind(self) -> str:
        kind = str(self.options.get("kind", "vectors"))
        if kind not in ("vectors", "assignment", "truth"):
            raise VectorFileError("kind is vectors, assignment or truth")
        return kind

    def schema(self) -> str:
        if self.kind() == "vectors":
            own = str(self.options.get("elements", "")).lower() == "own"
            found = files_of(self.options["path"]) if own else []
            element = {"u1": "short", "<i4": "int"}.get(layout(found[0], True).kind, "float") if found else "float"
            return f"vec_id long, embedding array<{element}>"
        return "vec_id long, cid long" if self.kind() == "assignment" else "query_id long, rank long, vec_id long, dist double"

    def reader(self, schema: StructType) -> DataSourceReader:
        if self.kind() == "vectors":
            return VectorReader(self.options["path"], self.options)
        return IdReader(self.options["path"], self.kind(), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return VectorWriter(self.options["path"], overwrite, str(self.options.get("parts", "")).lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFile)


def write_vectors(df: DataFrame, path: str, limit: int | None = None, parts: bool = False) -> None:
    """Writes (vec_id, embedding) in the order of vec_id, only ids below ``limit`` if one is given; as a folder with ``parts``."""
    register(df.sparkSession)
    rows = df.select("vec_id", "embedding")
    rows = rows if limit is None else rows.where(rows["vec_id"] < limit)
    rows = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    rows.write.format("vectorfile").option("parts", str(parts).lower()).mode("overwrite").save(path)


def convert(spark: SparkSession, source: str, target: str, limit: int | None = None) -> None:
    """A vector file in another format, whole or its first ``limit`` rows."""
    register(spark)
    write_vectors(spark.read.format("vectorfile").load(source), target, limit)


def concat_chunks(chunks: list, limit: int | None = None):
    """Frames of (vec_id, embedding), each numbered from 0, as one collection numbered through; the first ``limit`` rows.

    Chunks that begin beyond the limit aren't read.
    """
    out, first = None, 0
    for chunk in chunks:
        if limit is not None and first >= limit:
            break
        rows = chunk.select((chunk["vec_id"] + first).alias("vec_id"), "embedding")
        out = rows if out is None else out.unionByName(rows)
        first += chunk.count()
    return out if limit is None else out.where(out["vec_id"] < limit)


def write_cells(cells: list[tuple[int, list[float]]], path: str) -> None:
    """First-level cells: (number of children, centroid) rows behind a header of their number and width."""
    _write(path, [struct.pack("<ii", len(cells), len(cells[0][1]) if cells else 0), np.array([n for n, _ in cells], "<i4").tobytes(), np.array([c for _, c in cells], "<f4").tobytes()])


def read_cells(spark: SparkSession, path: str):
    """(cell, n_children, centroid) of a file of first-level cells."""
    data = _bytes(path, 0, _size(path))
    n, dim = struct.unpack_from("<ii", data)
    if len(data) != 8 + 4 * n + 4 * n * dim:
        raise VectorFileError("no whole file of cells")
    counts, x = np.frombuffer(data, "<i4", n, 8), np.frombuffer(data, "<f4", n * dim, 8 + 4 * n).reshape(n, dim)
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(counts, x, strict=True))], "cell long, n_children int, centroid array<double>")


# --- id files and ground truth


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, cid) from .cid64 or .ivecs; each task reads its own rows."""
    register(spark)
    return spark.read.format("vectorfile").option("kind", "assignment").load(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, vec_id, dist) from .gt64, .ivecs, type 1 or ids alone; dist may be null. Each task reads its own rows."""
    register(spark)
    return spark.read.format("vectorfile").option("kind", "truth").load(path)


def write_assignments(rows: list[int], clusters: int, path: str) -> None:
    _write(path, [CID64 + struct.pack("<QQQ", 1, len(rows), clusters), np.array(rows, "<u4").tobytes()])


def write_ground_truth(rows: DataFrame | list[tuple], k: int, path: str) -> None:
    """Type 1 from (query_id, rank, vec_id, dist), under a temporary name until it is whole.

    Queries are numbered from 0 and have k rows each: a table of queries times k, which fits a driver.
    """
    table = rows if isinstance(rows, DataFrame) else None
    found = [tuple(r) for r in table.select("query_id", "rank", "vec_id", "dist").collect()] if table is not None else list(rows)
    found.sort()
    n = len(found) // k
    if [r[:2] for r in found] != [(q, r) for q in range(n) for r in range(1, k + 1)]:
        raise VectorFileError("ground truth needs k ranks of each query, queries numbered from 0")
    _write(path, [struct.pack("<ii", n, k), np.array([r[2] for r in found], "<u4").tobytes(), np.array([r[3] for r in found], "<f4").tobytes()])


def write_gt64(rows: list[tuple], k: int, path: str) -> None:
    """64-bit ids from (query_id, rank, vec_id, ...) rows."""
    found = sorted(rows)
    _write(path, [GT64 + struct.pack("<QQQ", 1, len(found) // k, k), np.array([r[2] for r in found], "<u8").tobytes()])


def convert_truth(spark: SparkSession, source: str, target: str, queries: int | None = None) -> None:
    """Ground truth in another form, of all or the first ``queries`` queries: .gt64 (ids alone), else type 1, which needs distances."""
    rows = read_ground_truth(spark, source)
    rows = rows if queries is None else rows.where(rows["query_id"] < queries)
    found = [tuple(r) for r in rows.collect()]
    k = max((r[1] for r in found), default=0)
    if target.endswith(".gt64"):
        write_gt64(found, max(1, k), target)
    elif any(r[3] is None for r in found):
        raise VectorFileError("the ground truth has no distances, which type 1 needs")
    else:
        write_ground_truth(found, max(1, k), target)


def _write(path: str, pieces: list[bytes]) -> None:
    system, name = _at(path)
    with system.open_output_stream(name + ".part", compression=None) as f:
        for x in pieces:
            f.write(x)
    system.move(name + ".part", name)
