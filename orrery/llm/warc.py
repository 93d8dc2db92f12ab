"""WARC archives with an index first, read back by coalesced byte ranges.

Writing: records of equal payloads are found by digest; all but the one with the largest id become revisit records without
a payload. Each task writes its records to an archive of its own in the shared folder, each record a gzip member, under
a temporary name that becomes the final one when the archive is whole; a task that is run again replaces its archive by
the same bytes. The index (archive, offset, length, url, digest) is a Parquet table beside the archives.

Reading: the index rows that are wanted are dealt by stretches of an archive, sorted, and ranges that nearly touch are
read at once (``GAP`` apart at most, ``RANGE`` long at most). Nothing else of an archive is read.

Executors reach the folder through pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import chunked, map_batches, shared_folder

LEAST_REVISIT = 1000
GAP, RANGE, STRETCH = 64 << 10, 4 << 20, 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "id long, archive string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record_bytes(id_: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record of ``refers_to``; ``digest`` is the payload's SHA-1 in hex."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{id_}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (both lower-case names) and what follows them."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1.") or not sep:
        raise ValueError("no WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError("the record ends early")
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, _headers(http), body


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder if ":" in folder else f"file://{folder}"))


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT
) -> DataFrame:
    """Writes a record per row to archives in ``folder`` and returns their index, which is written there too.

    Of equal payloads of at least ``least`` bytes the row with the largest id is a response, the others revisit it.

    Defined results: a null payload is empty; a null url has no header; rows that repeat the largest id of their payload
    are responses all; a row without an id revisits if its payload has one with an id, else it is a response; no rows
    give an empty index. Other columns are ignored, whatever their names.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload")
    ).select("*", F.sha1("payload").alias("digest"))
    key = lambda: F.concat_ws("/", F.octet_length("payload").cast("string"), "digest", F.sha2("payload", 256)).alias("key")
    equal = rows.where(F.octet_length("payload") >= least).select("id", key()).groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("c"))
    equal = equal.where("c > 1 AND top IS NOT NULL").select(F.reverse("key").alias("yek"), "top")  # a key of its own: two plain exchanges
    planned = (
        rows.withColumn("yek", F.reverse(key()))
        .join(equal, "yek", "left")
        .select("id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))
        .sortWithinPartitions("id", "digest", "url")
    )

    def write(batches):
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft = f"{path}/.{name}.{task.taskAttemptId()}"
        at = 0
        with system.open_output_stream(draft, compression=None) as out:
            for batch in batches:
                index = []
                for row in zip(*batch.columns, strict=True):
                    id_, url, payload, digest, refers_to = (x.as_py() for x in row)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(id_, url, payload, digest, refers_to)) + packer.flush()
                    out.write(data)
                    index.append((id_, name, at, len(data), url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                    at += len(data)
                yield _batch(index, INDEX)
        system.move(draft, f"{path}/{name}") if at else system.delete_file(draft)

    map_batches(planned, write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = RANGE) -> list[tuple[str, int, int, int]]:
    """(archive, offset, length) in order to (archive, start, end, number of rows): reads that cover them."""
    found: list[list] = []
    for archive, offset, length in rows:
        last = found[-1] if found else None
        if last and last[0] == archive and offset - last[2] <= gap and max(last[2], offset + length) - last[1] <= most:
            last[2] = max(last[2], offset + length)
            last[3] += 1
        else:
            found.append([archive, offset, offset + length, 1])
    return [tuple(x) for x in found]


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the given rows of an index, read from the archives.

    Returns id, url, record_type, refers_to, payload_bytes and payload_digest (of the full payload, also for revisits) and
    payload (null for revisits, and for all without ``payloads``). A response whose payload doesn't have the digest of its
    record and of the index fails.

    Defined results: a null url stays null; an index row that is repeated is read as often; a row of an empty payload is
    a response of no bytes; no rows give no rows. Of a range of an archive one record is inflated at a time.
    """
    wanted = index.select("id", "archive", "offset", "length", "digest")
    near = wanted.repartition("archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")

    def records(batches):
        system, path = _open(folder)
        name, file = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            at = 0
            for archive, start, end, n in ranges([(r[1], r[2], r[3]) for r in rows]):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, system.open_input_file(f"{path}/{archive}")
                data = memoryview(file.read_at(end - start, start))
                for r in rows[at : at + n]:
                    yield _record(r[0], zlib.decompress(data[r[2] - start : r[2] - start + r[3]], 31), r[4], payloads)
                at += n
        if file:
            file.close()

    def read(batches):
        for some in chunked(records(batches), lambda r: len(r[-1] or b"") + 200):
            yield _batch(some, RECORD)

    return map_batches(near, read, RECORD)


def _record(id_: int | None, data: bytes, expected: str, payload: bool) -> tuple:
    warc, http, body = parse_record(data)
    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, size = warc["warc-type"], int(http["content-length"])
    if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != size) or digest != expected:
        raise ValueError(f"record {id_}: the payload differs from its digest")
    return _page(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), size, digest, body if payload and kind == "response" else None
