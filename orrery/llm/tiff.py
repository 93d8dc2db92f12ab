"""TIFF as a media column: a writer, and a reader that walks image directories and emits one row per page.

The reader takes either byte order, strips and tiles, no compression, PackBits, LZW and deflate, horizontal
differencing (8 and 16 bits a sample), chunky and planar samples, and whole-byte samples of 8 or 16 bits. Pages are read
one by one, so memory holds the file and a page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from orrery.llm.common import chunked, map_batches, quoted

# Fixed values of the format: tags, compressions, sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

ROW = 64
PAGE_ROWS = 16_384
#: A strip or tile can't hold more than so many bytes for each of its own, in any of the codecs.
MOST_RATIO = 4096


class TiffError(ValueError):
    """The file isn't a TIFF that can be read."""


# --- codecs


def packbits(row: bytes) -> bytes:
    out, at, n, literal = bytearray(), 0, len(row), 0
    while at < n:
        run = 1
        while run < 128 and at + run < n and row[at + run] == row[at]:
            run += 1
        if run >= 3:
            for x in range(literal, at, 128):
                piece = row[x : min(at, x + 128)]
                out += bytes([len(piece) - 1]) + piece
            out += bytes([257 - run, row[at]])
            at += run
            literal = at
        else:
            at += 1
    for x in range(literal, n, 128):
        piece = row[x : x + 128]
        out += bytes([len(piece) - 1]) + piece
    return bytes(out)


def packbits_rows(rows: np.ndarray) -> bytes:
    """PackBits of each row by itself; rows without a run of three are one literal, written all at once."""
    if rows.shape[1] > 128:
        return b"".join(packbits(r.tobytes()) for r in rows)
    runs = ((rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2])).any(axis=1)
    plain = np.concatenate((np.full((len(rows), 1), rows.shape[1] - 1, dtype=np.uint8), rows), axis=1)
    if not runs.any():
        return plain.tobytes()
    out, at = [], 0
    for i in np.flatnonzero(runs).tolist():
        out += [plain[at:i].tobytes(), packbits(rows[i].tobytes())]
        at = i + 1
    return b"".join([*out, plain[at:].tobytes()])


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while made < size:
        if at >= len(data):
            raise TiffError("PackBits data ends early")
        n = data[at]
        if n < 128:
            piece = data[at + 1 : at + 2 + n]
            if len(piece) != n + 1:
                raise TiffError("PackBits data ends early")
            at += n + 2
        elif n > 128:
            piece = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
            continue
        out.append(piece)
        made += len(piece)
    return b"".join(out)[:size]


def _widths(first: int, last: int) -> np.ndarray:
    """Bits of the codes written while the table has ``first`` to ``last`` - 1 entries; a width ends one code early."""
    return np.minimum(12, np.searchsorted((511, 1023, 2047), np.arange(first, last), side="right") + 9)


#: Of the codes between two clears, by place: bits, and where each begins. The table has 258 entries before the second.
_LZW_MOST = 4094 - 258 + 1
_LZW_BITS = _widths(257, 257 + _LZW_MOST + 3)
_LZW_BITS[0] = 9
_LZW_AT = np.concatenate(([0], np.cumsum(_LZW_BITS)))
_LZW_TURNS = [int(np.searchsorted(_LZW_BITS, w)) for w in (10, 11, 12)]


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; a width ends one code early, as the format wants."""
    runs, codes = [], []
    table: dict[int, int] = {}
    get, free, word = table.get, 258, data[0] if data else -1
    for b in data[1:]:
        key = word << 8 | b
        longer = get(key)
        if longer is None:
            codes.append(word)
            table[key] = free
            free += 1
            word = b
            if free == 4094:
                runs.append([*codes, 256])
                codes, free = [], 258
                table.clear()
        else:
            word = longer
    if word >= 0:
        codes.append(word)
    runs.append([*codes, 257])
    bits = [_bits(np.array([256]))]
    for run in runs:
        bits.append(_bits(np.array(run)))
    return np.packbits(np.concatenate(bits)).tobytes()


def _bits(codes: np.ndarray) -> np.ndarray:
    """The bits of the codes after a clear, each in the width of its place, high bits first."""
    bits = np.unpackbits(codes.astype(">u2").view(np.uint8)).reshape(-1, 16)
    cuts = [0, *_LZW_TURNS, len(codes)]
    return np.concatenate([bits[a:b, 16 - w :].ravel() for w, a, b in zip((9, 10, 11, 12), cuts[:4], [*cuts[1:4], len(codes)], strict=True)])


def unlzw(data: bytes, size: int) -> bytes:
    """The codes between two clears have known widths, so they are cut out at once; then words are joined code by code."""
    out, made, at = [], 0, 0
    bits = 8 * len(data)
    raw = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(4, np.uint8))).astype(np.int64)
    letters = [bytes([i]) for i in range(256)]
    begun = False
    while made < size:
        n = int(np.searchsorted(_LZW_AT[1:], bits - at, side="right"))
        starts = at + _LZW_AT[:n]
        low = starts >> 3
        three = raw[low] << 16 | raw[low + 1] << 8 | raw[low + 2]
        codes = three >> (24 - (starts & 7) - _LZW_BITS[:n]) & ((1 << _LZW_BITS[:n]) - 1)
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(ends[0]) if len(ends) else n
        some = codes[:stop].tolist()
        if some:
            if some[0] > 255:
                raise TiffError("LZW data starts with no letter" if not begun else "LZW code is not known yet")
            table = [*letters, b"", b""]
            last = letters[some[0]]
            words, put = [last], table.append
            for code in some[1:]:
                try:
                    word = table[code]
                    put(last + word[:1])
                except IndexError:
                    if code != len(table):
                        raise TiffError("LZW code is not known yet") from None
                    word = last + last[:1]
                    put(word)
                words.append(word)
                last = word
            out.append(b"".join(words))
            made += len(out[-1])
        if made >= size:
            break
        if not len(ends) or codes[stop] == 257:
            raise TiffError("LZW data ends early")
        at += int(_LZW_AT[stop + 1])
        begun = True
    return b"".join(out)[:size]


def inflate(data: bytes, size: int) -> bytes:
    try:
        out = zlib.decompressobj().decompress(data, size)
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e
    if len(out) < size:
        raise TiffError("deflate data ends early")
    return out


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        if len(data) < size:
            raise TiffError("data ends early")
        return data[:size]
    if compression == PACKBITS:
        return unpackbits(data, size)
    if compression == LZW:
        return unlzw(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return inflate(data, size)
    raise TiffError(f"compression {compression} is not supported")


def encode(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """A strip or tile of 8-bit samples, (rows, bytes)."""
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), dtype=np.uint8))
    if compression == PACKBITS:
        return packbits_rows(block)
    raw = block.tobytes()
    return lzw(raw) if compression == LZW else zlib.compress(raw, 1) if compression == DEFLATE else raw


# --- reader


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes  # rows from the top, samples of a pixel together


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory in turn."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("image directories form a ring")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", data, at)
            tags = dict(_field(data, order, at + 2 + 12 * i) for i in range(n))
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        except struct.error as e:
            raise TiffError("an image directory or a field lies outside the file") from e
        yield order, tags


def pages(data: bytes) -> Iterator[Page]:
    """Each image directory's page in turn."""
    for number, (order, tags) in enumerate(directories(data)):
        yield _page(data, order, tags, number)


def _field(data: bytes, order: str, at: int) -> tuple[int, tuple]:
    tag, kind, count = struct.unpack_from(order + "HHI", data, at)
    if kind not in FIELD:
        return tag, ()
    form = f"{order}{count}{FIELD[kind]}"
    if struct.calcsize(form) > len(data):
        raise TiffError("a field lies outside the file")
    place = at + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, at + 8)[0]
    return tag, struct.unpack_from(form, data, place)


def _page(data: bytes, order: str, tags: dict[int, tuple], number: int) -> Page:
    one = lambda tag, default=0: tags[tag][0] if tags.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if min(width, height, samples) <= 0 or bits not in (8, 16) or any(b != bits for b in tags[BITS]) or predictor not in (1, 2):
        raise TiffError(f"page {number}: sizes, bits or predictor are not supported")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    if min(across, down) <= 0:
        raise TiffError(f"page {number}: strips or tiles have no size")
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_BYTES))
    per = 1 if planar == 2 else samples
    columns, rows = -(-width // across), -(-height // down)
    if not offsets or not counts or len(offsets) != columns * rows * (samples // per) or len(counts) != len(offsets):
        raise TiffError(f"page {number}: strips or tiles are missing")
    if min(offsets) < 0 or min(counts) < 0 or across * down * per * (bits // 8) > MOST_RATIO * (max(counts) + 1) or width * height * samples > MOST_RATIO * len(data):
        raise TiffError(f"page {number}: the file can't hold pages of this size")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    out = np.empty((samples // per, height, width, per), dtype=kind)
    for i, (start, size) in enumerate(zip(offsets, counts, strict=True)):
        if start + size > len(data):
            raise TiffError(f"page {number}: a strip or tile lies outside the file")
        plane, place = divmod(i, columns * rows)
        y, x = (place // columns) * down, (place % columns) * across
        high = down if tiled else min(down, height - y)
        raw = decode(data[start : start + size], compression, high * across * per * kind.itemsize)
        block = np.frombuffer(raw, dtype=kind).reshape(high, across, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        out[plane, y : y + high, x : x + across] = block[: height - y, : width - x]
    pixels = out[0] if per == samples else np.moveaxis(out[..., 0], 0, -1)
    return Page(number, width, height, samples, bits, compression, predictor, tiled, np.ascontiguousarray(pixels).tobytes())


# --- writer


def write(images: list[tuple[np.ndarray, int, int, int]]) -> bytes:
    """A little-endian file of 8-bit grey pages: (rows, compression, predictor, tile side or 0 for strips)."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image, compression, predictor, tile in images:
        height, width = image.shape
        if tile:
            grid = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), dtype=np.uint8)
            grid[:height, :width] = image
            blocks = [grid[y : y + tile, x : x + tile] for y in range(0, len(grid), tile) for x in range(0, grid.shape[1], tile)]
        else:
            step = max(1, 65_536 // width)
            blocks = [image[y : y + step] for y in range(0, height, step)]
        offsets, counts = [], []
        for block in blocks:
            coded = encode(block, compression, predictor)
            offsets.append(len(out))
            counts.append(len(coded))
            out += coded
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        if tile:
            fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_BYTES: counts}
        else:
            fields |= {STRIP_OFFSETS: offsets, STRIP_ROWS: [step], STRIP_BYTES: counts}
        entries = bytearray()
        for tag in sorted(fields):
            values = fields[tag]
            if len(values) == 1:
                place = values[0]
            else:
                place = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            entries += struct.pack("<HHII", tag, 4, len(values), place)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 text, and its bytes padded with zeros to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % ROW or (0 if raw else ROW))


def image_file(payload: bytes) -> bytes:
    """The payload as grey pages of ROW samples by at most PAGE_ROWS.

    The codec follows from the number of rows alone, whatever the size, so equal payloads are equal files: LZW, PackBits
    or deflate, LZW and deflate with differencing or not; above 8 KB in tiles.
    """
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    codec = ((LZW, 1), (PACKBITS, 1), (DEFLATE, 2), (LZW, 2), (DEFLATE, 1), (PACKBITS, 1))[len(rows) % 6]
    tile = ROW if len(payload) > 8192 else 0
    return write([(rows[y : y + PAGE_ROWS], *codec, tile) for y in range(0, len(rows), PAGE_ROWS)])


# --- operators


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a TIFF file; null counts as empty. Other columns are ignored.

    Defined results: an empty text is one row of zeros; equal texts are equal files, under whatever ids; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"], StructField("n_bytes", LongType()), StructField("media", BinaryType())])

    def files(batch):
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n, payload = payload_of(text.as_py())
            yield name, n, image_file(payload)

    def run(batches):
        for batch in batches:
            for some in chunked(files(batch), lambda r: len(r[2])):
                yield _rows(some, [batch.schema.field(0).type, pa.int64(), pa.binary()], schema.names)

    return map_batches(rows, run, schema).withColumnRenamed("id", id_col)


PAGE = [
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("page", IntegerType()), StructField("top", LongType()),
    StructField("rows", LongType()), *[StructField(x, IntegerType()) for x in ("width", "height", "samples", "bits", "compression", "predictor")],
    StructField("tiled", BooleanType()), StructField("pixels", BinaryType()), StructField("error", StringType()),
]
_ARROW = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.bool_(), pa.binary(), pa.string()]


def page_rows(data: bytes) -> Iterator[tuple]:
    """The rows of ``read_pages`` that a file gives, from media_bytes on."""
    stored = (len(data), hashlib.sha256(data).hexdigest())
    found, fault = [], None
    try:
        found.extend(directories(data))
    except TiffError as e:
        fault = str(e)
    heights = [tags[HEIGHT][0] if tags.get(HEIGHT) else 0 for _, tags in found]
    number = 0
    try:
        for number, (order, tags) in enumerate(found):
            p = _page(data, order, tags, number)
            yield (*stored, number, sum(heights[:number]), sum(heights), p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None)
        number = len(found)
    except TiffError as e:
        fault = str(e)
    if fault is not None:
        yield (*stored, number, *[None] * 10, fault)


def read_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: Sequence[str] = ()) -> DataFrame:
    """One row per page of each file, in order: the id column, those of ``keep``, length and SHA-256 of the file, page (from
    0), top (rows of the pages before), rows (of all pages), sizes, codec and decoded pixels.

    Defined results: a null file has no rows; a file that can't be read on gives the pages before the fault and one row
    whose pixels are null and whose error says why; rows that repeat an id are files of their own; no rows give no rows.
    Other columns are ignored.
    """
    rows = media.select(F.col(id_col).alias("id"), *[quoted(x).alias(f"keep{i}") for i, x in enumerate(keep)], F.col(media_col).alias("media"))
    n = 1 + len(keep)
    schema = StructType([*rows.schema.fields[:n], *PAGE])

    def run(batches):
        for batch in batches:
            kinds = [*(f.type for f in list(batch.schema)[:n]), *_ARROW]
            given = zip(*(c.to_pylist() for c in batch.columns[:n]), batch.column(n), strict=True)
            found = ((*x[:n], *row) for x in given if x[n].is_valid for row in page_rows(x[n].as_py()))
            for some in chunked(found, lambda r: len(r[-2] or b"")):
                yield _rows(some, kinds, schema.names)

    found = map_batches(rows, run, schema).withColumnRenamed("id", id_col)
    return found.withColumnsRenamed({f"keep{i}": x for i, x in enumerate(keep)})


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def feature_of(number: int, size: tuple[int, int], mean: float, blocks: np.ndarray) -> str:
    """Pages, width and height of all rows, mean sample, and 64 bits: is an eighth by eighth of them above their median."""
    bits = int("".join("01"[int(x)] for x in (blocks > np.median(blocks)).ravel()), 2)
    return f"p{number}-{size[0]}x{size[1]}-m{mean:.4f}-h{bits:016x}"


class _Digest:
    """Of one file, whose pages come in turn."""

    def __init__(self, first: tuple, media_bytes: int, media_sha: str, rows: int) -> None:
        self.first, self.media, self.rows = first, (media_bytes, media_sha), rows
        self.sha, self.n, self.total, self.tail, self.pages, self.width = hashlib.sha256(), 0, 0, b"", 0, 0
        self.sums, self.counts = np.zeros((8, 8)), np.zeros((8, 8))

    def add(self, top: int, width: int, height: int, pixels: bytes) -> None:
        self.sha.update(pixels)
        self.n, self.tail, self.pages, self.width = self.n + len(pixels), pixels[-ROW:], self.pages + 1, width
        grid = np.frombuffer(pixels, dtype=np.uint8).reshape(height, -1)
        cols = np.linspace(0, grid.shape[1], 9).astype(int)
        parts = np.stack([grid[:, a:b].sum(axis=1, dtype=np.int64) for a, b in zip(cols[:-1], cols[1:], strict=True)], axis=1)
        self.total += int(parts.sum())
        band = np.minimum(7, (top + np.arange(height)) * 8 // max(1, self.rows))
        np.add.at(self.sums, band, parts)
        np.add.at(self.counts, band, np.diff(cols))

    def row(self) -> tuple:
        blocks = self.sums / np.maximum(1, self.counts)
        feature = feature_of(self.pages, (self.width, self.rows), self.total / max(1, self.n), blocks)
        return (*self.first, self.n, self.sha.hexdigest(), zlib.crc32(self.tail), *self.media, feature)


def digests(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", size_col: str = "n_bytes") -> DataFrame:
    """What the stored files hold, from the rows of ``read_pages``, page by page as they come: the id column, n_bytes (given),
    payload_bytes and payload_sha256 of all pixels, tail_crc32 of the last ROW of them, media_bytes, media_sha256, feature.

    A file's pages come one after another from the task that reads it, so nothing is shuffled and a task holds one page.

    Defined results: rows that repeat, and empty texts' files, are files like others; a null file has no row; a file that
    can't be read fails the job; no rows give no rows.
    """
    found = read_pages(media, id_col, media_col, keep=[size_col])
    found = found.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n_bytes"), "media_bytes", "media_sha256", "page", "top", "rows", "width", "height", "pixels", "error")
    own = [("payload_bytes", LongType()), ("payload_sha256", StringType()), ("tail_crc32", LongType()), ("media_bytes", LongType()), ("media_sha256", StringType()), ("feature", StringType())]
    schema = StructType([found.schema["id"], found.schema["n_bytes"], *[StructField(*x) for x in own]])
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def files(batches):
        now = None
        for batch in batches:
            small = zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True)
            for (name, n, size, sha, page, top, rows, width, height), pixels, error in zip(small, batch.column(9), batch.column(10), strict=True):
                if error.is_valid:
                    raise TiffError(f"{name}: {error.as_py()}")
                if page == 0:
                    if now:
                        yield now.row()
                    now = _Digest((name, n), size, sha, rows)
                now.add(top, width, height, pixels.as_py())
        if now:
            yield now.row()

    def run(batches):
        first = None

        def seen():
            nonlocal first
            for batch in batches:
                first = batch.schema.field(0).type
                yield batch

        for some in chunked(files(seen()), lambda r: 300):
            yield _rows(some, [first, *arrow], schema.names)

    return map_batches(found, run, schema).withColumnRenamed("id", id_col)
