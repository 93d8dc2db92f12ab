"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut where they fill whole windows; those windows are done. What is left of each document
is shorter than a window. The rests of ``BLOCK`` documents are parted into k windows: every rest starts as a partial
partition of its own, and the two partial partitions with the largest spread are merged again and again, the fullest
windows of one with the emptiest of the other, until one is left. k starts at the least that could hold the tokens and
rises whenever a window exceeds its capacity. A small share of the tokens, from the longest rests, is cut small
beforehand (FILLERS): rests of about half a window alone can't be evened out.

Each task packs the documents it reads, in the order in which it reads them: nothing is shuffled, memory holds one block
of rests (at most BLOCK * window ids), and a task that is run again gives the same windows.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import held, map_batches

WINDOW = 2048
BLOCK = 256
#: Shares of a block's tokens that are cut to so many pieces a window.
FILLERS = ((1 / 16, 16), (1 / 64, 128))
END = 1
CACHED_WORDS = 200_000

#: Texts with these are left to the tokenizer as they are: its white space isn't Python's, it keeps special tokens whole,
#: and it lower-cases letter by letter. So are words outside the older alphabets, whose letters depend on its Unicode.
_ODD = re.compile("[\x1c-\x1fİΣ]|<\\|")
_RARE = re.compile("[^\x00-\u04ff]")
END_OF_WORD = b"\xff"  # no byte of UTF-8


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of_symbol() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merges of a byte-level vocabulary with word ends, as ranks: a word's last byte and its end come first."""

    def __init__(self, model: dict) -> None:
        import tiktoken

        of, vocab = _byte_of_symbol(), model["vocab"]
        symbol = {b: c for c, b in of.items()}
        raw = lambda s: bytes(of[c] for c in s.removesuffix("</w>")) + END_OF_WORD * s.endswith("</w>")
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        names = [symbol[b] for b in range(256)] + [symbol[b] + "</w>" for b in range(255)] + [a + b for a, b in pairs]
        self.ids = [vocab[x].to_bytes(4, "little") for x in names]
        ranks = {raw(x): i for i, x in enumerate(names)}
        self.encode = tiktoken.Encoding("merges", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, word: str) -> bytes:
        ids = self.ids
        return b"".join([ids[x] for x in self.encode(word.encode() + END_OF_WORD)])


class Words:
    """Ids of texts under a lower-casing tokenizer that never looks across white space.

    Ids of words are kept, up to a bound. New words go through the vocabulary's merges in a faster library, which gives
    the tokenizer's own ids; whatever the two could see differently goes to the tokenizer.
    """

    def __init__(self, vocabulary: str, cached: int = CACHED_WORDS) -> None:
        import regex
        from tokenizers import Tokenizer

        said = Path(vocabulary).read_text(encoding="utf-8")
        self.tokenizer = Tokenizer.from_str(said)
        self.known, self.parts = _Known(self.word, cached), _Known(lambda x: self.merges(x), cached)
        form = json.loads(said)
        pattern = form["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern).findall
        first = pattern.split("|")
        # a run of letters is one part: what is tried before begins with an apostrophe
        self.letters = "[\\p{L}]+" in first and all(x.startswith("'") for x in first[: first.index("[\\p{L}]+")])
        self.merges = Merges(form["model"])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: str) -> bytes:
        if _RARE.search(word):
            return self.whole(word)
        if self.letters and word.isalpha():
            return self.merges(word)
        parts = self.split(word)
        return self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[x] for x in parts])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if _ODD.search(text):
            return self.whole(text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


class _Known(dict):
    """What ``make`` gives for each key. At half of ``most`` entries they become the old ones; what isn't asked for again goes."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway differencing: the indexes of ``sizes`` in at most ``k`` groups of near-equal sums."""
    members = [[i] for i in range(len(sizes))]
    # a partial partition: (sum, group) from large to small; groups that are still empty are left out
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the smallest `over` of a meet the smallest of b in opposite order
            head, tail = a[: len(a) - over], a[len(a) - over :]
            for (s, g), (t, h) in zip(tail, reversed(b[len(b) - over :]), strict=True):
                members[g] += members[h]
                head.append((s + t, g))
            merged = head + b[: len(b) - over]
        else:
            merged = a + b
        merged.sort(key=lambda x: (-x[0], x[1]))
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, i, merged))
    return [members[g] for _, g in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of indexes whose sizes add up to ``capacity`` at most; as few as differencing finds."""
    k = max(-(-sum(sizes) // capacity), 1)
    while True:
        found = difference(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in found):
            return found
        k += 1


class Packer:
    """Takes documents one by one, gives rows (id, start, length, crc, tokens, sequence, offset)."""

    def __init__(self, sequence: int, window: int, block: int) -> None:
        self.sequence, self.window, self.block, self.rests, self.out = sequence, window, block, [], []

    def add(self, doc, ids: bytes) -> None:
        n, w = len(ids) // 4, self.window
        for start in range(0, n - n % w, w):
            self.out.append((doc, start, w, zlib.crc32(ids[4 * start : 4 * (start + w)]), n, self.sequence, 0))
            self.sequence += 1
        if n % w:
            start = n - n % w
            self.rests.append((doc, start, ids[4 * start :], n))
            if len(self.rests) == self.block:
                self.pack()

    def cut(self, rests: list[tuple]) -> list[tuple]:
        """The longest rests in small pieces, then the next in smaller ones, up to the shares of tokens in FILLERS."""
        total, whole, pieces = sum(len(x[2]) // 4 for x in rests), [], []
        want = [[share * total, 4 * max(1, self.window // parts)] for share, parts in FILLERS]
        for doc, start, ids, n in sorted(rests, key=lambda x: -len(x[2])):
            scale = next((x for x in want if x[0] > 0), None)
            if scale and len(ids) > scale[1]:
                step = scale[1]
                pieces += [(doc, start + at // 4, ids[at : at + step], n) for at in range(0, len(ids), step)]
                scale[0] -= len(ids) // 4
            else:
                whole.append((doc, start, ids, n))
        return whole + pieces

    def pack(self) -> None:
        rests, self.rests = self.cut(self.rests), []
        sizes = [len(x[2]) // 4 for x in rests]
        for group in windows(sizes, self.window) if rests else []:
            offset = 0
            for i in group:
                doc, start, ids, n = rests[i]
                self.out.append((doc, start, sizes[i], zlib.crc32(ids), n, self.sequence, offset))
                offset += sizes[i]
            self.sequence += 1


SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    block: int = BLOCK,
    end: int = END,
) -> DataFrame:
    """Pieces of tokenised documents in windows of at most ``window`` tokens; each document ends with id ``end``.

    Returns one row per piece: the id column, start (ids of its document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens, sequence_id and offset in the sequence. ``vocabulary`` is the
    path of a tokenizer file that every executor can read.

    Defined results: a null or empty text is the end id alone; rows that repeat an id, or have none, are documents of
    their own and keep that id; no rows give no rows. Other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        words = held(("words", path), lambda: Words(path))
        packer = Packer(TaskContext.get().partitionId() << 32, window, block)
        mark = np.array([end], dtype="<u4").tobytes()

        def emit():
            rows, packer.out = packer.out, []
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                packer.add(doc.as_py(), words.ids(text.as_py() or "") + mark)
                if len(packer.out) >= 8192:
                    yield emit()
        packer.pack()
        yield emit()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, SCHEMA, holds=True).withColumnRenamed("id", id_col)
