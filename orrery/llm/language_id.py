"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built; it accepts exactly the substrings of that text. A text
is parsed greedily into phrases, each the longest match with the labelled text from there on (at least one byte). The
entropy estimate is phrases * log2(bytes of the labelled text) / bytes of the text; the language that needs the
fewest normalised phrases wins.

Texts are lower-cased UTF-8 whose ASCII bytes that aren't letters become single spaces, so any script works. Workers turn
the automata into one table of transitions in which a missing one restarts at the root; what leaves the root begins a
phrase. All texts of a batch, in segments of ``SEGMENT`` bytes, and all languages step through it at once, each segment
as if a phrase began with it. Then the state in which the segment before really ends is carried over the border, until
the two parses meet, mostly at the next phrase; so the counts are those of a parse of the whole text.

The labelled text is a bounded sample, whose bounds are parameters: for each language ``docs_per_lang`` different texts in
the order of a hash of the text, of each its first ``max_doc`` characters, up to ``bytes_per_lang`` bytes, or an equal
share of ``bytes_in_all`` where there are many languages; none is left out. What is broadcast, the labelled text, is
bounded by these alone; each worker builds the automata once.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from orrery.llm.common import held, map_batches, quoted

SEGMENT = 1024
LANES = 4096  # segments times languages that step at once
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FLAG = 1 << 30
Model = list[tuple[str, bytes]]  # languages and their labelled text


def plain_bytes(text: str) -> np.ndarray:
    """Lower-case bytes; runs of ASCII bytes other than letters are one space each."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_SPACES), dtype=np.uint8)
    if len(data) == 0:
        return data
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    return data[keep]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root and paths from it spell the substrings of ``data``."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return go


def edges_of(data: bytes) -> tuple[int, np.ndarray]:
    """Number of states and (state, byte, state) of every transition."""
    go = suffix_automaton(data)
    return len(go), np.array([(s, c, t) for s, x in enumerate(go) for c, t in x.items()], dtype=np.int32).reshape(-1, 3)


class Parser:
    """Counts phrases of many texts against all languages at once."""

    def __init__(self, model: Model) -> None:
        self.langs = [x[0] for x in model]
        self.bits = np.array([math.log2(max(2, len(x[1]))) for x in model])
        used = np.unique(np.frombuffer(b"".join(x[1] for x in model), np.uint8))
        width = len(used) + 2  # the last two columns: bytes that no language has, and the padding after a text
        self.symbol = np.full(256, width - 2, dtype=np.int32)
        self.symbol[used] = np.arange(len(used))
        self.pad = width - 1
        roots, tables, at = [], [], 0
        for _, data in model:
            states, edges = edges_of(data)
            base = at * width
            table = np.full((states, width), -1, dtype=np.int32)
            table[edges[:, 0], self.symbol[edges[:, 1]]] = base + edges[:, 2] * width
            again = np.where(table[0] >= 0, table[0], base) | _FLAG
            table = np.where(table >= 0, table, again[None, :])
            table[0] = again
            table[:, self.pad] = base + np.arange(states, dtype=np.int32) * width
            tables.append(table.ravel())
            roots.append(base)
            at += states
        self.table, self.roots = np.concatenate(tables), np.array(roots, dtype=np.int32)
        if len(self.table) >= _FLAG:
            raise ValueError("the labelled text is too long for one table")

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): phrases of each text; empty texts have none."""
        counts = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        parts = [(i, at) for i, x in enumerate(texts) for at in range(0, len(x), SEGMENT)]
        some = max(1, LANES // len(self.langs))
        carry = None
        for first in range(0, len(parts), some):
            carry = self._segments(texts, parts[first : first + some], counts, carry)
        return counts

    def _segments(self, texts: list[np.ndarray], parts: list[tuple[int, int]], counts: np.ndarray, carry: np.ndarray | None) -> np.ndarray:
        """Adds the phrases that begin in the segments; takes and gives the states before the first and after the last."""
        cut = [texts[i][at : at + SEGMENT] for i, at in parts]
        sizes = np.array([len(x) for x in cut])
        order = np.argsort(-sizes, kind="stable")
        grid = np.full((len(parts), sizes.max()), self.pad, dtype=np.int32)
        for row, k in zip(grid, order.tolist(), strict=True):
            row[: sizes[k]] = self.symbol[cut[k]]
        grid = np.ascontiguousarray(grid.T)
        alive = np.searchsorted(-sizes[order], -np.arange(len(grid)), side="left")  # segments longer than the step
        seen = np.empty((len(grid), len(self.roots), len(parts)), dtype=np.int32)
        state = np.repeat(self.roots[:, None], len(parts), axis=1)
        found = np.zeros(state.shape, dtype=np.int64)
        for t, (step, n) in enumerate(zip(grid, alive.tolist(), strict=True)):
            now = seen[t, :, :n] = self.table[state[:, :n] + step[:n]]
            found[:, :n] += now >> 30
            state[:, :n] = now & (_FLAG - 1)
        # from here on the columns are the parts in their own order
        place = np.empty(len(parts), dtype=np.int64)
        place[order] = np.arange(len(parts))
        plain = state[:, place]
        end, more = plain.copy(), np.zeros(found.shape, dtype=np.int64)
        follows = np.array([at > 0 for _, at in parts])
        lane, part = np.nonzero(np.broadcast_to(follows, plain.shape))
        while len(part):
            before = end[lane, part - 1]
            if carry is not None:
                before = np.where(part == 0, carry[lane], before)
            was = end[lane, part]
            more[lane, part], end[lane, part] = 0, plain[lane, part]
            a, b, now = lane, part, before
            apart = now != self.roots[a]
            t = 0
            while apart.any():
                a, b, now = a[apart], b[apart], now[apart]
                true = self.table[now + grid[t, place[b]]]
                guess = seen[t, a, place[b]]
                more[a, b] += (true >> 30) - (guess >> 30)
                now = true & (_FLAG - 1)
                apart = now != guess & (_FLAG - 1)
                t += 1
                over = sizes[b] == t
                end[a[over & apart], b[over & apart]] = now[over & apart]
                apart &= ~over
            changed = end[lane, part] != was
            lane, part = lane[changed], part[changed] + 1
            on = part < len(parts)
            lane, part = lane[on], part[on]
            on = follows[part]
            lane, part = lane[on], part[on]
        np.add.at(counts, [i for i, _ in parts], (found[:, place] + more).T)
        return end[:, -1]

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        clear = [i for i, x in enumerate(texts) if x and _LETTER.search(x)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        data = [plain_bytes(texts[i]) for i in clear]
        if not clear:
            return langs, scores
        rate = self.phrases(data) * self.bits / np.array([max(1, len(x)) for x in data])[:, None]
        for i, x in zip(clear, rate, strict=True):
            best = int(np.argmin(x))
            rest = np.delete(x, best)
            langs[i] = self.langs[best]
            scores[i] = float(rest.min() / (rest.min() + x[best])) if len(rest) else 1.0
        return langs, scores


def learnable(id_col: Column) -> Column:
    """Rows whose label may be learnt: three quarters, by the checksum of the id; a row without an id isn't one."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 256,
    bytes_per_lang: int = 50_000,
    max_doc: int = 20_000,
    bytes_in_all: int = 400_000,
) -> Model:
    """(language, labelled text) of each language in ``docs``, whose rows may all be learnt from.

    Defined results: null and empty texts and null languages teach nothing; texts that repeat count once for a language;
    a text under several languages teaches each; no row to learn from gives an empty model.
    """
    rows = docs.select(F.col(lang_col).alias("l"), F.substring(text_col, 1, max_doc).alias("x"), F.xxhash64(text_col).alias("h")).where(
        F.col("l").isNotNull() & F.col("x").isNotNull() & (F.length("x") > 0)
    )
    counts = {r["l"]: r["texts"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("texts")).collect()}
    if not counts:
        return []
    draw = F.pmod("h", F.lit(1 << 31)) / F.lit(float(1 << 31))
    order = F.row_number().over(Window.partitionBy("l").orderBy(draw, "h"))

    def first(share: dict[str, float]) -> list:
        """The first texts of each language among those whose draw is below its share."""
        below = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("l"))
        chosen = rows.where(draw < below).select("l", "h").distinct().withColumn("r", order).where(F.col("r") <= docs_per_lang)
        return rows.join(F.broadcast(chosen.select("l", "h")), ["l", "h"]).select("l", "h", "x").distinct().collect()

    # about twice as many different texts as wanted pass by their hash alone, so that what is ordered for a language is
    # bounded too; where fewer than wanted pass, all are ordered, so the sample doesn't depend on the share
    share = {x: min(1.0, (2.0 * docs_per_lang + 64) / max(1, n)) for x, n in counts.items()}
    sample = first(share)
    passed = Counter(x for x, _ in {(r["l"], r["h"]) for r in sample})
    if few := {x: 1.0 for x in counts if share[x] < 1 and passed[x] < docs_per_lang}:
        sample = [r for r in sample if r["l"] not in few] + first(few)
    most = max(1, min(bytes_per_lang, bytes_in_all // len(counts)))
    model = []
    for lang in sorted(counts):
        data = b""
        for r in sorted((r for r in sample if r["l"] == lang), key=lambda r: (r["h"] % (1 << 31), r["h"], r["x"])):
            data += b" " * bool(data) + plain_bytes(r["x"]).tobytes()
            if len(data) >= most:
                break
        if data:
            model.append((lang, data[:most]))
    return model


def identify(
    docs: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """The language of every text: the id column, lang_pred and score (second best rate / (best + second best)).

    With ``carry`` each row comes whole, as the struct ``row``, in place of the id column.

    Defined results: ``und`` and score 0 for a null text, a text without a letter, and where the model has no
    language; ties go to the language that comes first by code point; with one language the score is 1; rows that repeat
    an id are judged each by itself; no rows give no rows. Other columns are ignored, whatever their names.
    """
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        parser = held(key, lambda: Parser(sent.value)) if model_size else None
        for batch in batches:
            texts = (batch.column(0).field(at) if carry else batch.column(1)).to_pylist()
            langs, scores = parser.judge(texts) if parser else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[name, "lang_pred", "score"])

    model_size, name = len(model), "row" if carry else "id"
    if carry:
        at = docs.columns.index(text_col)
        rows = docs.select(F.struct(*[quoted(x) for x in docs.columns]).alias(name))
    else:
        rows = docs.select(F.col(id_col).alias(name), F.col(text_col).alias("text"))
    schema = StructType([rows.schema[name], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    found = map_batches(rows, run, schema, holds=True)
    return found if carry else found.withColumnRenamed(name, id_col)
