"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the different words of a text and their beginnings is trained on labelled rows. (Beginnings, of 3 to
8 letters, carry stems over to inflections that no labelled text has.) Besides the labels' loss, each sentence that names an identity group is scored again with the name swapped for others of its kind, and the squared
difference of the two scores is penalised (``swap_weight``), so that naming a group moves no score by itself.

What is learnt from is a bounded sample: at most ``per_label`` texts for each label, in the order of a hash of the id;
weights restore the share of each label among all labelled rows. Only words whose counts differ significantly between
the labels are features (``min_z``, ``min_docs``), so a long text doesn't drift by the sum of thousands of neutral
words; identity terms are always features, so that the penalty binds them. Scoring reads whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import map_batches

# Names of groups by kind; a swap stays within its kind.
IDENTITY = {
    "religion": ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    "people of a religion": ("christians", "jews", "muslims", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    "gender": ("woman", "man"),
    "genders": ("women", "men"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    "origin": ("african", "asian", "european", "american", "arab", "mexican", "indian", "chinese", "black", "white", "latino"),
    "femme": ("femme", "homme"),
    "religion, fr": ("chrétien", "juif", "musulman", "bouddhiste", "athée"),
    "frau": ("frau", "mann"),
    "religion, de": ("christ", "jude", "moslem", "buddhist"),
    "mujer": ("mujer", "hombre"),
    "religion, es": ("cristiano", "judío", "musulmán", "budista", "ateo"),
}
STEMS = (3, 4, 5, 6, 7, 8)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_KIND = {w: kind for kind, words in IDENTITY.items() for w in words}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swaps(text: str | None) -> list[tuple[frozenset[str], frozenset[str]]]:
    """For each sentence that names a group: its words, and its words under each other name of the kind."""
    found = []
    for sentence in _SENTENCE.findall((text or "").lower()):
        words = frozenset(_WORD.findall(sentence))
        for name in sorted(words & _KIND.keys()):
            found += [(words, words - {name} | {other}) for other in IDENTITY[_KIND[name]] if other not in words]
    return found


def parts_of(word: str) -> list[str]:
    """The word as a whole and its beginnings; the mark ^ is in no word."""
    return [word, *("^" + word[:n] for n in STEMS if n <= len(word))]


class Model:
    """A bias and a weight for each feature; a text's score follows from the sum over its different words."""

    def __init__(self, bias: float, weights: dict[str, float]) -> None:
        self.bias, self.weights = bias, weights
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.bias, self.weights)

    def weight(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            found = self.known[word] = math.fsum(self.weights.get(x, 0.0) for x in parts_of(word))
        return found

    def score(self, text: str | None) -> float:
        x = self.bias + math.fsum(map(self.weight, words_of(text)))
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def _features(rows: list[tuple[set[str], int]], min_docs: int, min_z: float) -> list[str]:
    """Features whose share of texts differs between the labels by ``min_z`` standard errors."""
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    one, all_ = Counter(), Counter()
    for words, y in rows:
        found = {x for w in words for x in parts_of(w)}
        all_.update(found)
        if y:
            one.update(found)
    kept = []
    for w, n in all_.items():
        p = n / len(rows)
        error = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        if n >= min_docs and abs(one[w] / n1 - (n - one[w]) / n0) > min_z * error:
            kept.append(w)
    return kept


def train(
    texts: list[tuple[str, int]],
    share: float | None = None,
    swap_weight: float = 4.0,
    ridge: float = 0.3,
    min_docs: int = 5,
    min_z: float = 6.0,
    rounds: int = 200,
) -> Model:
    """Fits labelled texts; ``share`` is the share of label 1 that the scores are to reflect (the texts' own if None)."""
    rows = [(words_of(t), int(y)) for t, y in texts]
    n1 = sum(y for _, y in rows)
    if not rows or n1 in (0, len(rows)):  # one label only: its smoothed share
        p = (n1 + 0.5) / (len(rows) + 1)
        return Model(math.log(p / (1 - p)), {})
    seen = set().union(*(w for w, _ in rows))
    names = sorted({*_features(rows, min_docs, min_z), *(_KIND.keys() & seen)})
    at = {w: i for i, w in enumerate(names)}
    index = lambda words: np.array([at[x] for w in words for x in parts_of(w) if x in at], dtype=np.int64)
    matrix = _Sparse([index(w) for w, _ in rows], len(names))
    y = np.array([y for _, y in rows], dtype=float)
    q = n1 / len(rows) if share is None else min(max(share, 1e-6), 1 - 1e-6)
    gain = np.where(y == 1, q * len(rows) / n1, (1 - q) * len(rows) / (len(rows) - n1))
    pairs = Counter(p for t, _ in texts for p in swaps(t))
    first, second = (_Sparse([index(p[i]) for p in pairs], len(names)) for i in (0, 1))
    times = np.array([c for c in pairs.values()], dtype=float) * swap_weight / max(1, len(rows))
    loss = Loss(matrix, y, gain, first, second, times, ridge)
    x = np.append(np.zeros(len(names)), math.log(q / (1 - q)))
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for t in range(1, rounds + 1):
        g = loss.gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(float(x[-1]), {n: float(w) for n, w in zip(names, x[:-1], strict=True) if abs(w) > 1e-4})


class Loss:
    """Of weights and, last, the bias: weighted log loss, half the ridge, and the squared score changes of swaps."""

    def __init__(self, texts: _Sparse, y: np.ndarray, gain: np.ndarray, first: _Sparse, second: _Sparse, times: np.ndarray, ridge: float) -> None:
        self.texts, self.y, self.gain, self.first, self.second, self.times, self.ridge = texts, y, gain, first, second, times, ridge

    def value(self, x: np.ndarray) -> float:
        z = self.texts.dot(x[:-1]) + x[-1]
        gap = _sigmoid(self.first.dot(x[:-1]) + x[-1]) - _sigmoid(self.second.dot(x[:-1]) + x[-1])
        return float(((np.logaddexp(0, z) - self.y * z) * self.gain).mean() + self.ridge / 2 * (x[:-1] ** 2).sum() / len(self.y) + (self.times * gap**2).sum())

    def gradient(self, x: np.ndarray) -> np.ndarray:
        w, bias = x[:-1], x[-1]
        off = (_sigmoid(self.texts.dot(w) + bias) - self.y) * self.gain / len(self.y)
        a, b = _sigmoid(self.first.dot(w) + bias), _sigmoid(self.second.dot(w) + bias)
        up, down = 2 * self.times * (a - b) * a * (1 - a), 2 * self.times * (a - b) * b * (1 - b)
        g = self.texts.spread(off) + self.ridge * w / len(self.y) + self.first.spread(up) - self.second.spread(down)
        return np.append(g, off.sum() + up.sum() - down.sum())


class _Sparse:
    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(rows), width
        self.cols = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        self.rows = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n)

    def spread(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=x[self.rows], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(id_col: Column) -> Column:
    """A fifth of the rows, by the checksum of the id; a null id isn't one."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_label: int = 4000,
    max_doc: int = 10_000,
) -> tuple[list[tuple[str, int]], float]:
    """Labelled texts, at most ``per_label`` of each label and ``max_doc`` characters each, and the share of label 1.

    Ids are chosen first, so of the texts only the sample moves; the chosen ids, which are bounded, are broadcast. A
    row with a null id or label isn't labelled; of labels that contradict each other the larger counts.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))
    )
    named = named.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # a little more than wanted passes by its hash alone, so that what is ordered for a label is bounded too
    wanted = per_label + 6 * per_label**0.5
    share = lambda y: min(1.0, wanted / max(1, counts.get(y, 0)))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / F.lit(float(1 << 31))
    few = named.where(draw < F.when(F.col("y") == 1, share(1)).otherwise(share(0)))
    order = F.row_number().over(Window.partitionBy("y").orderBy(draw, "id"))
    chosen = few.withColumn("r", order).where(F.col("r") <= per_label).select("id", "y")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x")).where(F.length("x") <= max_doc)
    found = rows.join(F.broadcast(chosen), "id").select("id", "x", "y").collect()
    found = sorted((r["id"], r["x"], r["y"]) for r in found)
    return [(x, y) for _, x, y in found], counts.get(1, 0) / max(1, sum(counts.values()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, score and predicted (1 from 0.5 on) of every whole text.

    Defined results: null and empty texts get the score of a text without any known word; rows that repeat are scored
    each, alike; no rows give no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches):
        for batch in batches:
            made = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.float64()), pa.array([int(x >= 0.5) for x in made], pa.int32())], names=["id", "score", "predicted"]
            )

    return map_batches(rows, run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
