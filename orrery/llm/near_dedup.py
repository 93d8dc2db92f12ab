"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped edges.

1. Sketch (Arrow, NumPy): every distinct ``k``-word shingle is hashed once; the top bits of the hash choose one of
   ``BANDS * ROWS`` bins and each bin keeps its smallest hash. An empty bin copies the bin that a sequence of random
   probes, the same for all documents, first finds filled (optimal densification).
2. Documents with one and the same shingle set are one class, whose smallest id stands for it; copies go no further.
3. ``ROWS`` bins make a band and equal bands a bucket. A bucket emits edges from a few centres to its members (a star),
   never pairs among members. An edge counts if the full shingle sets have the wanted Jaccard similarity.
4. At first each member meets only the smallest centre of all its buckets, which joins most. Then it meets the centres
   of its other buckets, unless they are of its component already; buckets of at most ``SMALL`` are compared throughout.
   In a last turn a hash chooses two centres of each, so that what links with much of a bucket, but not with its smallest
   member, need not wait for the join.
   What large buckets still have in several components is compared throughout by an exact join: of each set the rarest
   shingles, so many that every set similar enough has one of them, meet, and pairs whose lengths and places in the order
   rule the similarity out are left out, as are pairs whose parity sketches (the parity of the number of shingles on each
   of ``SKETCH`` bits) differ in more bits than the sets may differ in shingles. The order comes from ``CELLS`` counters; none loses a link, whatever they hold.
5. Links are joined to components by alternating large and small stars, O(log n) rounds of a combine and a join.

At similarity 0.75 a link is in no common bucket with probability (1 - 0.75^4)^32 = 5e-6, and is in ten of them on
average; every link in a common bucket is found. Only the texts of classes in shared buckets move, once; edges are pairs of
ids until they meet the sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import replicated, map_batches, release

SHINGLE = 5
BANDS, ROWS = 32, 4
MIN_JACCARD = 75  # per cent
SMALL = 16  # members of a bucket that are all compared
CELLS = 1 << 18  # counters of shingles
BLOCK = 1 << 18  # bytes hashed at once
SKETCH = 512  # bits of a parity sketch

_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)
_UNIT = np.ones(1, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int) -> np.ndarray:
    steps = np.full(BLOCK + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


@lru_cache(maxsize=1)
def _both_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE), _powers(_UNBASE)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the bytes, A-Z lower-cased; a word may be longer than a block."""
    up, down = _both_powers()
    starts, words = [], []
    begin, value, size = 0, 0, 0  # of the word that the last block ended in
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK]
        edge = np.flatnonzero(np.diff(_SPACE[part], prepend=True, append=True))
        first, last = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[part]] * up[: len(part)], out=total[1:])
        sums, first = (total[last] - total[first]) * down[first], first + at
        if size and len(first) and first[0] == at:
            whole = (value + int(sums[0]) * pow(_BASE, size, 2**64)) % 2**64
            sums[0], first[0] = whole, begin
        elif size:
            sums, first, last = np.append(np.uint64(value), sums), np.append(begin, first), np.append(0, last)
        size = 0
        if len(last) and last[-1] == len(part) and at + len(part) < len(data):
            begin, value = int(first[-1]), int(sums[-1])
            size, sums, first = at + len(part) - begin, sums[:-1], first[:-1]
        starts.append(first)
        words.append(sums)
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(starts), _mix(np.concatenate(words))


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """For each text its distinct shingle hashes in order; fewer words than ``k`` are one shingle, none are none."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if size + len(text) > BLOCK and group:
            yield from _sets(group, k)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _sets(group, k)


def _sets(group: list[bytes], k: int):
    sizes = np.array([len(x) + 1 for x in group])
    firsts = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b" ".join(group), dtype=np.uint8)
    start, word = word_hashes(data)
    none = np.zeros(0, dtype=np.uint64)
    bounds = np.searchsorted(start, firsts)
    full = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
    step = [pow(0xD6E8FEB86659FD93, i, 2**64) for i in range(k)]
    for i in range(k):
        full += word[i : i + len(full)] * np.uint64(step[i])
    full = _mix(full)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            few = _UNIT * np.uint64(b - a)
            for w in word[a:b]:
                few = _mix(few * np.uint64(_BASE) + w)
            yield few
        else:
            yield none


def _probes(n: int) -> np.ndarray:
    """Row t: the bin that each of ``n`` bins asks at its t-th attempt."""
    return np.random.default_rng(97).integers(0, n, (64, n))


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash of each non-empty set, densified."""
    bits = int(bins - 1).bit_length()
    low = np.full((len(sets), bins), np.uint64(2**64 - 1))
    filled = np.zeros((len(sets), bins), dtype=bool)
    for i, x in enumerate(sets):
        at = (x >> np.uint64(64 - bits)).astype(np.int64) % bins
        if bins & (bins - 1):
            np.minimum.at(low[i], at, x)
            filled[i, at] = True
        else:  # the sets are sorted, so each bin's first is its smallest
            first = np.flatnonzero(np.diff(at, prepend=-1))
            low[i, at[first]] = x[first]
            filled[i, at[first]] = True
    out = low.copy()
    rows, cols = np.nonzero(~filled)
    probes, t = _probes(bins), 0
    while len(rows):
        if t == len(probes):
            probes = np.concatenate((probes, np.random.default_rng(97 + t).integers(0, bins, (t, bins))))
        ask = probes[t][cols]
        hit = filled[rows, ask]
        out[rows[hit], cols[hit]] = low[rows[hit], ask[hit]]
        rows, cols, t = rows[~hit], cols[~hit], t + 1
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    part = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for j in range(rows):
        key = _mix(key * np.uint64(_BASE) + part[:, :, j])
    return key


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def least_size(percent: int) -> int:
    """Of different sets, the smaller size m, J is m / (m + 1) at most: smaller sets than this link only with their equals."""
    return max(1, -(-percent // (100 - percent))) if percent < 100 else 2**62


def _sketcher(k: int, bands: int, rows: int, percent: int):
    least = least_size(percent)

    def sketch(batches):
        for batch in batches:
            sets = list(shingle_sets(_texts(batch.column(1)), k))
            keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            wide = [i for i, x in enumerate(sets) if len(x) >= least]
            found = band_keys(signatures([sets[i] for i in wide], bands * rows), bands, rows) if wide else []
            of = dict(zip(wide, found, strict=True))
            bucket = pa.array([of[i].view(np.int64) if i in of else None for i in range(len(sets))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys, pa.binary()), bucket],
                names=["id", "n", "key", "bands"],
            )

    return sketch


def _setter(k: int):
    def sets(batches):
        for batch in batches:
            at, part, size = 0, [], 0
            for x in shingle_sets(_texts(batch.column(1)), k):
                part.append(x)
                size += len(x)
                if size > BLOCK:
                    yield _set_rows(batch, at, part)
                    at, part, size = at + len(part), [], 0
            if part:
                yield _set_rows(batch, at, part)

    return sets


def _set_rows(batch: pa.RecordBatch, at: int, part: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).cast(pa.int64()), _lists(part)], names=["cls", "set"])


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root has one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) to (u, root): the smallest node that each node with a link can reach, roots left out."""
    edges = replicated(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while not _is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(low, F.col("u") == F.col("x"))
        edges = replicated(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )
        release(links.sparkSession)
    return edges.select("u", F.col("v").alias("root"))


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (u member, v centre) whose sets are similar enough. The set of the hot side, the centre, comes last."""
    a = sets.select(F.col("cls").alias("u"), F.col("set").alias("a"))
    b = sets.select(F.col("cls").alias("v"), F.col("set").alias("b"))
    both = edges.join(a, "u").join(b, "v").withColumn("i", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("i") * 100 >= (F.size("a") + F.size("b") - F.col("i")) * percent).select("u", "v")


def _joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """Stars (u, root) after more links (u, v): only the roots that links connect are searched for components."""
    of = lambda side: stars.select(F.col("u").alias(side), F.col("root").alias("r" + side))
    near = links.join(of("u"), "u", "left").join(of("v"), "v", "left")
    roots = components(near.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")))
    moved = roots.select(F.col("u").alias("root"), F.col("root").alias("to"))
    kept = stars.join(moved, "root", "left").select("u", F.coalesce("to", "root").alias("root"))
    return replicated(kept.unionByName(roots).distinct())


def near_links(classes: DataFrame, docs: DataFrame, k: int, percent: int, bands: int) -> DataFrame:
    """(cls, n, bands) of classes and (id, text) of documents to (u, root) of linked classes."""
    rows = classes.where(F.col("bands").isNotNull()).select("cls", "n", F.posexplode("bands").alias("band", "b"))
    shared = rows.groupBy("b").agg(F.count("*").alias("c")).where("c > 1")
    # the rotated key is one to one: the join gets exchanges of its own, which AQE can split at a hot bucket
    again = lambda: (F.shiftleft("b", 1).bitwiseXOR(F.shiftrightunsigned("b", 63))).alias("t")
    open_ = replicated(
        rows.select("cls", "n", "band", "b", again()).join(shared.select(again()), "t").select("cls", "n", "band", "b", F.col("cls").alias("root"))
    )
    wanted = open_.select("cls").distinct()
    sets = replicated(
        map_batches(docs.join(wanted, F.col("id") == F.col("cls"), "left_semi"), _setter(k), "cls long, set array<long>")
    )
    stars = docs.sparkSession.createDataFrame([], "u long, root long")
    for turn in range(3):
        open_, stars = _turn(open_, stars, sets, percent, turn)
        if open_.isEmpty():
            return stars
    return _rest(open_, stars, sets, percent)


def _counter(batches):
    for batch in batches:
        values = batch.column(0).flatten().to_numpy().view(np.uint64)
        cells, n = np.unique(values & np.uint64(CELLS - 1), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])


def parity(x: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit integers: is the number of the set's members that fall on it odd.

    Two sketches differ in no more bits than there are members in one set only.
    """
    odd = np.bincount((_mix(x) >> np.uint64(32)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_SKETCHES = [f"p{i}" for i in range(SKETCH // 64)]


def _rarest(sent, percent: int):
    """The shingles of a set, the rarest first, of which one at least is in every set similar enough."""

    def rarest(batches):
        for batch in batches:
            cls, root, sets = (batch.column(i) for i in range(3))
            for at in range(batch.num_rows):
                x = sets[at].values.to_numpy().view(np.uint64)
                first = len(x) - -(-len(x) * percent // 100) + 1
                y = x[np.lexsort((x, sent.value[x & np.uint64(CELLS - 1)]))[:first]]
                same = [pa.array(np.full(len(y), z)) for z in (cls[at].as_py(), root[at].as_py(), len(x), *parity(x).tolist())]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(len(y))), pa.array(y.view(np.int64))], names=["cls", "root", "n", *_SKETCHES, "at", "s"])

    return rarest


def _may(n: Column, m: Column, percent: int) -> list[Column]:
    """What holds for the sizes of sets that are similar enough, and for their sketches if there are any."""
    apart = [F.bit_count(F.col(x).bitwiseXOR(F.col("o" + x))) for x in _SKETCHES]
    total = apart[0]
    for x in apart[1:]:
        total = total + x
    return [F.least(n, m) * 100 >= F.greatest(n, m) * percent, total * (100 + percent) <= (n + m) * (100 - percent)]


def _rest(rows: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compares all that large buckets still have in several components, by an exact join on their rarest shingles.

    Any one order of the shingles gives every link; the rarer the first ones, the fewer the pairs. Sketches of the whole
    sets go with the shingles, so that the join itself leaves out nearly all pairs that aren't similar enough.
    """
    spark = rows.sparkSession
    theirs = replicated(sets.join(rows.groupBy("cls").agg(F.min("root").alias("root")), "cls").select("cls", "root", "set"))
    cells = map_batches(theirs.select("set"), _counter, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, dtype=np.int64)
    often[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(often)
    kinds = ", ".join(f"{x} long" for x in ("cls", "root", "n", *_SKETCHES, "at", "s"))
    rare = replicated(map_batches(theirs, _rarest(sent, percent), kinds))
    sent.destroy()
    other = rare.select(F.col("cls").alias("v"), F.col("root").alias("to"), F.col("n").alias("m"), F.col("at").alias("from"), "s", *(F.col(x).alias("o" + x) for x in _SKETCHES))
    pairs = rare.join(other, "s").where("cls > v AND root <> to")
    for fits in _may(F.col("n"), F.col("m"), percent):
        pairs = pairs.where(fits)
    # what both have from their first common shingle on has to be enough
    pairs = pairs.where(F.least(F.col("n") - F.col("at"), F.col("m") - F.col("from")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent)
    links = replicated(_verified(replicated(pairs.select(F.col("cls").alias("u"), "v").distinct()), sets, percent))
    return stars if links.isEmpty() else _joined(stars, links)


def _turn(rows: DataFrame, stars: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Compares the members of each bucket with a centre of it, and those of small buckets with one another."""
    count = F.count("*").alias("c")
    at = lambda by, place: rows.groupBy("b").agg(*[by(c, place).alias(name) for c, name in (("cls", "v"), ("n", "m"), ("root", "to"))], count)
    if turn < 2:
        centres = at(F.min_by, F.col("cls"))
    else:
        chance = F.struct(F.xxhash64("cls", "b"), F.col("cls"))
        centres = at(F.min_by, chance).unionByName(at(F.max_by, chance))
    if turn == 1:
        few = centres.where(F.col("c") <= SMALL).select("b")
        every = rows.join(few, "b").select("b", F.col("cls").alias("v"), F.col("n").alias("m"), F.col("root").alias("to"), F.lit(0).alias("c"))
        centres = centres.where(F.col("c") > SMALL).unionByName(every)
    pairs = rows.join(centres, "b").where("root <> to")
    pairs = pairs.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * percent)
    if turn == 0:
        pairs = pairs.groupBy("cls").agg(F.min("v").alias("v"))
    edges = pairs.select(F.greatest("cls", "v").alias("u"), F.least("cls", "v").alias("v")).distinct()
    links = replicated(_verified(edges, sets, percent))
    if not links.isEmpty():
        stars = _joined(stars, links)
    left = rows.drop("root").join(stars.select(F.col("u").alias("cls"), "root"), "cls", "left")
    left = left.select("cls", "n", "band", "b", F.coalesce("root", "cls").alias("root"))
    several = left.groupBy("b").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), count).where("lo < hi")
    if turn >= 1:  # small buckets have been compared throughout
        several = several.where(F.col("c") > SMALL)
    left = replicated(left.join(several.select("b"), "b", "left_semi"))
    release(rows.sparkSession)
    return left, stars


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = MIN_JACCARD,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per row of ``docs``: the id column, n_shingles (size of the set), component_id (smallest id that
    links reach) and kept (the id is the component's). Other columns are ignored, whatever their names.

    Defined results: a null text, and one without words, has no shingles and no link: it is its own component; a text
    with fewer words than ``k`` is one shingle; rows that repeat an id are one document and always one component; a row
    with a null id has component_id null and is kept, linked with nothing; no rows give no rows.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketch = replicated(map_batches(plain, _sketcher(k, bands, rows, percent), "id long, n long, key binary, bands array<long>"))
    named = sketch.where("n > 0 AND id IS NOT NULL")
    classes = replicated(
        named.groupBy("key").agg(F.min("id").alias("cls"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    )
    stars = near_links(classes.select("cls", "n", "bands"), plain, k, percent, bands)
    # rows that repeat an id under several sets: their classes are linked as well
    ids = named.select("id", F.col("key").alias("key_of")).distinct().groupBy("id").agg(F.count("*").alias("c"), F.min("key_of").alias("lo"), F.max("key_of").alias("hi")).where("c > 1")
    if not ids.isEmpty():
        names = classes.select("key", "cls")
        twice = named.join(ids.select("id"), "id", "left_semi").select("id", "key").distinct().join(names, "key").select("id", "cls")
        more = twice.groupBy("id").agg(F.min("cls").alias("v")).join(twice, "id").select(F.col("cls").alias("u"), "v")
        stars = components(stars.select("u", F.col("root").alias("v")).unionByName(more))
    roots = classes.select("key", "cls").join(stars, F.col("cls") == F.col("u"), "left")
    roots = roots.select(F.hex("key").alias("h"), F.coalesce("root", "cls").alias("root"))
    linked = named.select("id", "n", F.hex("key").alias("h")).join(roots, "h").select("id", "n", "root")
    alone = sketch.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("root"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("root").alias("component_id"),
        F.col("id").eqNullSafe(F.col("root")).alias("kept"),
    )
