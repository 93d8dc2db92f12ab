"""Sampling, k-means and assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import kernels
from orrery.operators.blocks import BLOCK, lists, local_rows, map_arrow, matrix, packed
from orrery.operators.knn import normalize
from orrery.storage import durable

HASH = 2654435761


def hashed(id_col: Column, seed: int = 0) -> Column:
    """A 32-bit multiplicative hash of an id, which SQL can compute as well."""
    return F.pmod((id_col + seed) * F.lit(HASH), F.lit(1 << 32))


BINS = 1 << 16


def sample_exact(df: DataFrame, n: int, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement (all if there are fewer), by the order of a hash of the id.

    Counts of hash ranges say where the n-th row lies; only ids of that range are ordered, and the sample is a filter.
    """
    h = hashed(F.col(id_col), seed)
    part = F.floor(h / ((1 << 32) // BINS)).cast("int")
    table = df.select(part.alias("b")).groupBy("b").agg(F.count("*").alias("n")).toArrow()
    counts = np.bincount(table.column("b").to_numpy(), weights=table.column("n").to_numpy(), minlength=BINS).astype(np.int64)
    upto = np.cumsum(counts)
    if upto[-1] <= n:
        return df
    edge = int(np.searchsorted(upto, n))
    inside = n - int(upto[edge] - counts[edge])
    if inside == 0:
        return df.where(part < edge)
    last = df.where(part == edge).select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(inside).agg(F.max(F.struct("h", "i")).alias("m")).first()["m"]
    return df.where((h < last["h"]) | (h == last["h"]) & (F.col(id_col) <= last["i"]))


def sample_systematic(df: DataFrame, n: int, rows: int, phase: float = 0.0, id_col: str = "vec_id") -> DataFrame:
    """Rows floor(phase + i * rows / n) of ids 0 to rows - 1: arithmetic on the id, nothing is ordered."""
    i = F.ceil((F.col(id_col) - phase) * n / rows)
    hit = lambda k: (k >= 0) & (k < n) & (F.floor(phase + k * rows / F.lit(float(n))) == F.col(id_col))
    return df.where(hit(i) | hit(i + 1) | hit(i - 1))


def sample_cells(df: DataFrame, cell: str, cap: int, id_col: str = "vec_id", seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of each cell, by the order of a hash of the id."""
    order = Window.partitionBy(cell).orderBy(hashed(F.col(id_col), seed), id_col)
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).drop("r")


def cell_shares(sizes: DataFrame, total: int) -> DataFrame:
    """(cell, n) to share: ``total`` parted in proportion by differences of rounded-down running sums."""
    run = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.floor(F.sum("n").over(run) * total / F.sum("n").over(Window.partitionBy()))
    rows = sizes.withColumn("upto", upto)
    return rows.select("cell", "n", (F.col("upto") - F.coalesce(F.lag("upto").over(Window.orderBy("cell")), F.lit(0))).alias("share"))


def running_sum(rows: DataFrame, key: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows of smaller keys (longs, each there once), by stretches of ``width`` keys."""
    parts = rows.withColumn("stretch", F.floor(F.col(key) / width))
    sums = parts.groupBy("stretch").agg(F.sum(value).alias("s"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("stretch", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("stretch").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(sums, "stretch").withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("stretch", "base")


SUMS = 1 << 26  # bytes of sums that a task holds


class _Sums:
    """Sums and counts of vectors by key, within SUMS bytes."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.sums, self.counts = np.zeros((0, 0)), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, x: np.ndarray, n: np.ndarray) -> None:
        names, own = np.unique(keys, return_inverse=True)
        for name in names.tolist():
            self.at.setdefault(name, len(self.at))
        if len(self.at) > len(self.sums):
            grown = np.zeros((max(len(self.at), 2 * len(self.sums)), x.shape[1]))
            grown[: len(self.sums), : self.sums.shape[1]] = self.sums
            self.sums, self.counts = grown, np.append(self.counts, np.zeros(len(grown) - len(self.counts), dtype=np.int64))
        rows = np.array([self.at[name] for name in names.tolist()])
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(names)))
        self.sums[rows] += np.add.reduceat(x[order], starts, axis=0)
        self.counts[rows] += np.add.reduceat(n[order], starts)

    def full(self) -> bool:
        return self.sums.nbytes > SUMS

    def take(self) -> pa.RecordBatch | None:
        n = len(self.at)
        if not n:
            return None
        out = pa.RecordBatch.from_arrays([pa.array(list(self.at), pa.int64()), lists(self.sums[:n]), pa.array(self.counts[:n])], names=["k", "s", "n"])
        self.__init__()
        return out


def vector_sums(df: DataFrame, schema: str, key_of) -> DataFrame:
    """(k, s, n): sums and counts of vectors by key; ``key_of`` takes a batch to keys, vectors and counts.

    A task sums what it reads; sums of a key meet by a shuffle of one row a task and key, and are added as matrices.
    """

    def partial(batches):
        held = _Sums()
        for batch in batches:
            if batch.num_rows:
                held.add(*key_of(batch))
                if held.full():
                    yield held.take()
        if (last := held.take()) is not None:
            yield last

    def again(batches):
        held = _Sums()
        for batch in batches:
            if batch.num_rows:
                held.add(batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy())
        if (last := held.take()) is not None:
            yield last

    return df.mapInArrow(partial, schema).repartition("k").mapInArrow(again, schema)


_SUMS = "k long, s array<double>, n long"


def sums(df: DataFrame, key: str = "cid", vec_col: str = "embedding") -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vec_col).alias("v"))
    return vector_sums(rows, _SUMS, lambda b: (b.column(0).to_numpy(), matrix(b.column(1)), np.ones(b.num_rows, dtype=np.int64)))


def means(df: DataFrame, key: str = "cid", vec_col: str = "embedding") -> DataFrame:
    """(key, pos, mean, n) of each cluster."""
    rows = sums(df, key, vec_col).select("k", "n", F.posexplode("s").alias("pos", "x"))
    return rows.select(F.col("k").alias(key), "pos", (F.col("x") / F.col("n")).alias("mean"), "n")


def centroids(df: DataFrame, key: str = "cid", vec_col: str = "embedding", trained: DataFrame | None = None) -> DataFrame:
    """(cid, centroid, n): means; clusters without members keep their ``trained`` centroid."""
    rows = sums(df, key, vec_col).select(F.col("k").alias("cid"), F.transform("s", lambda x: x / F.col("n")).alias("centroid"), "n")
    if trained is None:
        return rows
    old = trained.select(F.col("cid").cast("long"), F.col("centroid").cast("array<double>").alias("old"))
    return old.join(rows, "cid", "left").select("cid", F.coalesce("centroid", "old").alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def local_centroids(cents: DataFrame, limit: int = 1 << 28) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix on the driver, to be sent to kernels; refused beyond ``limit`` bytes (then use two levels)."""
    table = cents.select(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if table["n"] * (table["d"] or 0) * 8 > limit:
        raise ValueError("too many centroids to send to every task; assign by two levels")
    return local_rows(cents, "cid", "centroid")


def assign(df: DataFrame, cents: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cid, dist) of the nearest centroid by squared L2, ties to the smaller id."""
    ids, c = local_centroids(cents)
    sent = df.sparkSession.sparkContext.broadcast((ids, c))

    def kernel(col: dict) -> dict:
        ids, c = sent.value
        best, dist = kernels.nearest(matrix(col["v"]), c)
        return {"i": col["i"], "cid": ids[best], "dist": dist}

    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    return map_arrow(rows, kernel, "i long,cid long,dist double").withColumnRenamed("i", id_col)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def lloyd(df: DataFrame, start: DataFrame, steps: int, id_col: str = "vec_id", vec_col: str = "embedding", spherical: bool = False, folder: str | None = None, every: int = 5) -> DataFrame:
    """Centroids after ``steps`` rounds of assigning and averaging. Each round is one pass over the data.

    With a ``folder`` the centroids are written there every ``every`` rounds, and a run that finds some goes on from them.
    """
    spark = df.sparkSession
    ids, c = local_centroids(start.select(F.col("cid").cast("long").alias("cid"), F.col("centroid").cast("array<double>").alias("centroid")))
    n, first = np.zeros(len(ids), dtype=np.int64), 0
    if folder and (saved := checkpoints(spark, folder)):
        first = min(max(saved), steps)
        at = spark.read.parquet(f"{folder}/round-{first:06d}") if first in saved else None
        if at is not None:
            ids, c = local_centroids(at)
            n = at.orderBy("cid").select("n").toArrow().column("n").to_numpy()
    rows = df.select(F.col(vec_col).alias("v"))
    for turn in range(first, steps):
        sent = spark.sparkContext.broadcast(c)

        def key_of(batch, sent=sent):
            x = matrix(batch.column(0))
            return kernels.nearest(x, sent.value)[0], x, np.ones(len(x), dtype=np.int64)

        found = vector_sums(rows, _SUMS, key_of).toArrow()
        sent.destroy()
        c, n = c.copy(), np.zeros(len(ids), dtype=np.int64)
        if len(found):
            at = found.column("k").to_numpy()
            n[at] = found.column("n").to_numpy()
            c[at] = matrix(found.column("s").combine_chunks()) / n[at][:, None]
        if spherical:
            c = unit(c)
        if folder and ((turn + 1) % every == 0 or turn + 1 == steps):
            _frame(spark, ids, c, n).write.mode("overwrite").parquet(f"{folder}/round-{turn + 1:06d}")
    return _frame(spark, ids, c, n)


def _frame(spark, ids: np.ndarray, c: np.ndarray, n: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"cid": ids, "centroid": lists(c), "n": n}))


def checkpoints(spark, folder: str) -> list[int]:
    """Rounds whose centroids are whole in the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/round-*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [int(x.getPath().getParent().getName().removeprefix("round-")) for x in found or ()]


def kmeans(df: DataFrame, clusters: int, steps: int = 25, per_centroid: int = 240, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding", spherical: bool = False, folder: str | None = None) -> DataFrame:
    """Trains on an exact sample of ``per_centroid`` points a cluster, starting from the first points of its order."""
    sample = durable(sample_exact(df.select(id_col, vec_col), clusters * per_centroid, id_col, seed))
    first = sample_exact(sample, clusters, id_col, seed)
    number = first.select(id_col, (F.row_number().over(Window.orderBy(hashed(F.col(id_col), seed), id_col)).cast("long") - 1).alias("cid"))  # of ids alone
    start = first.join(number, id_col).select("cid", F.col(vec_col).cast("array<double>").alias("centroid"))
    if spherical:
        start = start.withColumn("centroid", normalize(F.col("centroid")))
    return lloyd(sample, start, steps, id_col, vec_col, spherical, folder)


def kmeans_local(x: np.ndarray, k: int, steps: int, spherical: bool = False) -> np.ndarray:
    """k-means of a bounded matrix from its first k rows; empty clusters are refilled from the largest, split in two."""
    c = x[:k].copy()
    for turn in range(steps):
        best, _ = kernels.nearest(x, c)
        n = np.bincount(best, minlength=len(c))
        order = np.argsort(best, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], np.searchsorted(best[order], some), axis=0) / n[some][:, None]
        if turn < steps - 1:
            for j in np.flatnonzero(n == 0):
                big = int(n.argmax())
                if n[big] < 2:
                    break
                nudge = np.where(np.arange(x.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
                c[j], c[big] = c[big] * (1 + nudge), c[big] * (1 - nudge)
                n[j], n[big] = n[big] // 2, n[big] - n[big] // 2
        if spherical:
            c = unit(c)
    return c


def two_level_kmeans(
    df: DataFrame, clusters: int, steps: int = 10, cap: int = 256, seed: int = 0, id_col: str = "vec_id", vec_col: str = "embedding", least: int = 1, spherical: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(cells, children): about sqrt(C) cells, then k-means within each cell for its share of the C centroids.

    A cell's training points are at most ``cap`` for each of its children, so a group handed to a task is bounded. A cell
    with fewer than ``least`` points for each child of its share gets as many children as it has points for, at least one.
    """
    cells = kmeans(df, max(1, round(clusters**0.5)), steps, seed=seed, id_col=id_col, vec_col=vec_col, spherical=spherical)
    placed = durable(assign(df, cells, id_col, vec_col).select(id_col, F.col("cid").alias("cell")))
    shares = cell_shares(placed.groupBy("cell").agg(F.count("*").alias("n")), clusters)
    shares = durable(shares.select("cell", F.greatest(F.lit(1), F.least("share", F.floor(F.col("n") / max(1, least)))).alias("share")))
    order = Window.partitionBy("cell").orderBy(hashed(F.col(id_col), seed), id_col)
    chosen = placed.join(shares, "cell").withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("share") * cap)
    train = df.select(id_col, F.col(vec_col).alias("v")).join(chosen, id_col)

    def fit(table: pa.Table) -> pa.Table:
        x, k = matrix(table.column("v").combine_chunks()), table.column("share")[0].as_py()
        c = kmeans_local(x[np.argsort(table.column("r").to_numpy())], k, steps, spherical)
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(c), pa.int64()), "j": pa.array(range(len(c)), pa.int64()), "centroid": lists(c)})

    found = durable(train.select("cell", "share", "r", "v").groupBy("cell").applyInArrow(fit, "cell long, j long, centroid array<double>"))
    starts = running_sum(found.groupBy("cell").agg(F.count("*").alias("m")), "cell", "m", "start").select("cell", "start")
    return cells, found.join(starts, "cell").select("cell", "centroid", (F.col("start") + F.col("j")).cast("long").alias("cid"))


def probe_assign(df: DataFrame, cells: DataFrame, children: DataFrame, probes: int = 8, id_col: str = "vec_id", vec_col: str = "embedding", limit: int = 1 << 28) -> DataFrame:
    """(id, cid, dist): the nearest child among those of the nearest ``probes`` cells.

    Children of up to ``limit`` bytes are sent to the tasks; more meet their cell's points, in blocks, by a join.
    """
    ids, c = local_centroids(cells)
    size = children.select(F.count("*").alias("n"), F.max(F.size("centroid")).alias("d")).first()
    data = df.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"))
    take = min(probes, len(ids))
    if size["n"] * (size["d"] or 0) * 8 > limit:
        return _probe_join(data, ids, c, children, take).withColumnRenamed("i", id_col)
    table = children.select("cid", "cell", F.col("centroid").cast("array<double>").alias("centroid")).toArrow()
    kid, cell, k = table.column("cid").to_numpy(), table.column("cell").to_numpy(), matrix(table.column("centroid").combine_chunks())
    order = np.lexsort((kid, cell))
    kid, k = kid[order], k[order]
    starts = np.searchsorted(cell[order], ids), np.searchsorted(cell[order], ids, side="right")
    sent = df.sparkSession.sparkContext.broadcast((ids, c, kid, k, *starts))

    def kernel(col: dict) -> dict:
        ids, c, kid, k, lo, hi = sent.value
        x = matrix(col["v"])
        row, cell, _ = kernels.smallest(ids, c, x, take, "l2")
        best, dist = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), np.inf)
        for one in np.unique(cell):
            if lo[one] == hi[one]:
                continue
            here = row[cell == one]
            at, d = kernels.nearest(x[here], k[lo[one] : hi[one]])
            new = kid[lo[one] + at]
            closer = (d < dist[here]) | (d == dist[here]) & (new < best[here])
            best[here[closer]], dist[here[closer]] = new[closer], d[closer]
        return {"i": col["i"], "cid": best, "dist": dist}

    return map_arrow(data, kernel, "i long,cid long,dist double").withColumnRenamed("i", id_col)


def _probe_join(data: DataFrame, ids: np.ndarray, c: np.ndarray, children: DataFrame, take: int) -> DataFrame:
    sent = data.sparkSession.sparkContext.broadcast((ids, c))

    def cells_of(col: dict) -> dict:
        ids, c = sent.value
        row, cell, _ = kernels.smallest(ids, c, matrix(col["v"]), take, "l2")
        return {"i": col["i"].take(pa.array(row)), "v": col["v"].take(pa.array(row)), "cell": ids[cell]}

    near = map_arrow(data, cells_of, "i long,v array<double>,cell long").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(1 << 16)))
    points = packed(near.withColumn("part", F.floor(F.col("part") / 64)), ["cell", "part"], ["i"], ["i", "v"])
    kids = packed(children.withColumn("part", F.floor(F.col("cid") / BLOCK)), ["cell", "part"], ["cid"], ["cid", "centroid"]).drop("part")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                i, v, kid, k = (batch.column(x)[row].values.to_numpy() for x in ("i", "v", "cid", "centroid"))
                at, d = kernels.nearest(v.reshape(len(i), -1), k.astype(float).reshape(len(kid), -1))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(kid[at]), pa.array(d)], names=["i", "cid", "dist"])

    found = points.join(kids, "cell").select("i", "v", "cid", "centroid").mapInArrow(run, "i long, cid long, dist double")
    best = found.groupBy("i").agg(F.min(F.struct("dist", "cid")).alias("b"))
    return best.select("i", F.col("b.cid").alias("cid"), F.col("b.dist").alias("dist"))


def probe_sweep(df: DataFrame, cells: DataFrame, children: DataFrame, probes: list[int], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(probes, rows, recall): how often two-level assignment gives the truly nearest child, for each number of cells."""
    truth = durable(assign(df, children.select("cid", "centroid"), id_col, vec_col))
    out = None
    for p in probes:
        one = agreement(probe_assign(df, cells, children, p, id_col, vec_col), truth, id_col).select(F.lit(p).cast("long").alias("probes"), "rows", "recall")
        out = one if out is None else out.unionByName(one)
    return out


def calibrate(points: list[tuple[int, float]], target: int) -> float:
    """Seconds for ``target`` rows from timed runs (rows, seconds): the line of least squares through them, not below the last."""
    if not points:
        raise ValueError("there is nothing to extrapolate from")
    n, s = np.array(points, dtype=float).T
    if len(points) == 1 or np.ptp(n) == 0:
        return float(s[-1] * target / n[-1])
    slope, base = np.polyfit(n, s, 1)
    return float(max(slope * target + base, s[n <= target].max(initial=0.0)))


def imbalance(assigned: DataFrame, clusters: int) -> DataFrame:
    """One row: C * sum(n^2) / sum(n)^2, empty clusters, and min, max, mean and population deviation of the sizes."""
    sizes = assigned.groupBy("cid").agg(F.count("*").alias("n"))
    some = sizes.agg(F.count("*").alias("k"), F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    mean = F.col("s") / clusters
    return some.select(
        (F.col("ss") * clusters / (F.col("s").cast("double") * F.col("s"))).alias("imbalance"),
        (clusters - F.col("k")).alias("empty"),
        F.when(F.col("k") < clusters, F.lit(0)).otherwise(F.col("lo")).cast("long").alias("min_size"),
        F.col("hi").alias("max_size"),
        mean.alias("mean_size"),
        F.sqrt(F.col("ss") / clusters - mean * mean).alias("std_size"),
    )


def agreement(a: DataFrame, b: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(rows, recall): how often two assignments agree."""
    both = a.select(id_col, F.col("cid").alias("x")).join(b.select(id_col, F.col("cid").alias("y")), id_col)
    return both.agg(F.count("*").alias("rows"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("recall"))
