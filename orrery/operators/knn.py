"""Exact nearest neighbours, ground truth and its checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.functions import kernels
from orrery.operators.blocks import Best, local_rows, matrix, query_chunks

HIT = "query_id long, vec_id long, dist double"


def ranked(hits: DataFrame, k: int, by: str = "dist") -> DataFrame:
    """(query_id, rank, vec_id, dist): each query's k best; the limit is applied before and after the shuffle."""
    order = Window.partitionBy("query_id").orderBy(by, "vec_id")
    rows = hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", F.col(by).alias("dist"))


def exact_knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k nearest base vectors: (query_id, rank, vec_id, dist), ties by id.

    Queries go to the tasks in parts of bounded size, one pass over the base vectors for each; a task keeps its k best.
    """
    spark, hits = base.sparkSession, None
    dim = (queries.select(F.max(F.size(vec_col))).first()[0] or 1) + 4 * k
    rows = base.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).alias("v"))
    for some in query_chunks(queries, 8 * dim, id_col):
        sent = spark.sparkContext.broadcast(local_rows(some, id_col, vec_col))

        def run(batches, sent=sent):
            qid, q = sent.value
            best = Best(k)
            for batch in batches:
                for at in range(0, batch.num_rows if len(q) else 0, kernels.TILE):
                    part = batch.slice(at, kernels.TILE)
                    ids = part.column(0).to_numpy()
                    j, i, d = kernels.smallest(ids, matrix(part.column(1)), q, k, metric)
                    best.add(qid[j], d, ids[i])
            if found := best.take():
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[2]), pa.array(found[1])], names=["query_id", "vec_id", "dist"])

        part = rows.mapInArrow(run, HIT)
        hits = part if hits is None else hits.unionByName(part)
    return ranked(hits, k)


# --- vectors in expressions


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(a.cast("array<double>"))


# --- ground truth: (query_id, rank, vec_id, dist)


def recall(found: DataFrame, truth: DataFrame, k: int, ties: bool = False) -> DataFrame:
    """(k, queries, hits, recall) of results against ground truth; with ``ties`` every id tied with the k-th counts."""
    n = truth.select("query_id").distinct().agg(F.count("*").alias("queries"))
    if ties:
        last = truth.where(F.col("rank") == k).select("query_id", F.col("dist").alias("edge"))
        good = truth.join(last, "query_id", "left").where((F.col("rank") <= k) | (F.col("dist") <= F.col("edge")))
    else:
        good = truth.where(F.col("rank") <= k)
    hits = found.where(F.col("rank") <= k).join(good.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").agg(F.count("*").alias("hits"))
    return hits.crossJoin(n).select(F.lit(k).cast("long").alias("k"), "queries", "hits", (F.col("hits") / (F.col("queries") * k)).alias("recall"))


def tie_windows(truth: DataFrame, k: int) -> DataFrame:
    """Per query: ids at the distance of the k-th (from rank k on), and whether the list ends within the tie."""
    by = Window.partitionBy("query_id")
    edge = F.max(F.when(F.col("rank") == k, F.col("dist"))).over(by)
    end = F.max(F.struct("rank", "dist")).over(by)
    rows = truth.withColumn("edge", edge).withColumn("depth", end["rank"]).withColumn("last", end["dist"])
    return rows.groupBy("query_id").agg(
        F.sum(((F.col("rank") >= k) & (F.col("dist") == F.col("edge"))).cast("long")).alias("tie_window"),
        F.max("depth").cast("long").alias("depth"),
        F.max(F.coalesce(F.col("last") == F.col("edge"), F.lit(False))).alias("saturated"),
    )


def ascending(truth: DataFrame, slack: float = 1e-6) -> DataFrame:
    """(bad_rows, worst_drop, example): queries whose distances fall by more than ``slack`` somewhere, the smallest of them."""
    step = F.col("dist") - F.lag("dist").over(Window.partitionBy("query_id").orderBy("rank"))
    per = truth.withColumn("step", step).groupBy("query_id").agg(F.min("step").alias("low"))
    bad = F.coalesce("low", F.lit(0.0)) < -slack
    return per.agg(F.sum(bad.cast("long")).alias("bad_rows"), F.least(F.min("low"), F.lit(0.0)).alias("worst_drop"), F.min(F.when(bad, F.col("query_id"))).alias("example"))


def tie_stats(truth: DataFrame) -> DataFrame:
    """Per query: different distances, the longest run of equal ones, and ids listed more than once."""
    runs = truth.groupBy("query_id", "dist").agg(F.count("*").alias("run"))
    a = runs.groupBy("query_id").agg(F.count("*").alias("distinct_dists"), F.max("run").alias("longest_run"))
    b = truth.groupBy("query_id").agg((F.count("*") - F.countDistinct("vec_id")).alias("duplicate_ids"))
    return a.join(b, "query_id")


def tie_groups(truth: DataFrame, base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Per query: base vectors closer than its k-th neighbour, tied with it (as floats), and the depth that shows all."""
    edge = truth.where(F.col("rank") == k).select("query_id", F.col("dist").cast("float").alias("edge"))
    vector = F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("edge").cast("double")))
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding").join(edge, "query_id").select(F.col("query_id").alias("vec_id"), vector.alias("v"))
    spark, counts = base.sparkSession, None
    dim = asked.select(F.max(F.size("v"))).first()[0] or 1
    for some in query_chunks(asked, 8 * dim):
        sent = spark.sparkContext.broadcast(local_rows(some, "vec_id", "v"))

        def run(batches, sent=sent):
            qid, q = sent.value
            closer, tied = np.zeros(len(qid), dtype=np.int64), np.zeros(len(qid), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows if len(q) else 0, kernels.TILE):
                    a, b = _against(matrix(batch.slice(at, kernels.TILE).column(0)), q[:, :-1], q[:, -1])
                    closer, tied = closer + a, tied + b
            if len(qid):
                yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(closer), pa.array(tied)], names=["query_id", "closer", "tied"])

        part = base.select("embedding").mapInArrow(run, "query_id long, closer long, tied long")
        counts = part if counts is None else counts.unionByName(part)
    summed = counts.groupBy("query_id").agg(F.sum("closer").alias("closer"), F.sum("tied").alias("tied"))
    return summed.withColumn("depth_needed", F.col("closer") + F.col("tied"))


def _against(x: np.ndarray, q: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per query: vectors closer than its edge, and at it, as floats; those near the edge are compared exactly."""
    d, last = kernels.distances(x, q, "l2"), edge.astype(np.float32)
    near = np.abs(d - edge) <= 1e-6 * (1 + np.abs(edge)) + kernels.slack(x, q)
    closer = ((d < edge) & ~near).sum(0)
    i, j = np.nonzero(near)
    exact = kernels.paired(x[i], q[j], "l2").astype(np.float32)
    add = lambda hit: np.bincount(j[hit], minlength=len(q))
    return closer + add(exact < last[j]), add(exact == last[j])


def verdict(truth: DataFrame, k: int) -> DataFrame:
    """(status, bad_rows, saturated, duplicates): fail for falling distances or repeated ids, warn for saturated ties."""
    a = ascending(truth).select("bad_rows")
    b = tie_windows(truth, k).agg(F.sum(F.col("saturated").cast("long")).alias("saturated"))
    c = tie_stats(truth).agg(F.sum("duplicate_ids").alias("duplicates"))
    status = F.when((F.col("bad_rows") > 0) | (F.col("duplicates") > 0), "fail").when(F.col("saturated") > 0, "warn").otherwise("ok")
    return a.crossJoin(b).crossJoin(c).select(status.alias("status"), "bad_rows", "saturated", "duplicates")


def distance_ratio(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: mean of sqrt(found / true) over ranks whose true distance isn't nearly zero, times k."""
    both = found.where(F.col("rank") <= k).select("query_id", "rank", F.col("dist").alias("ann")).join(truth.select("query_id", "rank", F.col("dist").alias("gt")), ["query_id", "rank"])
    good = both.where("gt > 1e-5")
    return good.groupBy("query_id").agg((F.sum(F.sqrt(F.col("ann") / F.col("gt"))) * k / F.count("*")).alias("ratio"))


def out_of_range(truth: DataFrame, rows: int) -> DataFrame:
    """(bad_ids, bad_queries, largest): ids of the ground truth that a base of ``rows`` vectors, numbered from 0, doesn't have."""
    bad = (F.col("vec_id") < 0) | (F.col("vec_id") >= rows)
    return truth.agg(F.sum(bad.cast("long")).alias("bad_ids"), F.countDistinct(F.when(bad, F.col("query_id"))).alias("bad_queries"), F.max(F.when(bad, F.col("vec_id"))).alias("largest"))


def in_range(truth: DataFrame, rows: int) -> DataFrame:
    """The ground truth, unless it names ids that a base of ``rows`` vectors doesn't have: that stops the run."""
    found = out_of_range(truth, rows).first()
    if found["bad_ids"]:
        raise ValueError(f"{found['bad_ids']} ids of the ground truth are not among the {rows} base vectors, {found['largest']} for one")
    return truth


MARGIN = 50  # times the rounding floor


def margins(truth: DataFrame, base: DataFrame, k: int, depth: int) -> DataFrame:
    """Per query: the margin between the distances at ranks ``depth`` and ``k``, and the floor under which differences of
    squared distances cancel in single precision, squared norm of the k-th neighbour times 2^-24; ``thin`` below MARGIN floors."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    per = truth.groupBy("query_id").agg((at(depth) - at(k)).alias("margin"))
    last = truth.where(F.col("rank") == k).select("query_id", "vec_id")
    size = base.select("vec_id", (dot(F.col("embedding"), F.col("embedding")) * 2.0**-24).alias("floor"))
    rows = per.join(last, "query_id").join(size, "vec_id")
    return rows.select("query_id", "margin", "floor", F.coalesce(F.col("margin") < F.col("floor") * MARGIN, F.lit(False)).alias("thin"))


def others(base: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, vec_id, dist): each vector's k nearest other vectors."""
    found = exact_knn(base, base, k + 1, metric).where("query_id <> vec_id")
    return ranked(found.drop("rank"), k)
