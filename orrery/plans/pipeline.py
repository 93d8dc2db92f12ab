"""Build and evaluation end to end: cluster, ground truth, index, search, result rows. Finished steps are not repeated."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import EvalConfig, IndexConfig, SearchConfig
from orrery.operators import clustering, coarse, evaluate, index, knn


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)


def data_key(*frames: DataFrame) -> str:
    """A short name of vectors' contents: rows and a sum of hashes of each frame."""
    found = []
    for df in frames:
        row = df.select(F.count("*").alias("n"), F.sum(F.xxhash64("vec_id", F.col("embedding").cast("array<float>")).cast("decimal(38,0)")).alias("s")).first()
        found.append((row["n"], str(row["s"])))
    return hashlib.sha1(json.dumps(found).encode()).hexdigest()[:12]


def ensure_truth(base: DataFrame, queries: DataFrame, k: int, metric: str, folder: str, key: str | None = None) -> DataFrame:
    """The k nearest neighbours, computed unless the folder has those of just these vectors, and checked against the base."""
    path = f"{folder}/truth-{metric}-{k}-{key or data_key(base, queries)}"
    if not _exists(base, path):
        knn.exact_knn(base, queries, k, metric).write.mode("overwrite").parquet(path)
    return knn.in_range(base.sparkSession.read.parquet(path), base.agg(F.max("vec_id") + 1).first()[0] or 0)


def ensure_index(base: DataFrame, config: IndexConfig, folder: str, key: str | None = None) -> tuple[str, dict]:
    """The index of a configuration over a base, built unless its folder (named by hashes of both) is complete."""
    named = hashlib.sha1(json.dumps(config.meta(), sort_keys=True).encode()).hexdigest()[:12] + "-" + (key or data_key(base))
    path = f"{folder}/index-{named}"
    seconds = 0.0
    if not _exists(base, f"{path}/meta"):

        def build() -> None:
            clusters = config.clusters(base.count())
            cents = clustering.kmeans(base, clusters, seed=config.seed, spherical=config.metric == "ip", folder=f"{path}/rounds")
            placed = clustering.assign(base, cents).drop("dist").join(base.select("vec_id", "embedding"), "vec_id")
            placed.write.mode("overwrite").parquet(f"{path}/placed")
            placed = base.sparkSession.read.parquet(f"{path}/placed")
            final = clustering.centroids(placed, trained=cents)
            final.write.mode("overwrite").parquet(f"{path}/trained")
            final = base.sparkSession.read.parquet(f"{path}/trained")
            index.save(index.build(placed, final, config), final, config, path)

        _, seconds = evaluate.timed(build)
    return path, {"index_id": named, "system": "orrery", "build_params": json.dumps(config.meta()), "build_s": seconds}


def run(base: DataFrame, queries: DataFrame, config: IndexConfig, folder: str, k: int = 10, evaluation: EvalConfig = EvalConfig(), dataset: str = "", threads: int | None = None) -> DataFrame:  # noqa: B008
    """A result row for each operating point that the recall band asks for."""
    spark = base.sparkSession
    truth = ensure_truth(base, queries, k, config.metric, folder)
    path, _ = ensure_index(base, config, folder)
    blocks, cents, config = index.load(spark, path)
    n, rows = cents.count(), base.count()
    built = coarse.build(cents, config) if SearchConfig().coarse_kind(n) != "flat" else None
    found = lambda p: index.search(blocks, queries, cents, config, SearchConfig(k=k, nprobe=p), built)
    measure = lambda p: knn.recall(found(p), truth, k).first()["recall"]
    points = evaluate.recall_map(spark, evaluate.ladder(k, n, rows), measure, evaluation)
    out = None
    nq = queries.count()
    for p in evaluate.operating_points(points, evaluation):
        answer, seconds = evaluate.timed(lambda p=p: measure(p))
        row = evaluate.result_row(spark, config, SearchConfig(k=k, nprobe=p), {"dataset": dataset, "nq": nq, "recall_at_topk": answer, "qps": nq / seconds, "threads": threads})
        out = row if out is None else out.unionByName(row)
    return out


def grid(base: DataFrame, queries: DataFrame, config: IndexConfig, folder: str, topk: list[int], threads: list[int], evaluation: EvalConfig = EvalConfig(), dataset: str = "") -> DataFrame:  # noqa: B008
    """Result rows of every (k, threads); cells that the folder has already are not run again.

    ``threads`` is how many parts the queries are dealt to, which is how many tasks answer the coarse step at once.
    """
    spark, out = base.sparkSession, None
    key = data_key(base, queries)
    named = hashlib.sha1(json.dumps(config.meta(), sort_keys=True).encode()).hexdigest()[:12]
    for k in topk:
        for t in threads:
            path = f"{folder}/cell-{named}-{key}-k{k}-t{t}"
            if not _exists(base, path):
                run(base, queries.repartition(t), config, folder, k, evaluation, dataset, t).coalesce(1).write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path)
            out = rows if out is None else out.unionByName(rows)
    return out
