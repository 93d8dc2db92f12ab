"""Choosing clusters: flat, or by an index over the centroids (two levels, quantised), which pays from some 20,000 on."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import IndexConfig, SearchConfig
from orrery.operators import clustering, index, knn
from orrery.storage import durable


@dataclass
class Coarse:
    """Inner clusters of centroids and the centroids' codes relative to the inner means."""

    postings: DataFrame
    inner: DataFrame
    norms: DataFrame | None  # (cid, norm) where centroids were made unit vectors, for inner products
    config: IndexConfig
    clusters: int


def inner_count(clusters: int, inner_size: int) -> int:
    return min(max(1, round(clusters / inner_size)), clusters)


def build(cents: DataFrame, config: IndexConfig, inner: DataFrame | None = None, refine: str = "exbits") -> Coarse:
    """Indexes (cid, centroid) for probing; ``inner`` is (cid, inner) if the parting is given, else it comes from k-means.

    For inner products the centroids become unit vectors first, also for the inner means; their norms are kept. With
    ``refine`` "full" the nearest of the scanned centroids are found exactly: centroids stay in double precision, and the
    bounds by which their signs leave some out always hold. With "exbits" both are approximate.
    """
    rows = cents.select(F.col("cid").cast("long").alias("vec_id"), F.col("centroid").cast("array<double>").alias("embedding"))
    norms = None
    if config.metric == "ip":
        norms = rows.select(F.col("vec_id").alias("cid"), knn.norm(F.col("embedding")).alias("norm"))
        rows = rows.withColumn("embedding", knn.normalize(F.col("embedding")))
    n = rows.count()
    if inner is None:
        means = clustering.kmeans(rows, inner_count(n, config.inner_size), 25, seed=config.seed, spherical=config.metric == "ip")
        placed = clustering.assign(rows, means).drop("dist").join(rows, "vec_id")
    else:
        placed = inner.select(F.col("cid").cast("long").alias("vec_id"), F.col("inner").cast("long").alias("cid")).join(rows, "vec_id")
    means = durable(clustering.centroids(placed))
    own = IndexConfig(config.dim, bits=9, seed=config.seed, store="raw" if refine == "full" else "exbits", certain=refine == "full")
    return Coarse(durable(index.to_blocks(index.build(placed, means, own))), means, norms, own, n)


def probe(queries: DataFrame, coarse: Coarse, nprobe: int, mode: str = "kfixedmult", mult: float = 0.5) -> DataFrame:
    """(query_id, rank, cid, dist[, ip, gap]): the nearest clusters by distance to their (unit) centroids.

    ``full`` scans all inner clusters, ``kfixedmult`` the nearest max(1, ceil(mult * nprobe)). Too few clusters for a query
    are an error. With norms kept, ip and gap are the inner product and distance of the query and the true centroid.
    """
    if mode not in ("full", "kfixedmult"):
        raise ValueError("mode is full or kfixedmult")
    parts = coarse.inner.count()
    take, scan = min(nprobe, coarse.clusters), parts if mode == "full" else min(parts, max(1, math.ceil(mult * nprobe)))
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    unit = asked if coarse.norms is None else asked.withColumn("embedding", knn.normalize(F.col("embedding")))
    found = durable(index.search(coarse.postings, unit, coarse.inner, coarse.config, SearchConfig(k=take, nprobe=scan)))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    short = asked.select(F.col("vec_id").alias("query_id")).join(counts, "query_id", "left").where(F.coalesce("n", F.lit(0)) < take)
    if not short.isEmpty():
        raise ValueError(f"too few clusters were scanned: query {short.first()['query_id']} gets fewer than {take}")
    rows = found.select("query_id", "rank", F.col("vec_id").alias("cid"), F.sqrt(F.greatest("dist", F.lit(0.0))).alias("dist"))
    if coarse.norms is None:
        return rows
    q = asked.select(F.col("vec_id").alias("query_id"), knn.norm(F.col("embedding")).alias("qn"))
    rows = rows.join(coarse.norms, "cid").join(q, "query_id")
    ip = (2 - F.col("dist") * F.col("dist")) / 2 * F.col("qn") * F.col("norm")
    gap = F.sqrt(F.greatest(F.lit(0.0), F.col("qn") ** 2 + F.col("norm") ** 2 - 2 * F.col("ip")))
    return rows.withColumn("ip", ip).withColumn("gap", gap).select("query_id", "rank", "cid", "dist", "ip", "gap")


def choose(queries: DataFrame, cents: DataFrame, config: IndexConfig, options: SearchConfig, built: Coarse | None = None) -> DataFrame:
    """(query_id, rank, cid, dist) by the coarse kind that the options, or the number of clusters, ask for."""
    if options.coarse_kind(cents.count()) == "flat":
        return index.probes(queries, cents, options.nprobe)
    found = probe(queries, built or build(cents, config), options.nprobe, options.irq_mode, options.irq_mult)
    return found.select("query_id", "rank", "cid", "dist")
