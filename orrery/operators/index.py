"""Building an inverted index of rotated binary and extra-bit codes, and searching it.

Tables: ``centroids`` (cid, centroid, n); ``blocks``, a row for each stretch of BLOCK places of a cluster (cid, block), its
vectors' columns joined to matrices: vec_id, page_id, then resident columns, then payload columns; ``meta`` (one row).

A search takes queries in parts of bounded size, which every task gets with the clusters they probe; index rows are neither
shuffled nor grouped. Scans are limited to the probed clusters by ranges of cid, which Parquet's statistics understand. Two
passes read resident columns only: the first gives each task's best estimates, the second the blocks that hold points whose
lower bound doesn't exceed a query's threshold. Payload columns are read for the blocks that hold seeds or survivors; a task takes a
block's queries in tiles and keeps each query's best, so pairs of queries and survivors are neither stored nor shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.config import IndexConfig, SearchConfig, page_layout
from orrery.functions import kernels
from orrery.operators.blocks import BLOCK, QUERY_BYTES, Best, bytes_of, lists, local_rows, map_arrow, matrix, packed, query_chunks
from orrery.operators.clustering import local_centroids, running_sum
from orrery.operators.knn import ranked
from orrery.storage import durable

RESIDENT = "bits binary,f_add double,f_rescale double,f_error double"
PAYLOAD = "rest binary,ex_code binary,f_add_ex double,f_rescale_ex double,raw array<float>"
RANGES = 32  # of cids in a scan's filter
LISTED = 1000  # cids that a filter names one by one
QUERIES = 1024  # that meet the points of a block at once
PAIRS = 1 << 20  # coordinates of pairs of points and queries that are compared at once
SENT_BLOCKS = 1 << 20  # names of blocks that a join sends to every task


def _places(ids: np.ndarray, cid: pa.Array) -> np.ndarray:
    """Rows of the sorted ``ids`` for each cid; one that isn't there is an error."""
    named = cid.to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, named), len(ids) - 1)
    if len(ids) == 0 or (ids[at] != named).any():
        raise ValueError(f"cluster {named[ids[at] != named][0] if len(ids) else named[0]} has no centroid")
    return at


def places(assigned: DataFrame, cents: DataFrame, metric: str = "l2") -> DataFrame:
    """(vec_id, cid, d, pos): distance to the centroid (negative inner product for ip) and place in the cluster by it, NaN
    last, then id.

    ``assigned`` is (vec_id, cid, embedding). A cid without a centroid is an error. Only ids and distances are shuffled; a
    cluster is ordered in parts by distance, so a hot one isn't a single task.
    """
    ids, c = local_centroids(cents)

    def kernel(col: dict) -> dict:
        x, at = matrix(col["embedding"]), _places(ids, col["cid"])
        d = kernels.paired(x, c[at], "l2") if metric == "l2" else kernels.paired(x, c[at], "ip") - 1
        return {"vec_id": col["vec_id"], "cid": col["cid"], "d": d}

    rows = assigned.select(F.col("vec_id").cast("long"), F.col("cid").cast("long"), F.col("embedding").cast("array<float>"))
    light = durable(map_arrow(rows, kernel, "vec_id long,cid long,d double"))
    ends = light.groupBy("cid").agg(F.min("d").alias("lo"), F.max(F.when(~F.isnan("d"), F.col("d"))).alias("hi"), F.count("*").alias("n"))
    share = (F.col("d") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    parts = F.ceil(F.col("n") / ORDERED)
    part = F.when(F.isnan("d"), parts + 1).otherwise(F.floor(F.least(share, F.lit(1.0)) * parts)).cast("long")
    placed = light.join(ends, "cid").select("vec_id", "cid", "d", part.alias("part"))
    before = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("cid", "part").agg(F.count("*").alias("n")).select("cid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("cid", "part").orderBy(F.isnan("d"), "d", "vec_id")
    found = placed.withColumn("r", F.row_number().over(order)).join(starts, ["cid", "part"])
    return found.select("vec_id", "cid", "d", (F.col("start") + F.col("r") - 1).cast("long").alias("pos"))


def centroid_order(assigned: DataFrame, cents: DataFrame, metric: str = "l2") -> DataFrame:
    """Adds d and pos of ``places`` to (vec_id, cid, embedding)."""
    rows = assigned.select(F.col("vec_id").cast("long"), F.col("cid").cast("long"), F.col("embedding").cast("array<float>"))
    return rows.join(places(rows, cents, metric), ["vec_id", "cid"])


ORDERED = 1 << 16  # places of a cluster that one task orders, where distances are spread evenly


def page_table(sizes: DataFrame, record: int) -> DataFrame:
    """(cid, n) to first_page and pages of each cluster."""
    per_read, pages = page_layout(record)
    return running_sum(sizes.withColumn("pages", F.ceil(F.col("n") / per_read) * pages), "cid", "pages", "first_page")


def build(assigned: DataFrame, cents: DataFrame, config: IndexConfig) -> DataFrame:
    """Postings of an index: each vector's codes and factors relative to its centroid."""
    ids, c = local_centroids(cents)
    rotation = kernels.rotation_matrix(config.dim, config.seed)
    turned = c @ rotation
    m, e, raw = config.prefix, config.ex_bits, config.store == "raw"
    number, kind = ("double", pa.float64()) if config.certain else ("float", pa.float32())
    scale = kernels.constant_rescale(config.width, e, config.seed) if config.faster and e else None

    def kernel(col: dict) -> dict:
        x = matrix(col["embedding"]) @ rotation
        near = turned[_places(ids, col["cid"])]
        bits, add, rescale, error = kernels.onebit(x, near, config.metric, None if config.certain else m, config.certain)
        signs = np.packbits(bits, axis=1)
        out = {n: col[n] for n in ("vec_id", "cid")}
        out |= {"bits": bytes_of(signs[:, : m // 8]), "f_add": add, "f_rescale": rescale, "f_error": error}
        none = pa.nulls(len(x), pa.binary())
        out |= {"rest": none if raw else bytes_of(signs[:, m // 8 :]), "raw": col["embedding"] if raw else pa.nulls(len(x), pa.list_(kind))}
        if e:
            code, add, rescale = kernels.ex_codes(x, near, e, config.metric, scale)
            out |= {"ex_code": bytes_of(kernels.pack_codes(code, e)), "f_add_ex": add, "f_rescale_ex": rescale}
        else:
            out |= {"ex_code": none, "f_add_ex": pa.nulls(len(x), pa.float64()), "f_rescale_ex": pa.nulls(len(x), pa.float64())}
        return out

    rows = assigned.select(F.col("vec_id").cast("long"), F.col("cid").cast("long"), F.col("embedding").cast(f"array<{number}>"))
    coded = map_arrow(rows, kernel, f"vec_id long,cid long,{RESIDENT},{PAYLOAD}".replace("raw array<float>", f"raw array<{number}>"))
    at = places(rows, cents, config.metric).select("vec_id", "cid", "pos")
    per_read, pages = page_layout(config.record_bytes())
    table = page_table(rows.groupBy("cid").agg(F.count("*").alias("n")), config.record_bytes()).select("cid", "first_page")
    return coded.join(at, ["vec_id", "cid"]).join(table, "cid").withColumn("page_id", F.col("first_page") + F.floor(F.col("pos") / per_read) * pages).drop("first_page")


_PACKED = ["vec_id", "page_id", *[x.split()[0] for x in f"{RESIDENT},{PAYLOAD}".split(",")]]


def to_blocks(postings: DataFrame, ranged: bool = False) -> DataFrame:
    """Postings to blocks: a row for each BLOCK places of a cluster. What are blocks already stays as it is."""
    if "block" in postings.columns:
        return postings
    return packed(postings.withColumn("block", F.floor(F.col("pos") / BLOCK)), ["cid", "block"], ["pos"], _PACKED, ranged)


def fingerprint(cents: DataFrame) -> int:
    """A hash of the centroids in the order of their ids; two artifacts pair only if theirs agree."""
    digest = cents.select(F.sum(F.xxhash64("cid", "centroid").cast("decimal(38,0)")).alias("s")).first()["s"]
    return int(digest or 0)


def save(postings: DataFrame, cents: DataFrame, config: IndexConfig, path: str) -> None:
    """Writes the tables; blocks are range-partitioned and sorted by cid, so row groups prune by it without a file a cluster."""
    to_blocks(postings, ranged=True).write.option("parquet.block.size", ROW_GROUP).mode("overwrite").parquet(f"{path}/blocks")
    cents.write.mode("overwrite").parquet(f"{path}/centroids")
    meta = config.meta() | {"fingerprint": str(fingerprint(cents)), "clusters": cents.count()}
    postings.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


ROW_GROUP = 16 << 20


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, IndexConfig]:
    """Blocks, centroids and configuration; refuses centroids that don't belong to the index."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    cents = spark.read.parquet(f"{path}/centroids")
    if str(fingerprint(cents)) != meta["fingerprint"]:
        raise ValueError("the centroids aren't those of the index")
    config = IndexConfig(**{k: v for k, v in meta.items() if k in IndexConfig.__dataclass_fields__})
    pair(cents, config)
    return spark.read.parquet(f"{path}/blocks"), cents, config


def pair(vectors: DataFrame, config: IndexConfig, vec_col: str = "centroid") -> None:
    """Refuses centroids or queries whose dimension isn't the index's."""
    dims = vectors.select(F.min(F.size(vec_col)).alias("lo"), F.max(F.size(vec_col)).alias("hi")).first()
    if dims["lo"] is not None and (dims["lo"] != config.dim or dims["hi"] != config.dim):
        raise ValueError(f"vectors have {dims['lo']} to {dims['hi']} dimensions, the index has {config.dim}")


def probes(queries: DataFrame, cents: DataFrame, nprobe: int) -> DataFrame:
    """(query_id, rank, cid, dist): each query's nearest clusters by L2 distance, for either metric. A shortfall is an error."""
    ids, c = local_centroids(cents)
    take = min(nprobe, len(ids))
    if take < 1:
        raise ValueError("there are no clusters to probe")

    def kernel(col: dict) -> dict:
        q = matrix(col["v"])
        j, i, d = kernels.smallest(ids, c, q, take, "l2")
        return {"query_id": col["i"].to_numpy()[j], "rank": np.tile(np.arange(1, take + 1), len(q)), "cid": ids[i], "dist": np.sqrt(d)}

    rows = queries.select(F.col("vec_id").cast("long").alias("i"), F.col("embedding").alias("v"))
    return map_arrow(rows, kernel, "query_id long,rank long,cid long,dist double")


@dataclass
class Asked:
    """A part of the queries and the clusters that they probe, as every task gets them."""

    ids: np.ndarray
    q: np.ndarray  # as given
    cids: np.ndarray  # probed by any, sorted
    starts: np.ndarray  # of each cid's stretch of ``rows``
    rows: np.ndarray  # of ``ids``
    centroids: np.ndarray  # of ``cids``
    tau: np.ndarray | None = None
    last: np.ndarray | None = None  # distances of the k-th seeds, which nothing in the result exceeds
    seeds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] | None = None  # queries and places by cid and block

    def of(self, cid: int) -> tuple[int, np.ndarray]:
        """Place of a cluster and the queries that probe it."""
        at = int(np.searchsorted(self.cids, cid))
        if at == len(self.cids) or self.cids[at] != cid:
            return -1, self.rows[:0]
        return at, self.rows[self.starts[at] : self.starts[at + 1]]


def only(cid: Column, cids: np.ndarray) -> Column:
    """Is ``cid`` in the sorted ``cids``: by a few ranges, which reach the statistics of files, and by name if they aren't many."""
    if not len(cids):
        return F.lit(False)
    gaps = np.diff(cids)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: RANGES - 1])
    cuts = cuts[gaps[cuts] > 1] + 1
    within = None
    for a, b in zip([0, *cuts], [*cuts, len(cids)], strict=True):
        part = cid.between(int(cids[a]), int(cids[b - 1]))
        within = part if within is None else within | part
    return within & cid.isin([int(x) for x in cids]) if len(cids) <= LISTED else within


def asked(queries: DataFrame, cents: DataFrame, options: SearchConfig, dim: int, config: IndexConfig | None = None, coarse=None) -> list[Asked]:
    """The queries in bounded parts with their probes, by the coarse kind that the options ask for.

    ``coarse`` is an index over the centroids that was built before; without it one is built where the kind asks for one.
    """
    kind = options.coarse_kind(cents.count())
    if kind != "flat" and coarse is None:
        from orrery.operators import coarse as two_level

        coarse = two_level.build(cents, config or IndexConfig(dim))
    found = []
    for some in query_chunks(queries, 8 * dim + 24 * (options.k + options.nprobe)):
        ids, q = local_rows(some)
        if not len(ids):
            continue
        if kind == "flat":
            near = probes(some, cents, options.nprobe)
        else:
            from orrery.operators import coarse as two_level

            near = two_level.probe(some, coarse, options.nprobe, options.irq_mode, options.irq_mult)
        table = near.select("query_id", "cid").toArrow()
        cid, row = table.column("cid").to_numpy(), np.searchsorted(ids, table.column("query_id").to_numpy())
        least = np.bincount(row, minlength=len(ids)).min()
        if least < 1:
            raise ValueError("a query got no cluster to probe")
        order = np.lexsort((row, cid))
        cids, starts = np.unique(cid[order], return_index=True)
        at, c = local_centroids(cents.where(only(F.col("cid"), cids)), QUERY_BYTES * 4)
        found.append(Asked(ids, q, cids, np.append(starts, len(cid)), row[order], c[np.searchsorted(at, cids)]))
    return found


def search_raw(base: DataFrame, queries: DataFrame, cents: DataFrame, nprobe: int, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances to all members of the probed clusters; ``base`` is (vec_id, cid, embedding).

    Base rows are neither grouped nor shuffled: a task keeps each query's best of what it reads.
    """
    spark, hits = base.sparkSession, None
    dim = queries.select(F.max(F.size("embedding"))).first()[0] or 1
    for some in asked(queries, cents, SearchConfig(k=k, nprobe=nprobe, coarse="flat"), dim):
        sent = spark.sparkContext.broadcast(some)

        def run(batches, sent=sent):
            a, best = sent.value, Best(k)
            for batch in batches:
                cid, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = matrix(batch.column(2)) if len(cid) else None
                for one in np.unique(cid):
                    rows = a.of(int(one))[1]
                    here = np.flatnonzero(cid == one)
                    if len(rows):
                        j, i, d = kernels.smallest(ids[here], x[here], a.q[rows], k, metric)
                        best.add(a.ids[rows[j]], d, ids[here[i]])
            if found := best.take():
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[2]), pa.array(found[1])], names=["query_id", "vec_id", "dist"])

        rows = base.where(only(F.col("cid"), some.cids)).select(F.col("cid").cast("long"), F.col("vec_id").cast("long"), "embedding")
        part = rows.mapInArrow(run, "query_id long, vec_id long, dist double")
        hits = part if hits is None else hits.unionByName(part)
    return ranked(spark.createDataFrame([], "query_id long, vec_id long, dist double") if hits is None else hits, k)


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _bytes(batch: pa.RecordBatch, name: str, row: int, n: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), np.uint8).reshape(n, -1)


class _Reader:
    """Estimates and distances of a block's points to the queries that probe its cluster."""

    def __init__(self, a: Asked, config: IndexConfig, query_bits: int = 0) -> None:
        rotation = kernels.rotation_matrix(config.dim, config.seed)
        self.query_bits = query_bits
        self.a, self.config, self.turned, self.c = a, config, a.q @ rotation, a.centroids @ rotation

    def resident(self, batch: pa.RecordBatch, row: int):
        """A tile of queries after the other: their rows, then (points, queries) of estimates and lower bounds; nothing where
        no query probes the cluster."""
        at, asking = self.a.of(batch.column("cid")[row].as_py())
        if not len(asking):
            return
        m = self.config.prefix
        n = len(_numbers(batch, "f_add", row))
        bits = np.unpackbits(_bytes(batch, "bits", row, n), axis=1)
        factors = [_numbers(batch, x, row) for x in ("f_add", "f_rescale", "f_error")]
        for lo in range(0, len(asking), QUERIES):
            rows = asking[lo : lo + QUERIES]
            v = self.turned[rows]
            terms = kernels.query_terms(v, self.c[at], self.config.metric)
            if self.query_bits:
                yield (rows, *kernels.small_query_estimate(bits, *factors, v[:, :m], *terms, self.query_bits))
            elif self.config.certain:
                est, low = kernels.onebit_estimate(bits, *factors, v, *terms)
                yield rows, est, low - kernels.estimate_slack(*factors[:2], v, self.c[at])
            else:
                yield (rows, *kernels.onebit_estimate(bits, *factors, v, *terms, m))

    def kept(self, batch: pa.RecordBatch, row: int):
        """A tile of queries after the other: their rows, then (points, queries) of lower bounds and of a mark: is the point a
        seed, or its bound not above the query's threshold."""
        seeds = self.a.seeds.get((batch.column("cid")[row].as_py(), batch.column("block")[row].as_py()))
        for rows, _, low in self.resident(batch, row):
            keep = low <= self.a.tau[rows]
            if seeds:
                here = (seeds[0] >= rows[0]) & (seeds[0] <= rows[-1])
                keep[seeds[1][here], np.searchsorted(rows, seeds[0][here])] = True
            yield rows, low, keep

    def refined(self, batch: pa.RecordBatch, row: int, k: int):
        """A tile of queries after the other: queries, distances and places of what is kept of the block and can be among a
        query's k best. A product of matrices finds these; only they are computed pair by pair."""
        found = None
        for rows, _, keep in self.kept(batch, row):
            used = np.flatnonzero(keep.any(axis=1))
            if not len(used):
                continue
            found = found or self._payload(batch, row)
            together, one_by_one = found
            d, off = together(used, rows)
            keep = keep[used]
            edge = self.a.last[rows]
            if len(used) > k:
                edge = np.minimum(edge, np.partition(np.where(keep, d, np.inf), k - 1, axis=0)[k - 1])
            i, j = np.nonzero(keep & ~(d > edge + 2 * off))
            yield rows[j], one_by_one(used[i], rows[j]), used[i]

    def payload(self, batch: pa.RecordBatch, row: int, points: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Distances of pairs of a block's points and queries: exact, or from all bits."""
        return self._payload(batch, row)[1](points, queries)

    def _payload(self, batch: pa.RecordBatch, row: int):
        """Two functions of a block's points and queries: (points, queries) of distances by a product of matrices, with what
        they may be off by; and the distances of pairs, where equal pairs give equal values."""
        config, a = self.config, self.a
        if config.store == "raw":
            x = _numbers(batch, "raw", row).reshape(-1, config.dim).astype(float)
            together = lambda points, queries: (kernels.distances(x[points], a.q[queries], config.metric), kernels.slack(x[points], a.q[queries]))
            return together, _parted(lambda points, queries: kernels.paired(x[points], a.q[queries], config.metric), config.dim)
        at, _ = a.of(batch.column("cid")[row].as_py())
        add, rescale = _numbers(batch, "f_add_ex", row), _numbers(batch, "f_rescale_ex", row)
        n, e = len(add), config.ex_bits
        signs = _bytes(batch, "bits", row, n)
        if config.width > config.prefix:
            signs = np.concatenate((signs, _bytes(batch, "rest", row, n)), axis=1)
        code = kernels.unpack_codes(_bytes(batch, "ex_code", row, n), config.width, e)
        whole = np.unpackbits(signs, axis=1).astype(float) * (1 << e) + code
        middle = ((1 << (e + 1)) - 1) / 2

        def together(points, queries):
            v = self.turned[queries]
            q_add, _ = kernels.query_terms(v, self.c[at], config.metric)
            d = whole[points] @ v.T
            d -= middle * v.sum(1)
            d *= rescale[points, None]
            d += add[points, None]
            d += q_add
            most = lambda x: float(np.abs(x).max(initial=0.0))
            size = most(add[points]) + most(q_add) + most(rescale[points]) * 4 * middle * float(np.abs(v).sum(1).max(initial=0.0))
            return d, 4 * (config.width + 8) * np.finfo(float).eps * size

        def pairs(points, queries):
            v = self.turned[queries]
            q_add, _ = kernels.query_terms(v, self.c[at], config.metric)
            dot = np.einsum("ij,ij->i", whole[points], v) - middle * v.sum(1)
            return add[points] + q_add + rescale[points] * dot

        return together, _parted(pairs, config.width)


def _parted(pairs, width: int):
    """A function of points and queries, applied to bounded parts of them."""
    step = max(1, PAIRS // width)

    def run(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
        found = [pairs(points[at : at + step], queries[at : at + step]) for at in range(0, len(points), step)]
        return np.concatenate(found) if found else np.zeros(0)

    return run


_ESTIMATED = ["cid", "block", "vec_id", "page_id", "bits", "f_add", "f_rescale", "f_error"]
_PAID = ["cid", "block", "vec_id", "bits", "rest", "ex_code", "f_add_ex", "f_rescale_ex"]


def _payload_columns(config: IndexConfig) -> list[str]:
    return ["cid", "block", "vec_id", "raw"] if config.store == "raw" else _PAID


def estimates(postings: DataFrame, queries: DataFrame, cents: DataFrame, config: IndexConfig, nprobe: int, boosted: bool = False, query_bits: int = 0) -> DataFrame:
    """(query_id, vec_id, cid, page_id, est, low[, dist]) of all probed points from their signs [and extra bits or vectors].

    With ``query_bits`` the estimates see queries of so many bits a coordinate. A row for every candidate: for measuring bounds, not for searching.
    """
    out = None
    columns = list(dict.fromkeys([*_ESTIMATED, *(_payload_columns(config) if boosted else [])]))
    table = to_blocks(postings)
    schema = "query_id long, vec_id long, cid long, page_id long, est double, low double" + (", dist double" if boosted else "")
    for some in asked(queries, cents, SearchConfig(k=1, nprobe=nprobe, coarse="flat"), config.dim):
        sent = table.sparkSession.sparkContext.broadcast(some)

        def run(batches, sent=sent):
            reader = _Reader(sent.value, config, query_bits)
            for batch in batches:
                for row in range(batch.num_rows):
                    for rows, est, low in reader.resident(batch, row):
                        n, nq = est.shape
                        i, j = np.repeat(np.arange(n), nq), np.tile(np.arange(nq), n)
                        flat = [reader.a.ids[rows[j]], _numbers(batch, "vec_id", row)[i], np.full(n * nq, batch.column("cid")[row].as_py()), _numbers(batch, "page_id", row)[i], est.ravel(), low.ravel()]
                        if boosted:
                            flat.append(reader.payload(batch, row, i, rows[j]))
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], names=[x.split()[0] for x in schema.split(", ")])

        part = table.where(only(F.col("cid"), some.cids)).select(columns).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return table.sparkSession.createDataFrame([], schema) if out is None else out


def search(postings: DataFrame, queries: DataFrame, cents: DataFrame, config: IndexConfig, options: SearchConfig, coarse=None) -> DataFrame:
    """(query_id, rank, vec_id, dist): two-round pruned search.

    The k points of smallest estimate are examined first; the k-th of their distances bounds what else is examined:
    exactly the probed points whose lower bound doesn't exceed it. With ``drain_alpha`` below 1 the bound for the rest is
    the distance at rank round(alpha * k). Results don't depend on timing; ties go to the smaller id.
    """
    pair(queries, config, "embedding")
    spark = postings.sparkSession
    if not config.ex_bits and config.store != "raw":
        return ranked(_by_estimates(postings, queries, cents, config, options)[0], options.k)
    table, hits = _blocks(postings), None
    for some in asked(queries, cents, options, config.dim, config, coarse):
        _threshold(table, some, config, options)
        part = _named(_best(table, spark.sparkContext.broadcast(some), config, options.k, some.cids), some)
        hits = part if hits is None else hits.unionByName(part)
    return ranked(spark.createDataFrame([], "query_id long, vec_id long, dist double") if hits is None else hits, options.k)


def _blocks(postings: DataFrame) -> DataFrame:
    return postings if "block" in postings.columns else durable(to_blocks(postings))


def _named(rows: DataFrame, some: Asked) -> DataFrame:
    """A part's rows with the queries' ids for their places q."""
    names = rows.sparkSession.createDataFrame(pa.table({"q": np.arange(len(some.ids)), "query_id": some.ids}))
    return rows.join(F.broadcast(names), "q").drop("q")


def _seeds(table: DataFrame, some: Asked, config: IndexConfig, k: int) -> pa.Table:
    """Each query's k points of smallest estimate, with their places: bounded by the part's queries."""
    sent = table.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        reader, best = _Reader(sent.value, config), Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                for rows, est, _ in reader.resident(batch, row):
                    if len(est) > k:
                        i, j = np.nonzero(est <= np.partition(est, k - 1, axis=0)[k - 1])
                    else:
                        i, j = (x.ravel() for x in np.indices(est.shape))
                    same = lambda name, row=row, i=i, batch=batch: np.full(len(i), batch.column(name)[row].as_py())
                    best.add(rows[j], est[i, j], _numbers(batch, "vec_id", row)[i], same("cid"), same("block"), i)
        if found := best.take():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["q", "dist", "vec_id", "cid", "block", "place"])

    found = table.where(only(F.col("cid"), some.cids)).select([x for x in _ESTIMATED if x != "page_id"]).mapInArrow(run, "q long, dist double, vec_id long, cid long, block long, place long")
    order = Window.partitionBy("q").orderBy("dist", "vec_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "cid", "block", "place").toArrow()


def _paid(table: DataFrame, pairs: DataFrame, sent, config: IndexConfig, best: int | None, cids: np.ndarray) -> DataFrame:
    """(q, vec_id, dist) of pairs (q, cid, block, place), from the payload of their blocks; each task's ``best`` if given."""
    lists_ = packed(pairs, ["cid", "block"], ["q", "place"], ["q", "place"])
    columns = _payload_columns(config)
    both = table.where(only(F.col("cid"), cids)).select(columns).join(lists_, ["cid", "block"])

    def run(batches):
        reader, kept = _Reader(sent.value, config), Best(best or 1)
        for batch in batches:
            for row in range(batch.num_rows):
                q, place = _numbers(batch, "q", row), _numbers(batch, "place", row)
                found = (q, reader.payload(batch, row, place, q), _numbers(batch, "vec_id", row)[place])
                if best:
                    kept.add(*found)
                else:
                    yield _hits(found)
        if best and (found := kept.take()):
            yield _hits(found)

    return both.mapInArrow(run, "q long, vec_id long, dist double")


def _hits(found: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[2]), pa.array(found[1])], names=["q", "vec_id", "dist"])


def _threshold(table: DataFrame, some: Asked, config: IndexConfig, options: SearchConfig) -> None:
    """Sets the part's seeds, tau, per query the distance at rank round(alpha * k) of its seeds, and last, that at rank k; both
    infinite if the probed clusters hold fewer than k."""
    spark, k = table.sparkSession, options.k
    seeds = _seeds(table, some, config, k)
    q, cid, block, place = (seeds.column(x).to_numpy() for x in ("q", "cid", "block", "place"))
    order = np.lexsort((block, cid))
    cuts = np.flatnonzero((np.diff(cid[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    some.seeds = {(int(cid[at[0]]), int(block[at[0]])): (q[at], place[at]) for at in np.split(order, cuts) if len(at)}
    paid = _paid(table, spark.createDataFrame(seeds), spark.sparkContext.broadcast(some), config, None, np.unique(cid)).toArrow()
    q, d = paid.column("q").to_numpy(), paid.column("dist").to_numpy()
    rank = min(max(int(options.drain_alpha * k + 0.5), 1), k)
    order = np.lexsort((d, q))
    q, d = q[order], d[order]
    place, whole = np.arange(len(q)) - np.searchsorted(q, q), np.bincount(q, minlength=len(some.ids))[q] >= k
    some.tau, some.last = np.full(len(some.ids), np.inf), np.full(len(some.ids), np.inf)
    for out, r in ((some.tau, rank), (some.last, k)):
        at = whole & (place == r - 1)
        out[q[at]] = d[at]


def _best(table: DataFrame, sent, config: IndexConfig, k: int, cids: np.ndarray) -> DataFrame:
    """(q, vec_id, dist): each task's k best of the seeds and survivors of each query. A pass over resident columns names the
    blocks that hold any; the payload of these is read with them."""

    def holding(batches):
        reader = _Reader(sent.value, config)
        for batch in batches:
            some = [row for row in range(batch.num_rows) if any(keep.any() for _, _, keep in reader.kept(batch, row))]
            if some:
                yield pa.RecordBatch.from_arrays([batch.column(x).take(pa.array(some)) for x in ("cid", "block")], names=["cid", "block"])

    probed = table.where(only(F.col("cid"), cids))
    named = durable(probed.select([x for x in _ESTIMATED if x != "page_id"]).mapInArrow(holding, "cid long, block long"))
    if named.count() <= SENT_BLOCKS:
        named = F.broadcast(named)
    columns = list(dict.fromkeys([*[x for x in _ESTIMATED if x != "page_id"], *_payload_columns(config)]))

    def run(batches):
        reader, best = _Reader(sent.value, config), Best(k)
        for batch in batches:
            for row in range(batch.num_rows):
                for q, d, place in reader.refined(batch, row, k):
                    best.add(q, d, _numbers(batch, "vec_id", row)[place])
        if found := best.take():
            yield _hits(found)

    return probed.select(columns).join(named, ["cid", "block"], "left_semi").select(columns).mapInArrow(run, "q long, vec_id long, dist double")


def _survivors(table: DataFrame, some: Asked, sent, config: IndexConfig) -> DataFrame:
    """(q, cid, block, place, vec_id, page_id, low): seeds, and points whose lower bound doesn't exceed their query's threshold."""

    def run(batches):
        reader = _Reader(sent.value, config)
        for batch in batches:
            for row in range(batch.num_rows):
                here = [batch.column(x)[row].as_py() for x in ("cid", "block")]
                for rows, low, keep in reader.kept(batch, row):
                    i, j = np.nonzero(keep)
                    if len(i):
                        same = [np.full(len(i), x) for x in here]
                        made = [rows[j], *same, i, _numbers(batch, "vec_id", row)[i], _numbers(batch, "page_id", row)[i], low[i, j]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["q", "cid", "block", "place", "vec_id", "page_id", "low"])

    rows = table.where(only(F.col("cid"), some.cids)).select(_ESTIMATED)
    return rows.mapInArrow(run, "q long, cid long, block long, place long, vec_id long, page_id long, low double")


def examined(postings: DataFrame, queries: DataFrame, cents: DataFrame, config: IndexConfig, options: SearchConfig, coarse=None) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, dist) of what can enter the result, and (query_id, vec_id, cid, page_id, low) of the survivors.

    A row for every survivor, for measuring: ``search`` stores none of them."""
    pair(queries, config, "embedding")
    spark = postings.sparkSession
    if not config.ex_bits and config.store != "raw":
        return _by_estimates(postings, queries, cents, config, options)
    table = _blocks(postings)
    hits, kept = None, None
    for some in asked(queries, cents, options, config.dim, config, coarse):
        _threshold(table, some, config, options)
        sent = spark.sparkContext.broadcast(some)
        left = durable(_survivors(table, some, sent, config))
        paid = _paid(table, left.select("q", "cid", "block", "place"), sent, config, options.k, some.cids)
        a, b = _named(paid, some), _named(left, some).select("query_id", "vec_id", "cid", "page_id", "low")
        hits, kept = (a, b) if hits is None else (hits.unionByName(a), kept.unionByName(b))
    if hits is None:
        return spark.createDataFrame([], "vec_id long, dist double, query_id long"), spark.createDataFrame([], "query_id long, vec_id long, cid long, page_id long, low double")
    return hits, kept


def _by_estimates(postings, queries, cents, config, options) -> tuple[DataFrame, DataFrame]:
    """One bit and nothing to re-rank by: the estimates are the distances."""
    rows = estimates(postings, queries, cents, config, options.nprobe)
    return rows.select("query_id", "vec_id", F.col("est").alias("dist")), rows.drop("est")


def marks(postings: DataFrame, queries: DataFrame, cents: DataFrame, config: IndexConfig, options: SearchConfig) -> DataFrame:
    """Every candidate of a search (query_id, vec_id, cid, page_id, est, low, dist) with a mark ``kept``: was it examined.

    A row for every candidate, for measuring: seeds and survivors are found by windows over all of them.
    """
    rows = durable(estimates(postings, queries, cents, config, options.nprobe, boosted=True))
    k = options.k
    rank = min(max(int(options.drain_alpha * k + 0.5), 1), k)
    of = Window.partitionBy("query_id")
    seeded = rows.withColumn("seed", F.row_number().over(of.orderBy("est", "vec_id")) <= k)
    placed = seeded.withColumn("place", F.row_number().over(of.orderBy(~F.col("seed"), "dist", "vec_id")))
    short = F.sum(F.col("seed").cast("int")).over(of) < k
    edge = F.max(F.when(F.col("seed") & (F.col("place") == rank), F.col("dist"))).over(of)
    marked = placed.withColumn("tau", F.when(short, F.lit(float("inf"))).otherwise(edge))
    return marked.withColumn("kept", F.col("seed") | (F.col("low") <= F.col("tau"))).drop("seed", "place")


def counters(marked: DataFrame) -> DataFrame:
    """Per query: points probed and examined, logical pages, clusters."""
    return marked.groupBy("query_id").agg(
        F.countDistinct("cid").alias("clusters"),
        F.count("*").alias("candidates"),
        F.sum(F.col("kept").cast("long")).alias("records"),
        F.countDistinct(F.when(F.col("kept"), F.col("page_id"))).alias("pages"),
    )


def page_candidates(kept: DataFrame) -> DataFrame:
    """(query_id, page_id, page_low, n): pages that a query reads for the points it examines, by the smallest bound on them."""
    return kept.groupBy("query_id", "page_id").agg(F.min("low").alias("page_low"), F.count("*").alias("n"))


__all__ = ["build", "estimates", "lists", "load", "probes", "save", "search", "search_raw"]
