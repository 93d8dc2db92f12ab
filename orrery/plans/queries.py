"""Queries over the ``embeddings`` table that exercise each operator, with SQL that gives the same rows.

Where an operator searches, its queries are all vectors whose id is divisible by 20. Labels serve as an assignment.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.config import EvalConfig, IndexConfig, SearchConfig
from orrery.functions import kernels
from orrery.operators import clustering, coarse, evaluate, index, knn
from orrery.operators.blocks import map_arrow, matrix

K, STEP = 10, 20
SEED = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def asked(base: DataFrame) -> DataFrame:
    return base.where(F.col("vec_id") % STEP == 0)


def labelled(base: DataFrame) -> DataFrame:
    return base.select("vec_id", F.col("label").cast("long").alias("cid"), "embedding")


def label_centroids(base: DataFrame) -> DataFrame:
    return clustering.centroids(labelled(base))


def scaled(base: DataFrame) -> DataFrame:
    """Lengths that differ by label, so that inner products and distances rank differently."""
    return base.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label") / 10)))


def doubled(base: DataFrame) -> DataFrame:
    """Every vector twice, for ties."""
    n = base.agg(F.max("vec_id") + 1).first()[0]
    return base.unionByName(base.withColumn("vec_id", F.col("vec_id") + n))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Values as both engines can be compared: rounded, and without a negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


B = "b AS (SELECT vec_id, embedding::DOUBLE[] AS v, label::BIGINT AS label FROM embeddings)"
Q = "q AS (SELECT vec_id AS query_id, v AS w FROM b WHERE vec_id % 20 = 0)"
C = """c AS (SELECT label AS cid, list(m ORDER BY j) AS c, max(n) AS n FROM (
         SELECT label, j, avg(v[j]) AS m, count(*) AS n FROM b, range(1, 65) t(j) GROUP BY label, j) GROUP BY label)"""
D = "list_distance(v, w) ** 2"
KNN = f"""k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {D}, vec_id) AS rank, vec_id, {D} AS dist
              FROM q, b QUALIFY rank <= 10)"""
TWICE = "t AS (SELECT vec_id, v FROM b UNION ALL SELECT vec_id + (SELECT max(vec_id) + 1 FROM b), v FROM b)"
TKNN = f"""k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {D}, vec_id) AS rank, vec_id, {D} AS dist
               FROM q, t QUALIFY rank <= 10)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- exact search


@query(with_(B, Q, KNN) + f"SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM k")
def knn_exact_l2(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return rounded(knn.exact_knn(base, asked(base), K), "dist")


SCALED = "s AS (SELECT vec_id, label, list_transform(v, lambda x: x * (1 + label / 10)) AS v FROM b)"


@query(
    with_(B, SCALED, "q AS (SELECT vec_id AS query_id, v AS w FROM s WHERE vec_id % 20 = 0)")
    + f"""SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM (SELECT query_id, vec_id, 1 - list_dot_product(v, w) AS dist,
          row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_dot_product(v, w), vec_id) AS rank FROM s, q) WHERE rank <= 10"""
)
def knn_exact_ip(spark, sf_dir):
    base = scaled(vectors(spark, sf_dir))
    return rounded(knn.exact_knn(base, asked(base), K, "ip"), "dist")


@query(
    with_(B, Q)
    + f"""SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM (SELECT query_id, vec_id, {D} AS dist,
          row_number() OVER (PARTITION BY query_id ORDER BY {D}, vec_id) AS rank FROM q, b WHERE label < 5) WHERE rank <= 10"""
)
def knn_filtered(spark, sf_dir):
    """Search among the vectors that fit a predicate, which is pushed to the scan."""
    base = vectors(spark, sf_dir)
    return rounded(knn.exact_knn(base.where("label < 5"), asked(base), K), "dist")


@query(with_(B) + f"SELECT vec_id, {r6('list_dot_product(v, v)')} AS norm2, {r6('sqrt(list_dot_product(v, v))')} AS norm FROM b")
def vec_norms(spark, sf_dir):
    v = F.col("embedding")
    return rounded(vectors(spark, sf_dir).select("vec_id", knn.dot(v, v).alias("norm2"), knn.norm(v).alias("norm")), "norm2", "norm")


@query(
    with_(B, SCALED)
    + f"SELECT vec_id, j - 1 AS pos, {r6('v[j] / sqrt(list_dot_product(v, v))')} AS x FROM s, range(1, 65) t(j)"
)
def vec_normalize(spark, sf_dir):
    rows = scaled(vectors(spark, sf_dir)).select("vec_id", F.posexplode(knn.normalize(F.col("embedding"))).alias("pos", "x"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "x")


@query(
    with_("u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(greatest(least((x + 0.6) * 212, 255), 0))) AS v FROM embeddings)", "b AS (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings)")
    + f"SELECT vec_id, {r6('list_distance(v, w) ** 2')} AS l2, {r6('list_dot_product(v, w)')} AS ip FROM u JOIN b USING (vec_id)"
)
def mixed_u8(spark, sf_dir):
    """Whole-number vectors (0 to 255) against float vectors: the integers are widened exactly."""
    u8 = F.transform("embedding", lambda x: F.round(F.greatest(F.least((x.cast("double") + 0.6) * 212, F.lit(255.0)), F.lit(0.0))).cast("short"))
    rows = vectors(spark, sf_dir).select("vec_id", "embedding", u8.alias("u"))
    return rounded(rows.select("vec_id", knn.l2_squared(F.col("u"), F.col("embedding")).alias("l2"), knn.dot(F.col("u"), F.col("embedding")).alias("ip")), "l2", "ip")


# --- clusters


@query(with_(B) + f"SELECT label AS cid, j - 1 AS pos, {r6('avg(v[j])')} AS mean, count(*) AS n FROM b, range(1, 65) t(j) GROUP BY label, j")
def centroid_mean(spark, sf_dir):
    rows = clustering.means(labelled(vectors(spark, sf_dir)))
    return rounded(rows.select("cid", F.col("pos").cast("long"), "mean", "n"), "mean")


NEAREST = """a AS (SELECT vec_id, v, cid, dist FROM (SELECT vec_id, v, cid, list_distance(v, c) ** 2 AS dist,
             row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c) ** 2, cid) AS r FROM b, c) WHERE r = 1)"""


@query(with_(B, C, NEAREST) + f"SELECT vec_id, cid, {r6('dist')} AS dist FROM a")
def nn1_argmin(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return rounded(clustering.assign(base, label_centroids(base)), "dist")


IMBALANCE = f"""z AS (SELECT cid, count(*) AS n FROM a GROUP BY cid), g AS (SELECT i AS cid, coalesce(n, 0) AS n FROM range(0, 12) r(i) LEFT JOIN z ON z.cid = i)
    SELECT {r6('12 * sum(n * n) / (sum(n)::DOUBLE * sum(n))')} AS imbalance, count(*) FILTER (n = 0) AS empty, min(n) AS min_size, max(n) AS max_size,
           {r6('avg(n)')} AS mean_size, {r6('stddev_pop(n)')} AS std_size FROM g"""


@query(with_(B, C, NEAREST, IMBALANCE))
def cluster_imbalance(spark, sf_dir):
    """Over twelve clusters of which two have no centroid."""
    base = vectors(spark, sf_dir)
    return rounded(clustering.imbalance(clustering.assign(base, label_centroids(base)), 12), "imbalance", "mean_size", "std_size")


ORDER = """o AS (SELECT vec_id, v, label AS cid, row_number() OVER (PARTITION BY label ORDER BY list_distance(v, c) ** 2, vec_id) - 1 AS pos
           FROM b JOIN c ON label = cid)"""


@query(with_(B, C, ORDER) + "SELECT vec_id, cid, pos FROM o")
def centroid_order(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return index.centroid_order(labelled(base), label_centroids(base)).select("vec_id", "cid", "pos")


PAGES = """pz AS (SELECT label AS cid, count(*) AS n FROM b GROUP BY label),
    p AS (SELECT cid, n, CAST(ceil(n / 16) AS BIGINT) AS pages FROM pz),
    f AS (SELECT *, CAST(coalesce(sum(pages) OVER (ORDER BY cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_page FROM p)"""


@query(with_(B, PAGES) + "SELECT cid, n, pages, first_page FROM f")
def page_layout(spark, sf_dir):
    """Raw float records of 256 bytes: sixteen a page."""
    sizes = labelled(vectors(spark, sf_dir)).groupBy("cid").agg(F.count("*").alias("n"))
    return index.page_table(sizes, IndexConfig(64, store="raw").record_bytes())


START = "s0 AS (SELECT vec_id AS cid, v AS c FROM b WHERE vec_id < 8)"


def _lloyd_sql(steps: int) -> str:
    parts = [B, START]
    for i in range(steps):
        parts.append(
            f"""a{i} AS (SELECT vec_id, v, cid FROM (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c) ** 2, cid) AS r
                FROM b, s{i}) WHERE r = 1),
            s{i + 1} AS (SELECT s{i}.cid, coalesce(m, c) AS c FROM s{i} LEFT JOIN (SELECT cid, list(x ORDER BY j) AS m FROM (
                SELECT cid, j, avg(v[j]) AS x FROM a{i}, range(1, 65) t(j) GROUP BY cid, j) GROUP BY cid) USING (cid))"""
        )
    return with_(*parts) + f"SELECT cid, j - 1 AS pos, {r6('c[j]')} AS x FROM s{steps}, range(1, 65) t(j)"


def _lloyd(spark, sf_dir, steps):
    base = vectors(spark, sf_dir)
    start = base.where("vec_id < 8").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))
    rows = clustering.lloyd(base, start, steps).select("cid", F.posexplode("centroid").alias("pos", "x"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "x")


@query(_lloyd_sql(1))
def lloyd_step(spark, sf_dir):
    return _lloyd(spark, sf_dir, 1)


@query(_lloyd_sql(3))
def lloyd_3_iters(spark, sf_dir):
    return _lloyd(spark, sf_dir, 3)


@query(with_(B) + "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS r FROM b) WHERE r <= 100")
def sample_hash(spark, sf_dir):
    """An exact sample is the feature: a hundred rows without replacement."""
    return clustering.sample_exact(vectors(spark, sf_dir), 100).select("vec_id", F.col("label").cast("long"))


@query(with_(B, "n AS (SELECT count(*) AS n FROM b)") + "SELECT CAST(floor(0.5 + i * n / 64.0::DOUBLE) AS BIGINT) AS vec_id FROM n, range(0, 64) r(i)")
def sample_systematic(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return clustering.sample_systematic(base, 64, base.count(), 0.5).select("vec_id")


@query(with_(B) + "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 2654435761) % 4294967296, vec_id) AS r FROM b) WHERE r <= 7")
def sample_cells(spark, sf_dir):
    return clustering.sample_cells(vectors(spark, sf_dir), "label", 7).select("vec_id", F.col("label").cast("long"))


@query(
    with_(B, "g AS (SELECT label AS cell, count(*) AS n FROM b GROUP BY label)", "u AS (SELECT *, floor(sum(n) OVER (ORDER BY cell) * 37 / sum(n) OVER ()) AS upto FROM g)")
    + "SELECT cell, n, CAST(upto - coalesce(lag(upto) OVER (ORDER BY cell), 0) AS BIGINT) AS share FROM u"
)
def cell_shares(spark, sf_dir):
    sizes = labelled(vectors(spark, sf_dir)).groupBy(F.col("cid").alias("cell")).agg(F.count("*").alias("n"))
    return clustering.cell_shares(sizes, 37)


CHILDREN = """h AS (SELECT label AS cell, vec_id AS cid, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM b) WHERE r <= 4),
    p AS (SELECT vec_id, v, cid AS cell FROM (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c) ** 2, cid) AS r FROM b, c) WHERE r <= 3),
    w AS (SELECT vec_id, cid, dist FROM (SELECT vec_id, h.cid, list_distance(v, h.c) ** 2 AS dist,
          row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, h.c) ** 2, h.cid) AS r FROM p JOIN h USING (cell)) WHERE r = 1)"""


def _children(base):
    first = base.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("r <= 4")
    return first.select(F.col("label").cast("long").alias("cell"), F.col("vec_id").alias("cid"), F.col("embedding").alias("centroid"))


@query(with_(B, C, CHILDREN) + f"SELECT vec_id, cid, {r6('dist')} AS dist FROM w")
def two_level_assign(spark, sf_dir):
    """Three nearest label centroids, then the nearest of four children in each."""
    base = vectors(spark, sf_dir)
    return rounded(clustering.probe_assign(base, label_centroids(base), _children(base), 3), "dist")


@query(
    with_(B, C, CHILDREN, "x AS (SELECT vec_id, cid FROM (SELECT vec_id, h.cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, h.c) ** 2, h.cid) AS r FROM b, h) WHERE r = 1)")
    + f"SELECT count(*) AS rows, {r6('avg(CASE WHEN w.cid = x.cid THEN 1.0 ELSE 0.0 END)')} AS recall FROM w JOIN x USING (vec_id)"
)
def assign_recall1(spark, sf_dir):
    base = vectors(spark, sf_dir)
    near = clustering.probe_assign(base, label_centroids(base), _children(base), 3)
    return rounded(clustering.agreement(near, clustering.assign(base, _children(base))), "recall")


# --- probing and inverted lists


PROBE = """pr AS (SELECT query_id, w, rank, cid, dist FROM (SELECT query_id, w, cid, list_distance(w, c) AS dist,
           row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, c), cid) AS rank FROM q, c) WHERE rank <= {n})"""


@query(with_(B, Q, C, PROBE.format(n=3)) + f"SELECT query_id, rank, cid, {r6('dist')} AS dist FROM pr")
def coarse_flat_probe(spark, sf_dir):
    base = vectors(spark, sf_dir)
    return rounded(index.probes(asked(base), label_centroids(base), 3), "dist")


@query(with_(B, Q, C, PROBE.format(n=3)) + "SELECT query_id, rank, cid, round(dist, 5) + 0.0 AS dist FROM pr")
def irq_full_probe(spark, sf_dir):
    """Probing by an index over the centroids, all inner clusters, refined at full precision."""
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    own = coarse.build(cents, _config(), cents.select("cid", (F.col("cid") % 3).alias("inner")), refine="full")
    return rounded(coarse.probe(asked(base), own, 3, "full"), "dist", digits=5)


@query(
    with_(B, SCALED, "q AS (SELECT vec_id AS query_id, v AS w FROM s WHERE vec_id % 20 = 0)", C.replace("FROM b, range", "FROM s, range"))
    + """SELECT query_id, rank, cid, round(dist, 5) + 0.0 AS dist, round(ip, 5) + 0.0 AS ip, round(gap, 5) + 0.0 AS gap FROM (
         SELECT query_id, cid, dist, ip, gap, row_number() OVER (PARTITION BY query_id ORDER BY dist, cid) AS rank FROM (
         SELECT query_id, cid, list_distance(list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), list_transform(c, lambda x: x / sqrt(list_dot_product(c, c)))) AS dist,
                list_dot_product(w, c) AS ip, list_distance(w, c) AS gap FROM q, c)) WHERE rank <= 3"""
)
def irq_ip_probe(spark, sf_dir):
    """For inner products: unit centroids, and the true products and distances from norms that were kept."""
    base = scaled(vectors(spark, sf_dir))
    cents = label_centroids(base)
    own = coarse.build(cents, _config(metric="ip"), cents.select("cid", (F.col("cid") % 3).alias("inner")), refine="full")
    return rounded(coarse.probe(asked(base), own, 3, "full"), "dist", "ip", "gap", digits=5)


def _raw_sql(n: int) -> str:
    return with_(B, Q, C, PROBE.format(n=n)) + (
        f"""SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM (SELECT query_id, vec_id, {D} AS dist,
            row_number() OVER (PARTITION BY query_id ORDER BY {D}, vec_id) AS rank FROM pr JOIN b ON label = cid) WHERE rank <= 10"""
    )


def _raw(spark, sf_dir, n, metric="l2"):
    base = vectors(spark, sf_dir)
    if metric == "ip":
        base = scaled(base)
    cents = label_centroids(base)
    placed = index.centroid_order(labelled(base), cents)
    return rounded(index.search_raw(placed, asked(base), cents, n, K, metric), "dist", digits=5 if metric == "ip" else 6)


@query(_raw_sql(1))
def ivf_raw_search_np1(spark, sf_dir):
    return _raw(spark, sf_dir, 1)


@query(_raw_sql(3))
def ivf_raw_search_np3(spark, sf_dir):
    return _raw(spark, sf_dir, 3)


@query(_raw_sql(10))
def ivf_raw_search_npall(spark, sf_dir):
    return _raw(spark, sf_dir, 10)


@query(
    with_(
        "b AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label / 10))::FLOAT[]::DOUBLE[] AS v, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label / 10)) AS e FROM embeddings)",
        "q AS (SELECT vec_id AS query_id, e AS w FROM b WHERE vec_id % 20 = 0)",
        C.replace("v[j]", "e[j]"),
        PROBE.format(n=3),
    )
    + """SELECT query_id, rank, vec_id, round(dist, 5) + 0.0 AS dist FROM (SELECT query_id, vec_id, 1 - list_dot_product(v, w) AS dist,
         row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_dot_product(v, w), vec_id) AS rank FROM pr JOIN b ON label = cid) WHERE rank <= 10"""
)
def ivf_ip_raw_search(spark, sf_dir):
    return _raw(spark, sf_dir, 3, "ip")


# --- rotation, codes, estimates: in SQL by long rows of (id, dimension, value)


def _flip_values() -> str:
    return ", ".join(f"({r}, {j}, {int(x)})" for r, row in enumerate(kernels.sign_flips(64, SEED)) for j, x in enumerate(row))


_X = "(xor(h1, h1 >> 15)::HUGEINT * 2246822519) % 4294967296"
FLIPS = f"""f0 AS (SELECT r, j, ((r * 64 + j + {SEED} * 1000003 + 1)::HUGEINT * 2654435761 % 4294967296)::BIGINT AS h1 FROM range(0, 4) a(r), range(0, 64) c(j)),
    fl AS (SELECT r, j, CASE WHEN ((({_X})::BIGINT >> 16) & 1) = 1 THEN -1 ELSE 1 END AS s FROM f0)"""


def _turned(source: str, name: str) -> str:
    """Four rounds of flips and a Walsh-Hadamard transform of rows (id, j, x)."""
    parts, last = [], source
    for r in range(4):
        parts.append(
            f"""{name}{r} AS (SELECT id, t.j, sum(x * s * CASE WHEN bit_count({last}.j & t.j) % 2 = 1 THEN -1 ELSE 1 END) / 8 AS x
                FROM {last} JOIN fl ON fl.j = {last}.j AND fl.r = {r}, range(0, 64) t(j) GROUP BY id, t.j)"""
        )
        last = f"{name}{r}"
    return ",\n".join(parts)


LONG = "l AS (SELECT vec_id AS id, j - 1 AS j, v[j] AS x FROM b, range(1, 65) t(j))"
LONGC = "lc AS (SELECT cid AS id, j - 1 AS j, c[j] AS x FROM c, range(1, 65) t(j))"
ROTATED = ",\n".join((B, FLIPS, LONG, _turned("l", "m")))
RESID = ",\n".join(
    (ROTATED, C, LONGC, _turned("lc", "n"), "e AS (SELECT m3.id, label AS cid, m3.j, m3.x, n3.x AS c, m3.x - n3.x AS r, CASE WHEN m3.x - n3.x > 0 THEN 1 ELSE 0 END AS bit FROM m3 JOIN b ON vec_id = m3.id JOIN n3 ON n3.id = label AND n3.j = m3.j)")
)
NORMS = "g AS (SELECT id, cid, sum(r * r) AS n2, sum(r * (bit - 0.5)) AS ru, sum(c * (bit - 0.5)) AS cu, sum(r * c) AS rc FROM e GROUP BY id, cid)"


def _rotated(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    turn = kernels.rotation_matrix(64, SEED)
    from orrery.operators.blocks import lists

    return map_arrow(df.select(F.col(id_col).cast("long").alias("i"), F.col(vec).alias("v")), lambda c: {"i": c["i"], "x": lists(matrix(c["v"]) @ turn)}, "i long,x array<double>")


@query(with_(ROTATED) + f"SELECT id AS vec_id, j AS pos, {r6('x')} AS x FROM m3")
def rotate_fht(spark, sf_dir):
    rows = _rotated(vectors(spark, sf_dir)).select(F.col("i").alias("vec_id"), F.posexplode("x").alias("pos", "x"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "x")


def _config(**more) -> IndexConfig:
    return IndexConfig(64, seed=SEED, **more)


def _postings(spark, sf_dir, **more):
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    config = _config(**more)
    return base, cents, config, index.build(labelled(base), cents, config)


@query(
    with_(RESID)
    + "SELECT id AS vec_id, sum(bit)::BIGINT AS ones, string_agg(CASE WHEN bit = 1 THEN '1' ELSE '0' END, '' ORDER BY j) AS bits FROM e GROUP BY id"
)
def onebit_code(spark, sf_dir):
    """Most significant bit first."""
    _, _, _, postings = _postings(spark, sf_dir)
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex("bits"), 4 * i + 1, 4), 16, 2), 16, "0") for i in range(4)])
    return postings.select("vec_id", F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("long").alias("ones"), bits.alias("bits"))


FACTORS = {
    "l2": ("n2 + 2 * n2 * cu / ru", "-2 * n2 / ru", "2 * 1.9 * sqrt(n2) / 8"),
    "ip": ("1 - rc + n2 * cu / ru", "-n2 / ru", "1.9 * sqrt(n2) / 8"),
}


def _factor_sql(metric: str) -> str:
    a, b, c = FACTORS[metric]
    return with_(RESID, NORMS) + f"SELECT id AS vec_id, {r6(a)} AS f_add, {r6(b)} AS f_rescale, {r6(c)} AS f_error FROM g"


def _factors(spark, sf_dir, metric):
    _, _, _, postings = _postings(spark, sf_dir, metric=metric)
    return rounded(postings.select("vec_id", "f_add", "f_rescale", "f_error"), "f_add", "f_rescale", "f_error")


@query(_factor_sql("l2"))
def onebit_factors_l2(spark, sf_dir):
    return _factors(spark, sf_dir, "l2")


@query(_factor_sql("ip"))
def onebit_factors_ip(spark, sf_dir):
    return _factors(spark, sf_dir, "ip")


@query(
    with_(RESID, NORMS)
    + f"""SELECT id AS vec_id, {r6('2 * 1.9 * sqrt(n2) * sqrt(greatest(0, (n2 * 16 / (ru * ru) - 1) / 63))')} AS f_error,
          {r6('1.9 * sqrt(n2) * sqrt(greatest(0, (n2 * 16 / (ru * ru) - 1) / 63))')} AS f_error_ip FROM g"""
)
def onebit_error_full(spark, sf_dir):
    """The tighter bound of whole codes."""
    base = vectors(spark, sf_dir)
    ids, c = clustering.local_centroids(label_centroids(base))
    turn = kernels.rotation_matrix(64, SEED)

    def kernel(col):
        x, near = matrix(col["embedding"]) @ turn, (c @ turn)[np.searchsorted(ids, col["cid"].to_numpy())]
        return {"vec_id": col["vec_id"], "f_error": kernels.onebit(x, near, "l2")[3], "f_error_ip": kernels.onebit(x, near, "ip")[3]}

    return rounded(map_arrow(labelled(base), kernel, "vec_id long,f_error double,f_error_ip double"), "f_error", "f_error_ip")


ESTIMATE = """lq AS (SELECT query_id AS id, j - 1 AS j, w[j] AS x FROM q, range(1, 65) t(j)),
    """ + _turned("lq", "y") + """,
    dots AS (SELECT y3.id AS query_id, e.id AS vec_id, e.cid, sum(y3.x * (e.bit - 0.5)) AS qb FROM pr JOIN y3 ON y3.id = pr.query_id
             JOIN e ON e.cid = pr.cid AND e.j = y3.j GROUP BY ALL),
    est AS (SELECT dots.query_id, vec_id, dots.cid AS cid, n2 + 2 * n2 * cu / ru + dist * dist - 2 * n2 / ru * qb AS est,
            n2 + 2 * n2 * cu / ru + dist * dist - 2 * n2 / ru * qb - 2 * 1.9 * sqrt(n2) / 8 * dist AS low
            FROM dots JOIN g ON g.id = vec_id AND g.cid = dots.cid JOIN pr ON pr.query_id = dots.query_id AND pr.cid = dots.cid)"""  # fmt: skip
ESTIMATED = with_(RESID, NORMS, Q, PROBE.format(n=3), ESTIMATE)


@query(ESTIMATED + "SELECT query_id, vec_id, cid, round(est, 5) + 0.0 AS est, round(low, 5) + 0.0 AS low FROM est")
def onebit_estimate(spark, sf_dir):
    base, cents, config, postings = _postings(spark, sf_dir)
    rows = index.estimates(postings, asked(base), cents, config, 3)
    return rounded(rows.select("query_id", "vec_id", "cid", "est", "low"), "est", "low", digits=5)


PRUNE = f"""tr AS (SELECT est.*, list_distance(v, w) ** 2 AS dist FROM est JOIN b USING (vec_id) JOIN q USING (query_id)),
    sd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY est, vec_id) AS r FROM tr),
    ta AS (SELECT query_id, CASE WHEN count(*) < 10 THEN 'inf'::DOUBLE ELSE max(dist) END AS tau FROM sd WHERE r <= 10 GROUP BY query_id),
    mk AS (SELECT sd.*, tau, (r <= 10 OR low <= tau) AS kept FROM sd JOIN ta USING (query_id))"""
PRUNED = ESTIMATED.rstrip() + ",\n" + PRUNE + "\n"


def _examined(spark, sf_dir, alpha=1.0):
    base, cents, config, postings = _postings(spark, sf_dir, store="raw")
    options = SearchConfig(k=K, nprobe=3, drain_alpha=alpha)
    return index.examined(postings, asked(base), cents, config, options)


def _marks(spark, sf_dir, alpha=1.0):
    base, cents, config, postings = _postings(spark, sf_dir, store="raw")
    return index.marks(postings, asked(base), cents, config, SearchConfig(k=K, nprobe=3, drain_alpha=alpha))


@query(PRUNED + "SELECT query_id, vec_id, kept FROM mk")
def lower_bound_prune(spark, sf_dir):
    return _marks(spark, sf_dir).select("query_id", "vec_id", "kept")


@query(
    PRUNED
    + f"""SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM (SELECT query_id, vec_id, dist,
          row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM mk WHERE kept) WHERE rank <= 10"""
)
def rq_search_raw(spark, sf_dir):
    """Two-round pruned search with exact re-ranking."""
    return rounded(knn.ranked(_examined(spark, sf_dir)[0], K), "dist")


@query(
    ESTIMATED.rstrip() + ",\n" + PRUNE.replace("max(dist) END", "max(CASE WHEN d = 4 THEN dist END) END").replace("FROM sd WHERE r <= 10", "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS d FROM sd WHERE r <= 10)")
    + "\nSELECT query_id, count(*) FILTER (kept) AS records FROM mk GROUP BY query_id"
)
def drain_threshold(spark, sf_dir):
    """With alpha 0.4 the bound is the fourth smallest seed distance."""
    return index.counters(_marks(spark, sf_dir, 0.4)).select("query_id", "records")


PAGED = PRUNED.rstrip() + ",\n" + PAGES + ",\n" + ORDER + ",\npg AS (SELECT mk.*, first_page + pos // 16 AS page_id FROM mk JOIN o USING (vec_id) JOIN f ON f.cid = mk.cid)\n"


@query(PAGED + "SELECT query_id, page_id, round(min(low), 5) + 0.0 AS page_low, count(*) AS n FROM pg WHERE kept GROUP BY query_id, page_id")
def page_candidates(spark, sf_dir):
    return rounded(index.page_candidates(_examined(spark, sf_dir)[1]), "page_low", digits=5)


@query(PAGED + "SELECT query_id, count(DISTINCT cid) AS clusters, count(*) AS candidates, count(*) FILTER (kept) AS records, count(DISTINCT page_id) FILTER (kept) AS pages FROM pg GROUP BY query_id")
def io_accounting(spark, sf_dir):
    return index.counters(_marks(spark, sf_dir))


# --- extra bits (four of them, so that SQL can follow)


UNIT = "un AS (SELECT id, cid, j, r, c, abs(r) / sqrt(sum(r * r) OVER (PARTITION BY id)) AS a FROM e)"
SCALE = """lim AS (SELECT id, 25 / max(a) AS hi, 25 / max(a) * 0.59 AS lo FROM un GROUP BY id),
    ev AS (SELECT un.id, un.j, k, k / a AS t, a FROM un, range(1, 16) z(k) WHERE a > 0),
    st AS (SELECT un.id, sum(a * (0.5 + q)) AS dot, sum((q + 0.5) * (q + 0.5)) AS sq FROM
           (SELECT un.*, (SELECT count(*) FROM range(1, 16) z(k) WHERE a > 0 AND k / a <= lo) AS q FROM un JOIN lim USING (id)) un GROUP BY un.id),
    rn AS (SELECT ev.id, t, dot + sum(a) OVER w AS d, sq + sum(2 * k) OVER w AS s FROM ev JOIN lim USING (id) JOIN st USING (id) WHERE t > lo AND t < hi
           WINDOW w AS (PARTITION BY ev.id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    al AS (SELECT id, t, d / sqrt(s) AS score FROM rn UNION ALL SELECT id, lo, dot / sqrt(sq) FROM st JOIN lim USING (id)),
    best AS (SELECT id, t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 13) DESC, t) AS r FROM al) WHERE r = 1)"""
EXCODE = """cd AS (SELECT un.*, (SELECT count(*) FROM range(1, 16) z(k) WHERE a > 0 AND k / a <= t * (1 + 1e-12)) AS lev FROM un JOIN best USING (id)),
    ec AS (SELECT *, CASE WHEN r < 0 THEN 15 - lev ELSE lev END AS code FROM cd),
    ef AS (SELECT id, cid, sum((lev + 0.5) * a) AS along, sum(r * r) AS n2, sum(r * (code + CASE WHEN r >= 0 THEN 16 ELSE 0 END - 15.5)) AS rw,
           sum(c * (code + CASE WHEN r >= 0 THEN 16 ELSE 0 END - 15.5)) AS cw FROM ec GROUP BY id, cid)"""


def _residuals(base):
    ids, c = clustering.local_centroids(label_centroids(base))
    turn = kernels.rotation_matrix(64, SEED)
    return lambda col: (matrix(col["embedding"]) @ turn, (c @ turn)[np.searchsorted(ids, col["cid"].to_numpy())])


@query(with_(RESID, UNIT, SCALE) + f"SELECT id AS vec_id, {r6('t')} AS t FROM best")
def exbits_rescale_t(spark, sf_dir):
    base = vectors(spark, sf_dir)
    pair = _residuals(base)

    def kernel(col):
        x, c = pair(col)
        return {"vec_id": col["vec_id"], "t": kernels.best_rescale(kernels.unit_abs(x - c), 4)}

    return rounded(map_arrow(labelled(base), kernel, "vec_id long,t double"), "t")


@query(with_(RESID, UNIT, SCALE, EXCODE) + "SELECT id AS vec_id, string_agg(printf('%X', code), '' ORDER BY j) AS code FROM ec GROUP BY id")
def exbits_code(spark, sf_dir):
    return _postings(spark, sf_dir, bits=5)[3].select("vec_id", F.hex("ex_code").alias("code"))


@query(with_(RESID, UNIT, SCALE, EXCODE) + f"SELECT id AS vec_id, {r6('n2 + 2 * n2 * cw / rw')} AS f_add_ex, {r6('-2 * sqrt(n2) / along')} AS f_rescale_ex FROM ef")
def exbits_factors(spark, sf_dir):
    rows = _postings(spark, sf_dir, bits=5)[3].select("vec_id", "f_add_ex", "f_rescale_ex")
    return rounded(rows, "f_add_ex", "f_rescale_ex")


BOOST = with_(RESID, UNIT, SCALE, EXCODE, Q, PROBE.format(n=3)) + """, lq AS (SELECT query_id AS id, j - 1 AS j, w[j] AS x FROM q, range(1, 65) t(j)),
    """ + _turned("lq", "y") + """,
    bd AS (SELECT y3.id AS query_id, ec.id AS vec_id, ec.cid, sum(y3.x * (code + CASE WHEN r > 0 THEN 16 ELSE 0 END - 15.5)) AS qw FROM pr
           JOIN y3 ON y3.id = pr.query_id JOIN ec ON ec.cid = pr.cid AND ec.j = y3.j GROUP BY ALL)
    SELECT bd.query_id, vec_id, round(n2 + 2 * n2 * cw / rw + dist * dist - 2 * sqrt(n2) / along * qw, 5) + 0.0 AS dist
    FROM bd JOIN ef ON ef.id = vec_id AND ef.cid = bd.cid JOIN pr ON pr.query_id = bd.query_id AND pr.cid = bd.cid"""  # fmt: skip


@query(BOOST.replace("\n, lq", ", lq"))
def boosted_estimate(spark, sf_dir):
    """Distances from signs and four extra bits of all probed points."""
    base, cents, config, postings = _postings(spark, sf_dir, bits=5)
    return rounded(index.estimates(postings, asked(base), cents, config, 3, boosted=True).select("query_id", "vec_id", "dist"), "dist", digits=5)


@query()
def rq_search_full(spark, sf_dir):
    """Nine bits, all clusters; compared with exact search by recall in the tests."""
    base, cents, config, postings = _postings(spark, sf_dir)
    return rounded(index.search(postings, asked(base), cents, config, SearchConfig(k=K, nprobe=10)), "dist")


EXBITS = with_(RESID, NORMS, UNIT, SCALE, EXCODE, Q, PROBE.format(n=3), ESTIMATE).rstrip() + """,
    bd AS (SELECT y3.id AS query_id, ec.id AS vec_id, ec.cid AS cid, sum(y3.x * (code + CASE WHEN r > 0 THEN 16 ELSE 0 END - 15.5)) AS qw FROM pr
           JOIN y3 ON y3.id = pr.query_id JOIN ec ON ec.cid = pr.cid AND ec.j = y3.j GROUP BY ALL),
    tr AS (SELECT est.query_id AS query_id, est.vec_id AS vec_id, est, low, ef.n2 + 2 * ef.n2 * cw / rw + pr.dist * pr.dist - 2 * sqrt(ef.n2) / along * qw AS dist
           FROM est JOIN bd ON bd.query_id = est.query_id AND bd.vec_id = est.vec_id AND bd.cid = est.cid
           JOIN ef ON ef.id = est.vec_id AND ef.cid = est.cid JOIN pr ON pr.query_id = est.query_id AND pr.cid = est.cid),
    sd AS""" + PRUNE.partition("sd AS")[2]  # fmt: skip


@query(
    EXBITS
    + """ SELECT query_id, rank, vec_id, round(dist, 5) + 0.0 AS dist FROM (SELECT query_id, vec_id, dist,
         row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM mk WHERE kept) WHERE rank <= 10"""
)
def rq_search_exbits(spark, sf_dir):
    """Two-round pruned search re-ranked by signs and four extra bits."""
    base, cents, config, postings = _postings(spark, sf_dir, bits=5)
    return rounded(index.search(postings, asked(base), cents, config, SearchConfig(k=K, nprobe=3)), "dist", digits=5)


def _scalar_sql(tail: str) -> str:
    return with_(B, "un AS (SELECT vec_id AS id, vec_id AS cid, j, x AS r, 0 AS c, abs(x) / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS a FROM (SELECT vec_id, j - 1 AS j, v[j] AS x FROM b, range(1, 65) t(j)))", SCALE, "cd AS (SELECT un.*, (SELECT count(*) FROM range(1, 16) z(k) WHERE a > 0 AND k / a <= t * (1 + 1e-12)) AS lev FROM un JOIN best USING (id))", "fu AS (SELECT *, CASE WHEN r < 0 THEN 15 - lev ELSE lev + 16 END AS code FROM cd)", "dl AS (SELECT id, sum(r * (code - 15.5)) / sum((code - 15.5) * (code - 15.5)) AS delta FROM fu GROUP BY id)") + tail


def _scalar(spark, sf_dir):
    def kernel(col):
        code, delta, low = kernels.scalar_quantize(matrix(col["embedding"]), 5, "reconstruction")
        return {"vec_id": col["vec_id"], "code": list(code), "delta": delta, "low": low}

    return map_arrow(vectors(spark, sf_dir).select("vec_id", "embedding"), kernel, "vec_id long,code array<long>,delta double,low double")


@query(_scalar_sql(f"SELECT id AS vec_id, string_agg(printf('%02X', code), '' ORDER BY j) AS code, {r6('delta')} AS delta, {r6('-15.5 * delta')} AS low FROM fu JOIN dl USING (id) GROUP BY id, delta"))
def scalar_quantize(spark, sf_dir):
    rows = _scalar(spark, sf_dir)
    return rounded(rows.withColumn("code", F.array_join(F.transform("code", lambda x: F.lpad(F.hex(x), 2, "0")), "")), "delta", "low")


@query(_scalar_sql(f"SELECT id AS vec_id, j AS pos, {r6('(code - 15.5) * delta')} AS x FROM fu JOIN dl USING (id)"))
def reconstruct(spark, sf_dir):
    back = F.transform("code", lambda c: c * F.col("delta") + F.col("low"))
    rows = _scalar(spark, sf_dir).select("vec_id", F.posexplode(back).alias("pos", "x"))
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "x")


# --- ground truth and evaluation


def _truth(spark, sf_dir, k=K, twice=False):
    base = vectors(spark, sf_dir)
    return knn.exact_knn(doubled(base) if twice else base, asked(base), k)


FOUND3 = f"""fd AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM
    (SELECT query_id, vec_id, {D} AS dist FROM pr JOIN b ON label = cid) QUALIFY rank <= 10)"""


def _found(spark, sf_dir, n=3):
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    return index.search_raw(index.centroid_order(labelled(base), cents), asked(base), cents, n, K)


@query(
    with_(B, Q, C, KNN, PROBE.format(n=3), FOUND3)
    + f"SELECT 10::BIGINT AS k, (SELECT count(*) FROM q) AS queries, count(*) AS hits, {r6('count(*) / ((SELECT count(*) FROM q) * 10)')} AS recall FROM fd JOIN k USING (query_id, vec_id)"
)
def recall_plain(spark, sf_dir):
    return rounded(knn.recall(_found(spark, sf_dir), _truth(spark, sf_dir), K), "recall")


TIED = "f5 AS (SELECT * FROM k WHERE rank <= 5 OR dist <= (SELECT dist FROM k AS x WHERE x.query_id = k.query_id AND x.rank = 5))"


@query(
    with_(B, Q, TWICE, TKNN, TIED, "fw AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id DESC) AS rank FROM k)")
    + f"SELECT 5::BIGINT AS k, (SELECT count(*) FROM q) AS queries, count(*) AS hits, {r6('count(*) / ((SELECT count(*) FROM q) * 5)')} AS recall FROM fw JOIN f5 USING (query_id, vec_id) WHERE fw.rank <= 5"
)
def recall_ties(spark, sf_dir):
    """Every vector twice; the results prefer the other copy, which counts as tied with the fifth."""
    truth = _truth(spark, sf_dir, twice=True)
    other = Window.partitionBy("query_id").orderBy("dist", F.desc("vec_id"))
    found = truth.withColumn("rank", F.row_number().over(other).cast("long"))
    return rounded(knn.recall(found, truth, 5, ties=True), "recall")


@query(
    with_(B, Q, TWICE, TKNN)
    + """SELECT query_id, count(*) FILTER (rank >= 5 AND dist = edge) AS tie_window, max(rank) AS depth, max(dist) = max(edge) AS saturated
         FROM (SELECT *, max(CASE WHEN rank = 5 THEN dist END) OVER (PARTITION BY query_id) AS edge FROM k) GROUP BY query_id"""
)
def tie_windows(spark, sf_dir):
    return knn.tie_windows(_truth(spark, sf_dir, twice=True), 5)


@query(
    with_(B, Q, TWICE, TKNN)
    + """SELECT query_id, count(DISTINCT dist) AS distinct_dists, max(run) AS longest_run, 0::BIGINT AS duplicate_ids
         FROM (SELECT query_id, dist, count(*) AS run FROM k GROUP BY query_id, dist) GROUP BY query_id"""
)
def tie_stats(spark, sf_dir):
    return knn.tie_stats(_truth(spark, sf_dir, twice=True))


#: Ground truth with planted faults: every third query has two ranks swapped, every seventh lists an id twice.
FAULTY = """g AS (SELECT query_id, rank, CASE WHEN query_id % 7 = 0 AND rank = 4 THEN lag(vec_id) OVER w ELSE vec_id END AS vec_id,
    CASE WHEN query_id % 3 = 0 AND rank = 6 THEN dist - 0.5 ELSE dist END AS dist FROM k WINDOW w AS (PARTITION BY query_id ORDER BY rank))"""


def _faulty(truth):
    by = Window.partitionBy("query_id").orderBy("rank")
    twice = F.when((F.col("query_id") % 7 == 0) & (F.col("rank") == 4), F.lag("vec_id").over(by)).otherwise(F.col("vec_id"))
    fall = F.when((F.col("query_id") % 3 == 0) & (F.col("rank") == 6), F.col("dist") - 0.5).otherwise(F.col("dist"))
    return truth.select("query_id", "rank", twice.alias("vec_id"), fall.alias("dist"))


@query(
    with_(B, Q, TWICE, TKNN, FAULTY)
    + """SELECT query_id, count(DISTINCT dist) AS distinct_dists, max(run) AS longest_run, sum(run)::BIGINT - max(ids) AS duplicate_ids
         FROM (SELECT query_id, dist, count(*) AS run FROM g GROUP BY query_id, dist) JOIN (SELECT query_id, count(DISTINCT vec_id) AS ids FROM g GROUP BY query_id) USING (query_id) GROUP BY query_id"""
)
def tie_stats(spark, sf_dir):
    return knn.tie_stats(_faulty(_truth(spark, sf_dir, twice=True)))


FALLS = """fa AS (SELECT query_id, min(step) AS low FROM (SELECT query_id, dist - lag(dist) OVER (PARTITION BY query_id ORDER BY rank) AS step FROM g) GROUP BY query_id)"""


@query(with_(B, Q, KNN, FAULTY, FALLS) + f"SELECT count(*) FILTER (low < -1e-6) AS bad_rows, {r6('least(min(low), 0.0)')} AS worst_drop, min(query_id) FILTER (low < -1e-6) AS example FROM fa")
def gt_ascending(spark, sf_dir):
    return rounded(knn.ascending(_faulty(_truth(spark, sf_dir))), "worst_drop")


VERDICT = """SELECT CASE WHEN bad_rows > 0 OR duplicates > 0 THEN 'fail' WHEN saturated > 0 THEN 'warn' ELSE 'ok' END AS status, bad_rows, saturated, duplicates FROM
    (SELECT (SELECT count(*) FROM fa WHERE low < -1e-6) AS bad_rows,
            (SELECT count(*) FROM (SELECT query_id FROM g GROUP BY query_id HAVING max(dist) FILTER (rank = 10) = max(dist) FILTER (rank = 5))) AS saturated,
            (SELECT count(*) - count(DISTINCT (query_id, vec_id)) FROM g) AS duplicates)"""


@query(with_(B, Q, TWICE, TKNN, FAULTY, FALLS) + VERDICT)
def gt_verdict(spark, sf_dir):
    return knn.verdict(_faulty(_truth(spark, sf_dir, twice=True)), 5)


@query(with_(B, Q, TWICE, TKNN, "g AS (SELECT * FROM k)", FALLS) + VERDICT)
def gt_verdict_sound(spark, sf_dir):
    return knn.verdict(_truth(spark, sf_dir, twice=True), 5)


@query(
    with_(B, Q, KNN, TWICE, "ed AS (SELECT query_id, dist::FLOAT AS edge FROM k WHERE rank = 10)")
    + f"""SELECT query_id, count(*) FILTER (({D})::FLOAT < edge) AS closer, count(*) FILTER (({D})::FLOAT = edge) AS tied,
          count(*) FILTER (({D})::FLOAT <= edge) AS depth_needed FROM ed JOIN q USING (query_id), t GROUP BY query_id"""
)
def tie_group_size(spark, sf_dir):
    """How many of all vectors, each there twice, are closer than or tied with the tenth neighbour."""
    base = vectors(spark, sf_dir)
    return knn.tie_groups(knn.exact_knn(base, asked(base), K), doubled(base), asked(base), K)


@query(
    with_(B, Q, C, KNN, PROBE.format(n=3), FOUND3)
    + f"SELECT query_id, {r6('sum(sqrt(fd.dist / k.dist)) * 10 / count(*)')} AS ratio FROM fd JOIN k USING (query_id, rank) WHERE k.dist > 1e-5 GROUP BY query_id"
)
def distance_ratio(spark, sf_dir):
    return rounded(knn.distance_ratio(_found(spark, sf_dir), _truth(spark, sf_dir), K), "ratio")


@query(
    with_(B, Q, KNN)
    + f"""SELECT rank, {r6('avg(dist)')} AS mean, {r6('quantile_cont(dist, 0.5)')} AS p50, {r6('quantile_cont(dist, 0.9)')} AS p90, {r6('quantile_cont(dist, 0.95)')} AS p95,
          {r6('quantile_cont(dist, 0.99)')} AS p99, {r6('quantile_cont(dist, 0.999)')} AS p999, {r6('max(dist)')} AS max FROM k GROUP BY rank"""
)
def percentiles(spark, sf_dir):
    names = ("mean", "p50", "p90", "p95", "p99", "p999", "max")
    return rounded(evaluate.percentiles(_truth(spark, sf_dir), "dist", ["rank"]), *names)


ALLPROBES = f"""ap AS (SELECT query_id, w, cid, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, c), cid) AS pr FROM q, c),
    hit AS (SELECT pr, count(*) AS h FROM k JOIN b USING (vec_id) JOIN ap ON ap.query_id = k.query_id AND ap.cid = b.label GROUP BY pr),
    pts AS (SELECT i AS op_param, (SELECT coalesce(sum(h), 0) FROM hit WHERE pr <= i) / ((SELECT count(*) FROM q) * 10)::DOUBLE AS recall FROM range(1, 11) z(i))"""


def _recall_points(spark, sf_dir):
    """Recall at every probe count from one pass: a true neighbour is found once its cluster's rank is probed."""
    base = vectors(spark, sf_dir)
    cents, q = label_centroids(base), asked(base)
    truth = knn.exact_knn(base, q, K)
    at = index.probes(q, cents, 10).select("query_id", F.col("rank").alias("op_param"), "cid")
    homes = truth.select("query_id", "vec_id").join(labelled(base).select("vec_id", "cid"), "vec_id").join(at, ["query_id", "cid"])
    hits = homes.groupBy("op_param").agg(F.count("*").alias("h"))
    n = truth.agg(F.countDistinct("query_id")).first()[0]
    steps = spark.range(1, 11).select(F.col("id").alias("op_param")).join(hits, "op_param", "left")
    run = Window.orderBy("op_param").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("op_param", (F.coalesce(F.sum("h").over(run), F.lit(0)) / F.lit(n * K)).alias("recall"))


@query(with_(B, Q, C, KNN, ALLPROBES) + f"SELECT op_param, {r6('recall')} AS recall FROM pts")
def recall_map(spark, sf_dir):
    return rounded(_recall_points(spark, sf_dir), "recall")


@query(
    with_(B, Q, C, KNN, ALLPROBES, "up AS (SELECT op_param, max(recall) OVER (ORDER BY op_param) AS r FROM pts)", "stp AS (SELECT op_param, r, lag(r) OVER (ORDER BY op_param) AS r0, lag(op_param) OVER (ORDER BY op_param) AS p0 FROM up)", "tg AS (SELECT 0.5 + 0.05 * i AS target FROM range(0, 10) z(i))")
    + """SELECT round(target, 2)::DOUBLE AS target, CAST(round(CASE WHEN r0 IS NULL THEN op_param ELSE exp(ln(p0) + (ln(op_param) - ln(p0)) * (target - r0) / (r - r0)) END) AS BIGINT) AS op_param
         FROM tg JOIN stp ON target <= r AND (r0 IS NULL OR target > r0)"""
)
def recall_interp(spark, sf_dir):
    targets = spark.range(10).select((F.lit(0.5) + F.lit(0.05) * F.col("id")).alias("target"))
    found = evaluate.at_recall(_recall_points(spark, sf_dir), targets)
    return found.select(F.round("target", 2).alias("target"), "op_param")


@query(
    with_(B, Q, C, KNN, ALLPROBES, "g AS (SELECT * FROM range(1, 3) a(topk), range(1, 3) b(threads))", "tg AS (SELECT unnest([0.5, 0.7, 0.9, 1.5]) AS target)")
    + "SELECT topk, threads, target::DOUBLE AS target, min(op_param) FILTER (recall / topk >= target) AS op_param FROM g, tg, pts GROUP BY ALL"
)
def op_points_first_reach(spark, sf_dir):
    grid = spark.range(1, 3).select(F.col("id").alias("topk")).join(spark.range(1, 3).select(F.col("id").alias("threads")))
    results = grid.join(_recall_points(spark, sf_dir)).select("topk", "threads", "op_param", (F.col("recall") / F.col("topk")).alias("recall_at_topk"))
    targets = spark.createDataFrame([(0.5,), (0.7,), (0.9,), (1.5,)], "target double")
    return evaluate.first_reaching(results, targets)


@query(PAGED + f"SELECT count(DISTINCT query_id) AS queries, {r6('count(*) FILTER (kept) / count(*)')} AS examined_share, {r6('count(*) FILTER (kept) / count(DISTINCT (query_id, page_id)) FILTER (kept)')} AS records_per_page, {r6('count(*) / count(DISTINCT (query_id, cid))')} AS candidates_per_cluster FROM pg")
def scan_ratios(spark, sf_dir):
    rows = evaluate.scan_ratios(index.counters(_marks(spark, sf_dir)))
    return rounded(rows, "examined_share", "records_per_page", "candidates_per_cluster")


@query(with_(B) + "SELECT vec_id, label FROM b WHERE vec_id < 300")
def prefix_scan(spark, sf_dir):
    """The first rows of a collection are a feature: a filter on the id, pushed to the scan."""
    return vectors(spark, sf_dir).where("vec_id < 300").select("vec_id", F.col("label").cast("long"))


@query(with_("b AS (SELECT vec_id, label::BIGINT AS label FROM embeddings)", "n AS (SELECT max(vec_id) + 1 AS n FROM b)") + "SELECT vec_id, label FROM b WHERE vec_id < 600 UNION ALL SELECT vec_id + n, label FROM b, n WHERE vec_id + n < 600")
def chunk_prefix(spark, sf_dir):
    """The first 600 rows of the collection followed by itself: a prefix over chunks is the feature."""
    from orrery.sources.vector_files import concat_chunks

    base = vectors(spark, sf_dir)
    labels = doubled(base).select("vec_id", F.col("label").cast("long"))
    return concat_chunks([base, base], 600).join(labels, "vec_id").select("vec_id", "label")


@query(
    with_(ROTATED, "g AS (SELECT id, sum(x * x) AS n2, sum(x * CASE WHEN x > 0 THEN 0.5 ELSE -0.5 END) AS xu FROM m3 GROUP BY id)")
    + f"SELECT id AS vec_id, {r6('n2')} AS f_add, {r6('-2 * n2 / xu')} AS f_rescale, {r6('2 * 1.9 * sqrt(n2) * sqrt(greatest(0, (n2 * 16 / (xu * xu) - 1) / 63))')} AS f_error FROM g"
)
def onebit_factors_origin(spark, sf_dir):
    """Codes relative to the origin."""
    turn = kernels.rotation_matrix(64, SEED)

    def kernel(col):
        _, add, rescale, error = kernels.onebit(matrix(col["embedding"]) @ turn, None, "l2")
        return {"vec_id": col["vec_id"], "f_add": add, "f_rescale": rescale, "f_error": error}

    rows = map_arrow(vectors(spark, sf_dir).select("vec_id", "embedding"), kernel, "vec_id long,f_add double,f_rescale double,f_error double")
    return rounded(rows, "f_add", "f_rescale", "f_error")


@query(
    with_(B, "m AS (SELECT vec_id, label, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS s FROM b)")
    + """SELECT q.vec_id AS query_id, m.vec_id, CAST(list_dot_product(q.s::DOUBLE[], m.s::DOUBLE[]) AS BIGINT) AS common,
         CAST(list_sum(q.s) + list_sum(m.s) - 2 * list_dot_product(q.s::DOUBLE[], m.s::DOUBLE[]) AS BIGINT) AS hamming
         FROM m JOIN m AS q USING (label) WHERE q.vec_id % 20 = 0"""
)
def binary_dot(spark, sf_dir):
    """Products and distances of sign codes by bit counts, within a cluster."""
    code = F.aggregate(F.transform("embedding", lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(x))
    rows = vectors(spark, sf_dir).select("vec_id", "label", code.alias("code"))
    q = asked(rows).select(F.col("vec_id").alias("query_id"), "label", F.col("code").alias("c"))
    both = rows.join(q, "label")
    return both.select("query_id", "vec_id", F.bit_count(F.col("code").bitwiseAND(F.col("c"))).cast("long").alias("common"), F.bit_count(F.col("code").bitwiseXOR(F.col("c"))).cast("long").alias("hamming"))


@query(with_(B, PAGES) + "SELECT CAST(sum(n) * 28 AS BIGINT) AS mem_bytes, CAST(sum(pages) * 4096 AS BIGINT) AS ssd_bytes FROM f")
def index_bytes(spark, sf_dir):
    sizes = labelled(vectors(spark, sf_dir)).groupBy("cid").agg(F.count("*").alias("n"))
    return evaluate.index_bytes(IndexConfig(64, store="raw"), sizes)


# --- more of the above: other metrics, widths, query bits and kinds


@query(
    with_(B)
    + f"""SELECT query_id, rank, vec_id, {r6('dist')} AS dist FROM (SELECT x.vec_id AS query_id, y.vec_id, list_distance(x.v, y.v) ** 2 AS dist,
          row_number() OVER (PARTITION BY x.vec_id ORDER BY list_distance(x.v, y.v) ** 2, y.vec_id) AS rank FROM b AS x JOIN b AS y ON x.vec_id <> y.vec_id) WHERE rank <= 3"""
)
def knn_self_join(spark, sf_dir):
    return rounded(knn.others(vectors(spark, sf_dir), 3), "dist")


K11 = KNN.replace("rank <= 10", "rank <= 11")


@query(
    with_(B, Q, K11)
    + """SELECT query_id, round(margin, 6) + 0.0 AS margin, round(fl * 16777216, 6) + 0.0 AS floor, margin < fl * 50 AS thin FROM (
         SELECT k.query_id, max(dist) FILTER (rank = 11) - max(dist) FILTER (rank = 10) AS margin, max(list_dot_product(v, v)) FILTER (rank = 10) / 16777216 AS fl FROM k JOIN b USING (vec_id) GROUP BY k.query_id)"""
)
def gt_margins(spark, sf_dir):
    base = vectors(spark, sf_dir)
    rows = knn.margins(knn.exact_knn(base, asked(base), K + 1), base, K, K + 1)
    return rounded(rows.withColumn("floor", F.col("floor") * 2.0**24), "margin", "floor")


@query(
    with_(B, Q, KNN, "n AS (SELECT count(*) AS n FROM b)")
    + "SELECT count(*) FILTER (vec_id + 300 >= n) AS bad_ids, count(DISTINCT query_id) FILTER (vec_id + 300 >= n) AS bad_queries, max(vec_id + 300) FILTER (vec_id + 300 >= n) AS largest FROM k, n"
)
def gt_out_of_range(spark, sf_dir):
    """Ground truth whose ids are off by 300: what the guard before an evaluation finds."""
    base = vectors(spark, sf_dir)
    return knn.out_of_range(_truth(spark, sf_dir).withColumn("vec_id", F.col("vec_id") + 300), base.count())


@query(with_(B, Q, C, PROBE.format(n=3)) + "SELECT query_id, rank, cid, round(dist, 5) + 0.0 AS dist FROM pr")
def hnsw_alias(spark, sf_dir):
    """The kind ``hnsw`` stands for probing by an index over the centroids."""
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    own = coarse.build(cents, _config(), cents.select("cid", (F.col("cid") % 3).alias("inner")), refine="full")
    return rounded(coarse.choose(asked(base), cents, _config(), SearchConfig(nprobe=3, coarse="hnsw", irq_mode="full"), own), "dist", digits=5)


@query(
    with_(B, Q, C, "i AS (SELECT inn, list(m ORDER BY j) AS c FROM (SELECT cid % 3 AS inn, j, avg(c[j]) AS m FROM c, range(1, 65) t(j) GROUP BY ALL) GROUP BY inn)",
          "s AS (SELECT query_id, w, inn FROM (SELECT query_id, w, inn, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, c), inn) AS r FROM q, i) WHERE r <= 2)")
    + """SELECT query_id, rank, cid, round(dist, 5) + 0.0 AS dist FROM (SELECT query_id, cid, list_distance(w, c) AS dist,
         row_number() OVER (PARTITION BY query_id ORDER BY list_distance(w, c), cid) AS rank FROM s JOIN c ON cid % 3 = inn) WHERE rank <= 3"""
)
def irq_kfixed_probe(spark, sf_dir):
    """Half as many inner clusters as wanted ones, rounded up, are scanned: two of three."""
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    own = coarse.build(cents, _config(), cents.select("cid", (F.col("cid") % 3).alias("inner")), refine="full")
    return rounded(coarse.probe(asked(base), own, 3, "kfixedmult", 0.5), "dist", digits=5)


@query()
def irq_kfixed_exbits(spark, sf_dir):
    """The same, refined by extra bits; the tests compare it with flat probing by recall."""
    base = vectors(spark, sf_dir)
    cents = label_centroids(base)
    own = coarse.build(cents, _config(), cents.select("cid", (F.col("cid") % 3).alias("inner")))
    return rounded(coarse.probe(asked(base), own, 3, "kfixedmult", 0.5), "dist")


@query(
    with_(B, C, "h AS (SELECT label AS cell, vec_id AS cid, v AS c FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM b) WHERE r <= 4)",
          "p AS (SELECT vec_id, v, cid AS cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c) ** 2, cid) AS r FROM b, c)",
          "x AS (SELECT vec_id, cid FROM (SELECT vec_id, h.cid, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, h.c) ** 2, h.cid) AS r FROM b, h) WHERE r = 1)",
          "s AS (SELECT probes, vec_id, cid FROM (SELECT probes, vec_id, h.cid, row_number() OVER (PARTITION BY probes, vec_id ORDER BY list_distance(v, h.c) ** 2, h.cid) AS o FROM p JOIN h USING (cell) JOIN (SELECT unnest([1, 2, 4, 10]) AS probes) ON r <= probes) WHERE o = 1)")
    + f"SELECT probes::BIGINT AS probes, count(*) AS rows, {r6('avg(CASE WHEN s.cid = x.cid THEN 1.0 ELSE 0.0 END)')} AS recall FROM s JOIN x USING (vec_id) GROUP BY probes"
)
def assign_probe_sweep(spark, sf_dir):
    """Recall of two-level assignment for growing numbers of cells."""
    base = vectors(spark, sf_dir)
    return rounded(clustering.probe_sweep(base, label_centroids(base), _children(base), [1, 2, 4, 10]), "recall")


@query(with_(RESID, UNIT, SCALE, EXCODE, NORMS) + f"SELECT ef.id AS vec_id, {r6('1 - rc + ef.n2 * cw / rw')} AS f_add_ex, {r6('-sqrt(ef.n2) / along')} AS f_rescale_ex FROM ef JOIN g ON g.id = ef.id AND g.cid = ef.cid")
def exbits_factors_ip(spark, sf_dir):
    rows = _postings(spark, sf_dir, bits=5, metric="ip")[3].select("vec_id", "f_add_ex", "f_rescale_ex")
    return rounded(rows, "f_add_ex", "f_rescale_ex")


def _kinds_sql() -> str:
    tail = f"""SELECT id AS vec_id, {r6('sqrt(n2 / s2) / (dot / sqrt(n2 * s2))')} AS unbiased, {r6('sqrt(n2 / s2)')} AS plain
               FROM (SELECT id, sum(r * r) AS n2, sum((code - 15.5) * (code - 15.5)) AS s2, sum(r * (code - 15.5)) AS dot FROM fu GROUP BY id)"""
    return _scalar_sql(tail)


@query(_kinds_sql())
def scalar_quantize_kinds(spark, sf_dir):
    """Steps of the kinds that keep inner products right on average, and lengths."""

    def kernel(col):
        x = matrix(col["embedding"])
        return {"vec_id": col["vec_id"], **{kind: kernels.scalar_quantize(x, 5, kind)[1] for kind in ("unbiased", "plain")}}

    return rounded(map_arrow(vectors(spark, sf_dir).select("vec_id", "embedding"), kernel, "vec_id long,unbiased double,plain double"), "unbiased", "plain")


_Y4 = "lim4 AS (SELECT id, min(x) AS lo, (max(x) - min(x)) / 15 AS step FROM y3 GROUP BY id), y4 AS (SELECT id, j, lo + step * least(15, floor((x - lo) / step + 0.5)) AS x FROM y3 JOIN lim4 USING (id)),"
SMALL = ESTIMATE.replace("FROM pr JOIN y3 ON", "FROM pr JOIN y4 AS y3 ON").replace("dots AS (", _Y4 + " dots AS (")


@query(with_(RESID, NORMS, Q, PROBE.format(n=3), SMALL) + "SELECT query_id, vec_id, cid, round(est, 5) + 0.0 AS est, round(low, 5) + 0.0 AS low FROM est")
def query4_estimate(spark, sf_dir):
    """Estimates from queries of four bits a coordinate."""
    base, cents, config, postings = _postings(spark, sf_dir)
    rows = index.estimates(postings, asked(base), cents, config, 3, query_bits=4)
    return rounded(rows.select("query_id", "vec_id", "cid", "est", "low"), "est", "low", digits=5)


#: Vectors of 128 dimensions: each with the next one's after it.
WIDE = "w AS (SELECT x.vec_id, x.label, list_concat(x.v, y.v) AS v FROM b AS x JOIN b AS y ON y.vec_id = (x.vec_id + 1) % (SELECT count(*) FROM b))"


def _wide(base: DataFrame) -> DataFrame:
    n = base.count()
    after = base.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("embedding").alias("more"))
    return base.join(after, "vec_id").select("vec_id", F.col("label").cast("long").alias("cid"), F.concat("embedding", "more").alias("embedding"))


def _wide_sql() -> str:
    width = lambda x: x.replace("range(0, 64)", "range(0, 128)").replace("r * 64 + j", "r * 128 + j").replace("/ 8 AS x", "/ sqrt(128) AS x")
    parts = [
        B, WIDE, width(FLIPS),
        "l AS (SELECT vec_id AS id, j - 1 AS j, v[j] AS x FROM w, range(1, 129) t(j))", width(_turned("l", "m")),
        "lc AS (SELECT label AS id, j - 1 AS j, avg(v[j]) AS x FROM w, range(1, 129) t(j) GROUP BY label, j)", width(_turned("lc", "n")),
        "e AS (SELECT m3.id, label AS cid, m3.j, n3.x AS c, m3.x - n3.x AS r, CASE WHEN m3.x - n3.x > 0 THEN 1 ELSE 0 END AS bit FROM m3 JOIN w ON vec_id = m3.id JOIN n3 ON n3.id = label AND n3.j = m3.j)",
        "g AS (SELECT id, sum(r * r) AS n2, sum(r * (bit - 0.5)) AS ru, sum(CASE WHEN j < 64 THEN c * (bit - 0.5) ELSE 0 END) AS cu, string_agg(CASE WHEN j < 64 THEN bit::VARCHAR ELSE '' END, '' ORDER BY j) AS bits FROM e GROUP BY id)",
    ]
    return with_(*parts) + f"SELECT id AS vec_id, bits, {r6('n2 + 4 * n2 * cu / ru')} AS f_add, {r6('-4 * n2 / ru')} AS f_rescale, {r6('2 * 1.9 * sqrt(n2) / 8')} AS f_error FROM g"


@query(_wide_sql())
def prefix_factors(spark, sf_dir):
    """Half of 128 dimensions resident: signs and factors of the prefix."""
    rows = _wide(vectors(spark, sf_dir))
    cents = clustering.centroids(rows)
    postings = index.build(rows, cents, IndexConfig(128, memdim=64, seed=SEED))
    bits = F.concat(*[F.lpad(F.conv(F.substring(F.hex("bits"), 4 * i + 1, 4), 16, 2), 16, "0") for i in range(4)])
    return rounded(postings.select("vec_id", bits.alias("bits"), "f_add", "f_rescale", "f_error"), "f_add", "f_rescale", "f_error")


@query()
def prefix_search(spark, sf_dir):
    """Search with half of 128 dimensions resident; the tests compare it with exact search by recall."""
    rows = _wide(vectors(spark, sf_dir))
    cents, config = clustering.centroids(rows), IndexConfig(128, memdim=64, seed=SEED)
    return rounded(index.search(index.build(rows, cents, config), asked(rows), cents, config, SearchConfig(k=K, nprobe=10)), "dist")


@query("SELECT vec_id, j - 1 AS pos, embedding[j]::DOUBLE AS x FROM embeddings, range(1, 65) t(j)")
def file_roundtrip(spark, sf_dir):
    """All vectors through a file with one header and a folder of files with a width for each row."""
    from orrery.sources import vector_files
    from orrery.storage import shared_folder

    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    folder = folder if ":" in folder else f"file://{folder}"
    system, path = vector_files._at(folder)
    system.create_dir(path, recursive=True)
    vector_files.write_vectors(vectors(spark, sf_dir), f"{folder}/a.fbin")
    vector_files.write_vectors(spark.read.format("vectorfile").load(f"{folder}/a.fbin"), f"{folder}/b.fvecs", parts=True)
    rows = spark.read.format("vectorfile").load(f"{folder}/b.fvecs").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))


__all__ = ["QUERIES", "SQL", "EvalConfig"]
