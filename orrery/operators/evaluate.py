"""Recall, percentiles, operating points and result rows of an evaluation."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.config import EvalConfig, IndexConfig, SearchConfig

#: The result row, in order; what can't be filled is null.
RESULT = (
    "run_id string, system string, dataset string, metric_space string, topk int, threads int, io_backend string, cache_state string, rounds int, nq int, "
    "op_param_name string, op_param double, recall_at_topk double, qps double, lat_mean_us double, lat_p50_us double, lat_p95_us double, lat_p99_us double, "
    "lat_p999_us double, io_reqs_mean double, io_pages_mean double, io_bytes_mean double, io_pages_p99 double, io_pages_max double, io_bytes_p99 double, "
    "io_bytes_max double, eff_bw_mbps double, eff_iops double, cpu_util_pct double, peak_rss_mb double, resident_index_mb double, index_ssd_bytes long"
)
MANIFEST = "index_id string, system string, dataset string, build_params string, build_s double, build_peak_rss_mb double, index_mem_bytes long, index_ssd_bytes long"


def percentiles(df: DataFrame, value: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """mean, p50, p90, p95, p99, p999 and max of a column, linearly interpolated."""
    at = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), *[F.percentile(value, p).alias(n) for n, p in at.items()], F.max(value).alias("max"))


def per_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def scan_ratios(counters: DataFrame) -> DataFrame:
    """The funnel of a scan: shares of records among candidates, records a page, candidates a cluster."""
    s = counters.agg(*[F.sum(c).alias(c) for c in ("clusters", "candidates", "records", "pages")], F.count("*").alias("queries"))
    return s.select("queries", per_div(F.col("records"), F.col("candidates")).alias("examined_share"), per_div(F.col("records"), F.col("pages")).alias("records_per_page"), per_div(F.col("candidates"), F.col("clusters")).alias("candidates_per_cluster"))


def bound_label(io_share: Column) -> Column:
    return F.when(io_share > 0.5, "io").when(io_share < 0.2, "compute").otherwise("mixed")


def ladder(k: int, clusters: int, rows: int) -> list[int]:
    """Probe counts to try: from what could hold k points, growing by 1.4 until all clusters."""
    found, x = [], max(1, math.ceil(k * clusters / max(1, rows)))
    while x < clusters:
        found.append(x)
        x = max(x + 1, int(x * 1.4 + 0.5))
    return [*found, clusters]


def recall_map(spark: SparkSession, points: list[int], measure, config: EvalConfig = EvalConfig()) -> DataFrame:  # noqa: B008
    """(op_param, recall) for growing probe counts; stops past the plateau or when two steps gain less than 0.0001."""
    rows, still, above = [], 0, 0
    for p in points:
        r = measure(p)
        still = still + 1 if rows and r - rows[-1][1] < 1e-4 else 0
        above += r >= config.plateau
        rows.append((int(p), float(r)))
        if still == 2 or above > config.high_keep:
            break
    return spark.createDataFrame(rows, "op_param long, recall double")


def at_recall(points: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, op_param): the map made monotone, log-interpolated where it first reaches each target."""
    run = Window.orderBy("op_param").rowsBetween(Window.unboundedPreceding, 0)
    up = points.withColumn("r", F.max("recall").over(run))
    order = Window.orderBy("op_param")
    step = up.select("op_param", "r", F.lag("r").over(order).alias("r0"), F.lag("op_param").over(order).alias("p0"))
    t = F.col("target")
    x = F.when(F.col("r0").isNull(), F.col("op_param")).otherwise(
        F.exp(F.log("p0") + (F.log("op_param") - F.log("p0")) * (t - F.col("r0")) / (F.col("r") - F.col("r0")))
    )
    hit = targets.join(step, (t <= F.col("r")) & (F.col("r0").isNull() | (t > F.col("r0"))))
    return hit.select("target", F.round(x).cast("long").alias("op_param"))


def first_reaching(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(topk, threads, target, op_param): per group the smallest parameter whose recall reaches the target, null if none."""
    groups = results.select("topk", "threads").distinct()
    all_ = groups.join(targets)
    hit = all_.join(results, ["topk", "threads"]).where(F.col("recall_at_topk") >= F.col("target"))
    best = hit.groupBy("topk", "threads", "target").agg(F.min("op_param").alias("op_param"))
    return all_.join(best, ["topk", "threads", "target"], "left")


def operating_points(points: DataFrame, config: EvalConfig = EvalConfig()) -> list[int]:  # noqa: B008
    """Interpolated probe counts for the recall band, a few below it and above it, sorted, each once."""
    spark = points.sparkSession
    n = int(round((config.high - config.low) / config.step))
    targets = spark.createDataFrame([(round(config.low + i * config.step, 6),) for i in range(n + 1)], "target double")
    inside = [r["op_param"] for r in at_recall(points, targets).collect()]
    rows = sorted((r["op_param"], r["recall"]) for r in points.collect())
    low, high = [p for p, r in rows if r < config.low], [p for p, r in rows if r > config.high]
    keep = low[:: max(1, len(low) // config.low_keep)] if low else []
    return sorted({*inside, *keep[: config.low_keep], *high[: config.high_keep]})


def result_row(spark: SparkSession, config: IndexConfig, options: SearchConfig, measured: dict) -> DataFrame:
    """One result row; the metric comes from the index."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    row = {"system": "orrery", "metric_space": config.metric, "topk": options.k, "op_param_name": "nprobe", "op_param": float(options.nprobe), "rounds": 1} | measured
    return spark.createDataFrame([tuple(row.get(n) for n in names)], RESULT)


def timed(action) -> tuple[object, float]:
    start = time.perf_counter()
    return action(), time.perf_counter() - start


def manifest_row(spark: SparkSession, made: dict, dataset: str, mem_bytes: int | None = None, ssd_bytes: int | None = None) -> DataFrame:
    """A row of the build manifest from what building reported."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]
    row = made | {"dataset": dataset, "index_mem_bytes": mem_bytes, "index_ssd_bytes": ssd_bytes}
    return spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST)


def index_bytes(config: IndexConfig, sizes: DataFrame) -> DataFrame:
    """(mem_bytes, ssd_bytes) by the layout: resident codes, three factors and an id for each vector; whole payload pages."""
    from orrery.config import PAGE, page_layout

    per_read, pages = page_layout(config.record_bytes())
    return sizes.agg((F.sum("n") * (config.prefix // 8 + 12 + 8)).alias("mem_bytes"), F.sum(F.ceil(F.col("n") / per_read) * pages * PAGE).alias("ssd_bytes"))


def diagnostics_row(counters: DataFrame, run_id: str, op_param: float) -> DataFrame:
    """The scan funnel of a run, keyed like its result row."""
    return scan_ratios(counters).select(F.lit(run_id).alias("run_id"), F.lit(float(op_param)).alias("op_param"), "*")


def throughput(df: DataFrame) -> DataFrame:
    """Adds qps, qps without the coarse part, bandwidth in MB/s, reads a second, the drain's share and what bounds a run.

    From (queries, seconds, coarse_s, io_s, drain_s, io_bytes, io_reqs) of each run.
    """
    rest = F.col("seconds") - F.col("coarse_s")
    return df.select(
        "*", per_div(F.col("queries"), F.col("seconds")).alias("qps"), per_div(F.col("queries"), rest).alias("qps_no_coarse"),
        per_div(F.col("io_bytes") / 1e6, F.col("seconds")).alias("eff_bw_mbps"), per_div(F.col("io_reqs"), F.col("seconds")).alias("eff_iops"),
        per_div(F.col("drain_s"), F.col("seconds")).alias("drain_share"), bound_label(F.coalesce(per_div(F.col("io_s"), F.col("seconds")), F.lit(0.0))).alias("bound"),
    )


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def assemble(rows: list[DataFrame]) -> DataFrame:
    """Result rows of several runs as one table; columns that a run lacks are null."""
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """A header once; one file, as result tables are small."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def parse_index_name(name: Column) -> list[Column]:
    """Parameters from names like deep_C1000_B9_M64_exbits."""
    part = lambda p: F.regexp_extract(name, p, 1)
    return [part(r"_C(\d+)").cast("long").alias("clusters"), part(r"_B(\d+)").cast("int").alias("bits"), part(r"_M(\d+)").cast("int").alias("memdim"), part(r"_(exbits|raw)$").alias("store")]
