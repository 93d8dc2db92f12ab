"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, language_id, license_scan, mixing, near_dedup, packing, tiff, toxicity, url_filter, warc
from orrery.llm.common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op2_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.digests(tiff.encode_texts(table(spark, sf_dir, "documents")))


RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages"), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict", "template")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source: source/a/b/id.txt, every sixteenth the LICENSE of a directory above."""
    docs = table(spark, sf_dir, "documents")
    part = lambda n: F.pmod(F.floor(F.col("doc_id") / n), F.lit(64)).cast("string")
    top, below = F.concat_ws("/", F.coalesce("source", F.lit("none")), part(16)), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.when(F.col("doc_id") % 16 == 0, F.concat_ws("/", top, F.lit("LICENSE"))).otherwise(F.concat_ws("/", top, part(1024), below))
    return license_scan.license_of_files(docs.select("doc_id", path.alias("path"), "text"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages"), folder), folder, payloads=False)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = language_id.learnable(F.col("doc_id"))
    found = language_id.identify(docs, language_id.fit(docs.where(learn)))
    return found.select("doc_id", (~learn).alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    found = toxicity.score(docs, model)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_tiff, op3_urls, op4_licenses, op5_mix, op6_warc, op7_language, op8_toxicity, op9_pack, op10_exact_dedup)
    return {f.__name__: f for f in found}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op5_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                 CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-' || sha256(coalesce(text, '')))), 1, 13) AS BIGINT) AS draw
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, list_value(5, 2, 1)[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS w FROM s),
        r AS (
          SELECT *, CAST(source_size * 3 AS DOUBLE) / w AS lim,
                 sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0) AS left_over,
                 sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS rest
          FROM w WINDOW b AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / w, source ASC NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, CAST(left_over AS DOUBLE) / CAST(rest AS DOUBLE) AS free FROM r),
        o AS (SELECT *, free * w <= source_size * 3 AS is_open FROM f),
        l AS (SELECT *, first_value(free) OVER (ORDER BY is_open DESC, lim, source ASC NULLS LAST) AS level FROM o),
        t AS (SELECT source, source_size,
                     CASE WHEN is_open THEN level * w ELSE CAST(source_size * 3 AS DOUBLE) END AS target FROM l),
        z AS (SELECT source, CAST(sum(floor(size * 1000 / (size + 50)) * size) AS BIGINT) AS rs FROM d GROUP BY source),
        e AS (
          SELECT d.*, source_size, target, floor(size * 1000 / (size + 50)) AS r,
                 CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS p,
                 CASE WHEN source_size > 0 THEN CAST(rs AS DOUBLE) / source_size ELSE 0.0::DOUBLE END AS m
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN z ON d.source IS NOT DISTINCT FROM z.source),
        g AS (SELECT *, p + least(p, 3 - p) * 0.5::DOUBLE * (r - m) / 1000 AS e FROM e),
        h AS (SELECT *, floor(e) AS whole, e - floor(e) AS f, (draw + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM g),
        q AS (SELECT *, CASE WHEN f > 0 AND size > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q,
                     target - sum(CAST(whole AS BIGINT) * size) OVER (PARTITION BY source) AS lack FROM h),
        i AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, draw, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM q)
        SELECT doc_id, size, source_size, target,
               CAST((whole + CASE WHEN q IS NOT NULL AND so_far + size / 2 <= lack THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
        FROM i""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
                     max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q""",
    "op10_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
