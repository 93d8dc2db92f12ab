"""From raw documents to packed training sequences: five stages, each one operator over all that the last one kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next one's docs.

Defined results of every stage: no rows give no rows; columns besides doc_id, text and source are passed on as they are,
whatever their names. Decisions are made for rows, not for ids: where a doc_id is null or repeats, the rows get numbers of
their own (``_numbered``), so a row never goes because of what another row with its id holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import exact_dedup, language_id, mixing, near_dedup, packing
from orrery.llm.common import durable, quoted, shared_folder, table

#: So many ids are broadcast at most; more are joined by shuffles.
BROADCAST_IDS = 500_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, and the name of a column of longs that tells them apart.

    That is doc_id where it does; else the rows are written once with a number each, in the order of their ids.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return docs, "doc_id"
    name = f"row_{uuid.uuid4().hex}"
    return durable(docs.orderBy("doc_id").withColumn(name, F.monotonically_increasing_id())), name


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among ``ids``, which differ."""
    ids = durable(ids)
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language can be told (no text, or no letter in it); all others stay.

    Null and repeated ids make no difference; rows that repeat are judged each.
    """
    found = language_id.identify(docs, language_id.fit(docs), carry=True)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    A null text counts as empty. A null id is the smallest; of rows that repeat an id and a text one stays.
    """
    rows, key = _numbered(docs)
    found = exact_dedup.exact_dedup(rows, id_col=key)
    return _without(rows, found.where("NOT kept").select(key), key).select([quoted(x) for x in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without words all stay.

    A null id is the smallest; of rows that repeat the smallest id of a group one stays.
    """
    rows, key = _numbered(docs)
    found = near_dedup.near_dedup(rows, id_col=key)
    return _without(rows, found.where("NOT kept").select(key), key).select([quoted(x) for x in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    A null text has no words and is taken as its source's whole copies say; null sources are one source; rows with null or
    repeated ids are taken each by its own draw and size.
    """
    taken = mixing.mix(docs, carry=True).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token sequences; a null text is its end token, and each row is a document of its own."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None  # cross-parsing with suffix automata is no SQL; tests/llm compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.mode("overwrite").parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
