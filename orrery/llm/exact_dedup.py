"""Exact dedup through content-defined chunk recipes (DataFrame functions only).

1. A text is cut where its content says so: after at least ``MIN_CHUNK`` characters, at the first place whose
   last three characters fit a fixed pattern, at ``MAX_CHUNK`` at the latest. Equal texts are cut alike.
2. Every chunk gets a 64-bit label. The chunks themselves move once, each different one once per map task, to find
   labels that stand for more than one content; chunks under such a label are told apart by their SHA-256. A label
   that passed is verified byte by byte.
3. A document is the ordered list of its verified identifiers (its recipe, about 0.4 % of its bytes); equal lists are
   equal texts. Only recipes are grouped and joined, so long documents don't move again.

Hot groups: recipes are counted with map-side combining, and the join that brings a group's result back to its rows
is a plain sort-merge join, which adaptive execution splits where one recipe has very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ascii_lower, durable

MIN_CHUNK, MAX_CHUNK = 2048, 8192
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[aeiou][a-z][\x20\x09-\x0D])|.{{1,{MAX_CHUNK}}}"


def chunks_of(text: Column) -> Column:
    """The chunks of a text in order; they concatenate to the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_bits: int = 64) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z.

    Returns one row per row of ``docs``: the id column, keep_id (largest id of the group), group_size, kept
    (this row has that id), text_sha256 (of the lower-cased text in UTF-8) and n_chunks. Other columns of ``docs`` are
    ignored, whatever their names.

    Defined results: a null text counts as empty, and all empty texts are one group; rows that repeat id and text
    are rows of one group, each counted, and each kept if theirs is the largest id; rows with a null id count, but are
    kept only if no row of the group has an id (keep_id is then null); no rows give no rows. ``label_bits`` below 64
    shortens the labels, which only serves tests of step 2.
    """
    norm = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"))
    label = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - label_bits)
    cut = norm.select("_id", "_text", chunks_of(F.col("_text")).alias("_chunks"))
    recipes = durable(
        cut.select("_id", F.sha2("_text", 256).alias("_sha"), F.transform("_chunks", label).alias("_recipe"))
    )
    contents = norm.select(F.explode(chunks_of(F.col("_text"))).alias("_chunk")).select(
        label(F.col("_chunk")).alias("_label"), "_chunk"
    )
    contested = durable(
        contents.distinct().groupBy("_label").agg(F.count("*").alias("_n")).where("_n > 1")
    )
    if contested.isEmpty():  # a label is then its content
        verified = recipes.withColumn("_ids", F.col("_recipe"))
    else:
        verified = _told_apart(cut, contested, label)
    groups = verified.groupBy("_ids").agg(
        F.max("_id").alias("keep_id"), F.count("*").alias("group_size"), F.max("_sha").alias("_of")
    )
    # A list and its joined string are one to one; the new key makes both sides plain exchanges, which AQE can split.
    key = lambda: F.array_join(F.transform("_ids", lambda x: x.cast("string")), " ").alias("_key")
    return (
        verified.select("_id", "_sha", F.size("_ids").cast("long").alias("n_chunks"), key())
        .join(groups.select("keep_id", "group_size", key()), "_key")
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("_sha").alias("text_sha256"),
            "n_chunks",
        )
    )


def _told_apart(cut: DataFrame, contested: DataFrame, label) -> DataFrame:
    """Recipes whose contested labels are followed by the SHA-256 of the chunk."""
    rows = cut.select(F.expr("uuid()").alias("_row"), "_id", F.sha2("_text", 256).alias("_sha"), "_chunks")
    rows = durable(
        rows.select(
            "_row", "_id", "_sha", F.transform("_chunks", lambda c: F.struct(label(c).alias("l"), F.sha2(c, 256).alias("s"))).alias("_parts")
        )
    )
    ids = (
        rows.select("_row", F.posexplode("_parts").alias("_pos", "_part"))
        .join(contested.select(F.col("_label"), F.lit(True).alias("_hit")), F.col("_part.l") == F.col("_label"), "left")
        .select(
            "_row",
            F.struct("_pos", F.concat(F.col("_part.l").cast("string"), F.when(F.col("_hit"), F.col("_part.s")).otherwise("")).alias("id")).alias("_at"),
        )
        .groupBy("_row")
        .agg(F.transform(F.array_sort(F.collect_list("_at")), lambda x: x["id"]).alias("_ids"))
    )
    return rows.join(ids, "_row", "left").select(
        "_id", "_sha", F.coalesce("_ids", F.array().cast("array<string>")).alias("_ids")
    )
