"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

A document's expected number of copies is e = p + k * (r - m). p = target / size of its source; r = size / (size + ``HALF``)
in thousandths, so that longer documents are likelier than scraps of text; m is the mean of r over the source's words,
so that the expected words are the target's; k = min(p, cap - p) * ``LEAN`` keeps e between 0 and ``cap``. The whole part of e is
taken for certain (whole copies); the rest, f = e - floor(e), is an inclusion probability, unequal within a source. Each
document draws a uniform u from its id, and those with the smallest ratio of odds, (u / (1 - u)) / (f / (1 - f)), enter
once more, up to a fixed size: the words that the source still lacks. The last document goes in if that comes nearer.

Scale: words are counted in one pass over the texts, after which only ids, sizes and draws move. A source's documents are
dealt to ``BINS`` bins by their ratio q, as q / (1 + q). Counts per bin, combined map-side, give where each bin starts, so the
running sum over a source never runs in one task: only a bin's own documents are summed in order, and a source of a third
of all rows is ``BINS`` groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import WORD, durable, quoted

BINS = 4096
HALF = 50  # words of a document whose r is a half
LEAN = 0.5
BROADCAST_SOURCES = 20_000  # more sources meet their documents by a shuffle


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) to targets: shares of all sizes by weight, none above ``cap`` times its source's size.

    Sources by code point, null last, take the weights in turn. The excess of capped sources is reshared by weight until
    none is above: that fixed point is min(cap * size, level * weight), whose level follows from the sources in the order
    of cap * size / weight. The table has a row per source, a setting of the mix, so a window over all of it is small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(int(w)) for w in weights])
    named = sizes.withColumn("_w", F.element_at(kinds, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_level = Window.orderBy(
        (F.col("source_size").cast("double") * cap / F.col("_w")).asc(), F.col("source").asc_nulls_last()
    )
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        named.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
        # were this source and all after it uncapped:
        .withColumn("_free", (F.col("_all") - F.col("_capped")).cast("double") / F.col("_rest"))
        .withColumn("_open", F.col("_free") * F.col("_w") <= F.col("source_size") * cap)
    )
    level = F.min(F.when(F.col("_open"), F.struct(F.col("source_size").cast("double") * cap / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_free")))).over(everything)
    return ranked.withColumn("_level", level["_free"]).select(
        "source",
        "source_size",
        F.when(F.col("_open"), F.col("_level") * F.col("_w")).otherwise(F.col("source_size").cast("double") * cap).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    bins: int = BINS,
    carry: bool = False,
) -> DataFrame:
    """How often each document enters the mix.

    Returns one row per row of ``docs``: the id column, source, size (words), source_size, target, copies (times it is
    taken) and taken (copies * size). Reruns agree: u is the first 52 bits of md5(seed:id). With ``carry`` each row comes
    whole, as the struct ``row``, beside its copies and nothing else.

    Defined results: a null text has size 0; a source without words has target 0 and its documents are taken 0 times;
    null sources are one source, ordered last; rows that repeat an id draw alike and are ordered by size, then as they
    come; a null id draws as the empty string, together with the text's hash, so that rows without ids spread; no rows give
    no rows. Other columns are ignored, whatever their names.
    """
    id_, text, source = quoted(id_col), F.coalesce(quoted(text_col), F.lit("")), quoted(source_col)
    name = F.coalesce(id_.cast("string"), F.concat(F.lit("-"), F.sha2(text, 256)))
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("long")
    rows = docs.select(
        *([F.struct(*[quoted(x) for x in docs.columns]).alias("_row")] if carry else []),
        id_.alias("_id"),
        source.alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        drawn.alias("_draw"),
    )
    light = durable(rows.drop("_row"))
    key = lambda: F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_key")  # noqa: E731  one to one, and never null
    r = F.floor(F.col("size") * 1000 / (F.col("size") + HALF))
    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(r * F.col("size")).alias("_rs"))
    targets = source_targets(sums.select("source", "source_size"), weights, cap)
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    mean = F.when(F.col("source_size") > 0, F.col("_rs") / F.col("source_size")).otherwise(F.lit(0.0))
    of = targets.select(key(), "source_size", "target").join(sums.select(key(), "_rs"), "_key")
    of = durable(of.select(F.reverse("_key").alias("_yek"), "source_size", "target", p.alias("_p"), mean.alias("_m")))
    if of.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    e = F.col("_p") + F.least(F.col("_p"), cap - F.col("_p")) * LEAN * (r - F.col("_m")) / 1000
    u = (F.col("_draw") + 0.5) / F.lit(float(2**52))
    odds = (u / (1 - u)) / (F.col("_f") / (1 - F.col("_f")))

    def ranked(some: DataFrame) -> DataFrame:
        """With e, its parts, the ratio of odds and its bin; documents that can't enter again are in no bin."""
        some = some.withColumn("_key", key()).withColumn("_yek", F.reverse("_key")).join(of, "_yek").withColumn("_e", e).withColumn("_whole", F.floor("_e"))
        some = some.withColumn("_f", F.col("_e") - F.col("_whole")).withColumn("_q", F.when((F.col("_f") > 0) & (F.col("size") > 0), odds))
        return some.withColumn("_bin", F.when(F.col("_q").isNotNull(), F.floor(F.col("_q") / (1 + F.col("_q")) * bins).cast("int")).otherwise(F.pmod("_draw", F.lit(bins)).cast("int") - bins))

    known = ranked(light)
    whole = known.groupBy("_key").agg(F.sum(F.col("_whole") * F.col("size")).alias("_sure"))
    by_bin = known.where("_q IS NOT NULL").groupBy("_key", "_bin").agg(F.sum("size").alias("_words"))
    starts = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = by_bin.select("_key", "_bin", F.coalesce(F.sum("_words").over(starts), F.lit(0)).alias("_start")).join(whole, "_key")
    # a key of its own, so that the large side isn't sorted twice and adaptive execution may split it
    at = lambda: F.concat(F.col("_bin").cast("string"), F.col("_key")).alias("_at")
    mixed = ranked(rows if carry else light).withColumn("_at", at()).join(plan.select(at(), "_start", "_sure"), "_at", "left")
    running = Window.partitionBy("_at").orderBy("_q", "_draw", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("_start") + F.coalesce(F.sum("size").over(running), F.lit(0))
    enters = F.col("_q").isNotNull() & (so_far + F.col("size") / 2 <= F.col("target") - F.col("_sure"))
    copies = (F.col("_whole").cast("long") + enters.cast("long")).alias("copies")
    if carry:
        return mixed.select(F.col("_row").alias("row"), copies)
    return mixed.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", copies).withColumn("taken", F.col("copies") * F.col("size"))
