"""URL filters: rules first, then a tree of path templates per host.

The tree is built from all urls, level by level. At a node (host and template so far) the values of the next segment
are counted; a node with many values that hardly repeat, or with more than ``MOST_LITERALS``, is variable: there, values
below ``HEAVY`` of its urls become the wildcard ``*``. Sibling branches whose shares of blocked, allowed and ending urls
don't differ significantly are merged, as ``{a|b}``. A template is rejected if the smoothed share of blocked urls among
those that a rule judged reaches ``REJECT``; urls without a rule get the verdict of their template.

Only counts of (host, template, segment) are grouped, with map-side combining; joins at hot hosts use keys of their own,
so that adaptive execution can split them. After wildcards a node has a bounded number of branches, which is all that a
window sees at once. A path whose node no other path shares is done: the rest of its segments are its template's. So
the levels run as deep as any two paths go together, not as deep as the deepest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import UPPER
from orrery.storage import discard, written

LEAST_VALUES, REPEATS = 5, 3.0
MOST_LITERALS, HEAVY = 32, 0.05
LEAST_URLS, SIMILAR_Z = 20, 1.96
SMOOTH, REJECT = 2.0, 0.8

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://``, A-Z lower-cased; path: from there to the query; both empty if there is none."""
    part = lambda i: F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", i)
    return F.translate(part(1), UPPER, UPPER.lower()), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host and its subdomains, prefix of the path), as text, and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _key(*cols: str) -> Column:
    """One string for several, one to one: the lengths of all but the last come first."""
    sizes = [F.char_length(c).cast("string") for c in cols[:-1]]
    return F.concat_ws(":", F.lit("k"), *sizes, F.concat(*cols))


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, n, label) of different urls to the same with the template of each path."""
    parts = F.split(F.substring("path", 2, 2**31 - 1), "/")
    parts = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(parts)
    rows = written(urls.withColumn("parts", parts).withColumn("template", F.lit("")).withColumn("alone", F.size("parts") == 0))
    level = 0
    while not rows.where(~F.col("alone")).isEmpty():
        here = rows.where(~F.col("alone")).withColumn("seg", F.element_at("parts", level + 1))
        branch = here.groupBy("host", "template", "seg").agg(
            F.sum("n").alias("c"),
            F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("b"),
            F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("a"),
            F.sum(F.when(F.size("parts") == level + 1, F.col("n")).otherwise(0)).alias("e"),
            F.count("*").alias("paths"),
        )
        node = branch.groupBy("host", "template").agg(F.count("*").alias("v"), F.sum("c").alias("total"))
        node = node.select(_key("host", "template").alias("k"), "v", "total")
        variable = (F.col("v") > MOST_LITERALS) | (F.col("v") >= LEAST_VALUES) & (F.col("total") < F.col("v") * REPEATS)
        light = F.col("c") < F.col("total") * HEAVY
        branch = branch.withColumn("k", _key("host", "template")).join(node, "k")
        branch = branch.withColumn("token", F.when(variable & light, "*").otherwise(F.col("seg")))
        merged = _merged(branch.groupBy("host", "template", "token").agg(*[F.sum(x).alias(x) for x in ("c", "b", "a", "e", "paths")]))
        merged = merged.select(_key("host", "template", "token").alias("k"), "name", "single")
        names = branch.select(_key("host", "template", "seg").alias("s"), _key("host", "template", "token").alias("k"))
        names = names.join(merged, "k").select("s", "name", "single")
        deeper = here.withColumn("s", _key("host", "template", "seg")).join(names, "s")
        rest = F.when(F.col("single"), F.slice("parts", level + 2, F.greatest(F.lit(1), F.size("parts")))).otherwise(F.array().cast("array<string>"))
        deeper = deeper.select(
            "host", "path", "n", "label", "parts",
            F.concat_ws("/", "template", "name", rest).alias("template"),
            (F.col("single") | (F.size("parts") == level + 1)).alias("alone"),
        )
        last, rows = rows, written(rows.where("alone").unionByName(deeper))
        discard(last)
        level += 1
    return rows.select("host", "path", "n", "label", "template")


def _merged(tokens: DataFrame) -> DataFrame:
    """Names branches; neighbours in the order of their shares get one name unless a two-proportion test tells them apart."""
    share = lambda x: F.col(x) / F.col("c")
    order = Window.partitionBy("host", "template").orderBy(share("b"), share("a"), share("e"), "token")
    before = lambda x: F.lag(x).over(order)

    def differ(x: str) -> Column:
        p = (F.col(x) + before(x)) / (F.col("c") + before("c"))
        gap = F.abs(share(x) - before(x) / before("c"))
        return gap > SIMILAR_Z * F.sqrt(p * (1 - p) * (1 / F.col("c") + 1 / before("c")))

    apart = before("c").isNull() | (F.least("c", before("c")) < LEAST_URLS) | differ("b") | differ("a") | differ("e")
    grouped = tokens.withColumn("new", apart.cast("int")).withColumn("g", F.sum("new").over(order))
    group = Window.partitionBy("host", "template", "g")
    members = F.array_sort(F.collect_list("token").over(group))
    return grouped.withColumn("m", members).withColumn("single", F.sum("paths").over(group) == 1).withColumn(
        "name", F.when(F.size("m") > 1, F.concat(F.lit("{"), F.array_join("m", "|"), F.lit("}"))).otherwise(F.col("token"))
    )


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The verdict on every url: the id column, host, path, rule, verdict, template.

    Defined results: a null url and one without ``://`` have empty host and path, no template, and are allowed, unless a
    rule fits; urls with a path and an empty host are a host of their own; repeated rows get equal verdicts, each counted;
    a template without any judged url is allowed; no rows give no rows. Other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = rows.where("host <> '' OR path <> ''").groupBy("host", "path").agg(F.count("*").alias("n")).withColumn("label", verdict)
    found = templates(urls)
    blocked = F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0))
    judged = F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(0))
    bad = found.groupBy("host", "template").agg(((blocked + SMOOTH / 2) / (judged + SMOOTH) >= REJECT).alias("bad"))
    bad = found.withColumn("k", _key("host", "template")).join(bad.select(_key("host", "template").alias("k"), "bad"), "k")
    by_url = bad.select(_key("host", "path").alias("u"), "bad", "template")
    return (
        rows.withColumn("u", F.when((F.col("host") != "") | (F.col("path") != ""), _key("host", "path")).otherwise(F.concat(F.lit("-"), F.xxhash64("id").cast("string"))))
        .join(by_url, "u", "left")
        .select(
            F.col("id").alias(id_col), "host", "path", name.alias("rule"),
            F.coalesce(verdict, F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "template",
        )
    )
