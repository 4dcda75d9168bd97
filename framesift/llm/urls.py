"""Rules on parts of hosts and paths, matched by equality of digests, in Spark's own expressions.

A URL is written as every pair of a suffix of its host and a prefix of its
path that a rule could be, and a pair joins the rules on the first four bytes
of its digest; whole digests then decide, and the longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  # hexadecimal digits: four bytes


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    with A-Z in lower case; empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", -1))
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.when(rest.isNull(), "").otherwise(
        F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(name: Column, start: Column) -> Column:
    # No host holds a slash, so the two can't run together.
    return F.sha2(F.concat(name, F.when(start.startswith("/"), F.lit("")).otherwise(F.lit("//")), start), 256)


def labels(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def prepared(rules: DataFrame) -> DataFrame:
    """Rules ``host, path, verdict`` with what the join needs. Rules without a
    host, path or verdict are left out; of equal ones, block counts."""
    known = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    whole = digest(F.col("host"), F.col("path"))
    return known.select(
        F.substring(whole, 1, SHORT).alias("short"), whole.alias("digest"),
        F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"),
        labels(F.col("host")).alias("host_labels"), F.length("path").alias("path_length"))


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url",
           otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict``, a row for each page given.

    A rule fits its host and all subdomains where the path starts with the
    rule's; the longest rule wins, then the one with the longer host. Where
    none fits, ``rule`` is null and the verdict ``otherwise``, also for URLs
    that are null, empty or without ``://``. Repeated rows are judged each by
    itself; other columns are left out whatever they're called.

    A URL is only cut at the lengths that rules have (numbers of labels in a
    host, characters in a path: two short lists, read as scalars), so long
    hosts and paths make no more pairs than short ones. Pairs that meet no
    rule go before the shuffle and those of a page are combined before it, so
    that no key is hot. Spark sends the rules to all only if they're small;
    if not, it splits the pieces of a common pair.
    """
    listed = prepared(rules)
    cuts = listed.agg(
        F.struct(F.array_sort(F.collect_set("host_labels")).alias("hosts"),
                 F.array_sort(F.collect_set("path_length")).alias("paths")).alias("cuts"))
    rows = pages.select(
        # The same for the same input: places in the files' partitions.
        F.monotonically_increasing_id().alias("_row"), F.col(page_id).alias("page_id"),
        host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    names = F.split("host", r"\.")
    suffixes = F.transform(
        F.filter(F.col("_cuts.hosts"), lambda k: k <= F.size(names)),
        lambda k: F.array_join(F.slice(names, -k, k), "."))
    starts = F.transform(
        F.filter(F.col("_cuts.paths"), lambda k: k <= F.length("path")),
        lambda k: F.col("path").substr(F.lit(1), k))
    pairs = (
        rows.withColumn("_cuts", cuts.scalar())
        .withColumn("_suffix", F.explode_outer(suffixes))
        .withColumn("_start", F.explode_outer(starts))
        .withColumn("_digest", digest(F.col("_suffix"), F.col("_start")))
        .withColumn("_short", F.substring("_digest", 1, SHORT))
    )
    met = pairs.join(
        listed, (F.col("_short") == F.col("short")) & (F.col("_digest") == F.col("digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(
        (F.col("host_length") + F.col("path_length")).alias("length"), "host_length", "rule", "verdict")))
    return (
        met.groupBy("_row").agg(
            F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
            best.alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.verdict"), F.lit(otherwise)).alias("verdict"))
    )
