"""Quality rules of a document and of the host it comes from, in Spark's own expressions.

A document fails by its own words (too few, or too many repeated). Failures are
added up by host, each host's rate is drawn towards the corpus by a beta prior
fitted to the hosts' rates, and a host whose rate stays high takes its
documents with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.functions.scalars import bind
from framesift.llm.shared import settled
from framesift.llm.words import SPACES, WORD, text_or_empty, words

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A document fails under ``least_words`` words, or where more than
    ``most_repeated`` percent of them are in repeated windows of three. A host
    fails where its shrunk rate of failures is over ``most_failures``."""

    least_words: int = 50
    most_repeated: int = 50
    most_failures: float = 0.75
    # A prior can't weigh more than this many documents, however alike hosts are.
    heaviest_prior: float = 1000.0


def repeated_words(listed: Column) -> Column:
    """Of a list of words, those that lie in a window of three found twice or more.

    Windows are sorted by hash and place, so equal ones are neighbours; each
    repeated window then adds the words that the one before it didn't cover.
    Windows count as equal where their 64-bit hashes are.
    """

    def of(ws: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ws) - 3)
        windows = F.array_sort(F.transform(places, lambda i: F.struct(
            F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i"))))

        def starts(sorted_windows: Column) -> Column:
            same = F.filter(sorted_windows, lambda w, k: (
                (w["h"] == F.get(sorted_windows, k + 1)["h"]).eqNullSafe(True)
                | (w["h"] == F.get(sorted_windows, k - 1)["h"]).eqNullSafe(True)))
            return F.array_sort(F.transform(same, lambda w: w["i"]))

        covered = bind(bind(windows, starts), lambda s: F.aggregate(
            s, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda got, i: F.struct(i.alias("last"), (got["n"] + F.least(F.lit(3), i - got["last"])).alias("n")),
            lambda got: got["n"]))
        return F.when(F.size(ws) < 3, 0).otherwise(covered)

    return bind(listed, of).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return bind(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def measured(docs: DataFrame, text: str, rules: Rules) -> list[Column]:
    """A document's counts, and whether it fails by itself. A null text has no words."""
    t = text_or_empty(F.col(text))
    counts = bind(words(F.col(text)), lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")))
    return [
        counts.alias("_counts"),
        F.length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        repeated_lines(t).alias("n_dup_lines"),
    ]


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
           rules: Rules = Rules()) -> DataFrame:
    """Every document's counts, its own verdict and its host's.

    Returns ``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, host_failures, host_documents, host_rate,
    kept``, a row for each row given: repeated rows are judged and counted each
    by itself, rows without a host count as one host, a null or empty text has
    no words and so fails, and other columns are left out whatever they're
    called. An empty table gives an empty one.

    The counts are written once (without the texts) and read twice: by host,
    combined before they are shuffled, and for the answer. A host is one row
    of three numbers, so a host with most documents is no heavier than others;
    the join back to documents is by equality and adaptive execution splits a
    host with many.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), *measured(docs, text, rules))
    found = found.select(
        "doc_id", "host", F.col("_counts.n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_counts.n_repeat_words"))
    found = found.withColumn(
        "base_failed",
        (F.col("n_words") < rules.least_words)
        | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words")))
    found = settled(found, "rules")
    hosts = host_rates(found, rules)
    return (
        found.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= rules.most_failures))
        .drop("_host")
    )


def host_rates(found: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``host, host_failures, host_documents, host_rate`` of judged documents.

    The prior is a beta whose mean is the corpus's rate of failures and whose
    weight follows from how much more the hosts' rates differ than chance
    would have it: with the pooled rate p, N documents, Q = sum n (r - p)^2
    over H hosts and C = N - sum(n^2)/N, the variance between hosts is
    v = (Q - (H - 1) p (1 - p)) / C and the weight p (1 - p) / v - 1, kept
    between 0 and ``heaviest_prior``.
    """
    hosts = found.groupBy("host").agg(
        F.sum(F.col("base_failed").cast("long")).alias("host_failures"), F.count("*").alias("host_documents"))
    # Exact sums of whole numbers, so that the order they come in doesn't matter.
    f, n = F.col("host_failures").cast("decimal(20,0)"), F.col("host_documents").cast("decimal(20,0)")
    sums = hosts.agg(
        F.sum("host_failures").cast("double").alias("F"), F.sum("host_documents").cast("double").alias("N"),
        F.count("*").cast("double").alias("H"), F.sum(n * n).cast("double").alias("N2"),
        F.sum(((f * f).cast("double") / F.col("host_documents") * 1e6).cast("decimal(38,0)")).cast("double").alias("F2"))
    p, total = F.col("F") / F.col("N"), F.col("N")
    spread = F.col("F2") / 1e6 - F.col("F") * p
    between = F.try_divide(spread - (F.col("H") - 1) * p * (1 - p), total - F.col("N2") / total)
    weight = F.when((between > 0).eqNullSafe(True),
                    F.least(F.lit(rules.heaviest_prior), F.greatest(F.lit(0.0), p * (1 - p) / between - 1))
                    ).otherwise(F.lit(rules.heaviest_prior))
    prior = sums.select(F.struct(p.alias("mean"), weight.alias("weight")).alias("prior"))
    return hosts.withColumn("_prior", prior.scalar()).select(
        "host", "host_failures", "host_documents",
        ((F.col("host_failures") + F.col("_prior.mean") * F.col("_prior.weight"))
         / (F.col("host_documents") + F.col("_prior.weight"))).alias("host_rate"))
