"""Documents made into training data: five stages over operators of ``framesift.llm``.

Each stage takes what the one before kept, as documents, and returns
documents; the last returns their token ids.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import bpe, convnet, jaccard, mixing, rules
from framesift.llm.queries import held_out
from framesift.llm.shared import settled

THRESHOLD = 0.7


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with a number for each row as ``_row``, so that rows that repeat
    an id, or have none, are told apart: their file's place among the files'
    names, and their place in it. However the files are split among tasks,
    each reading of them gives the same numbers. What isn't read from files is
    written to one table first. Columns called ``_row``, ``_file`` or ``_at`` are left out."""
    spark, docs = docs.sparkSession, docs.drop("_row", "_file", "_at")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return numbered(settled(docs, "documents"))
    files = sorted(r["_file"] for r in placed.select("_file").distinct().collect())  # reads no column
    first = spark.createDataFrame(pa.table({"_file": pa.array(files, pa.string()), "_first": pa.array([n << 40 for n in range(len(files))], pa.int64())}))
    return placed.join(F.broadcast(first), "_file").select(*docs.columns, (F.col("_first") + F.col("_at")).alias("_row"))


def kept(rows: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose numbers are in ``chosen``; an equi-join on a key that is never hot."""
    named = rows.join(chosen.select(F.col("doc_id").alias("_row")), "_row", "left_semi")
    return named.select([c for c in columns if c in named.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail by their words, or whose source fails, go. A null or
    empty text has too few words; rows that repeat are judged alike, rows
    without a source are a source."""
    rows = numbered(docs)
    return kept(rows, rules.judged(rows, doc_id="_row").where("kept"), docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network learned from labels scores under the threshold
    go. A null text is scored as an empty one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net, rows = convnet.learned(docs, labels.where(~held_out())), numbered(docs)
    return kept(rows, convnet.scored(rows, net, doc_id="_row").where(F.col("score") >= THRESHOLD), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id (of equal
    ids the first row, rows without one last). Texts without words are groups of their own."""
    given = numbered(docs)
    rows = given.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)))
    found = jaccard.joined(rows.select("_row", "text"), doc_id="_row")
    # Of a component's rows, the one that comes first by id and place.
    placed = settled(found.join(rows.select(F.col("_row").alias("doc_id"), "_id"), "doc_id"), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct("_id", "doc_id"))["doc_id"].alias("doc_id"))
    return kept(given, first, docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target makes it, perhaps not at
    all. A text without words has no size, but is taken like others."""
    rows = numbered(docs)
    taken = mixing.mixed(rows, doc_id="_row", drawn_by="doc_id").where("copies > 0").select(F.col("doc_id").alias("_row"), "copies")
    copied = rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies")))
    return copied.select([c for c in docs.columns if c in copied.columns])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' ids by byte-level BPE, and whether they decode to the text. A null text is an empty one."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encoded(docs, path, pattern, decode=True).select(
        "doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", target_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

# The classifier and the tokenizer aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a table the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"stage{k}")
    return docs
