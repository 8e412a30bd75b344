"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents, but
for the last, which returns a row of token counts and digests for each document. A document is a row: repeated rows are
judged alike, and rows without an id are kept by every filter. A null text counts as empty where it is judged, and stays null.
Extra columns, of any name, pass through the filtering stages. An empty table stays one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import bpe, decontamination, jaccard_join, pii, quality
from evidara.llm.common import apart, small_enough, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Ids of rejected documents that may be broadcast.
SMALL = 1_000_000


def _without(docs: DataFrame, rejected: DataFrame, name: str) -> DataFrame:
    """docs but those with a rejected doc_id; a row without id is kept, whatever other columns docs has."""
    rejected = written(rejected.select("doc_id").where("doc_id is not null").distinct(), name)
    if small_enough(rejected, SMALL):
        return docs.join(F.broadcast(rejected), "doc_id", "left_anti")
    key = "".join(docs.columns) + "_"  # a name that no column has
    return docs.withColumn(key, apart(F.col("doc_id"))).join(rejected.select(apart(F.col("doc_id")).alias(key)), key, "left_anti").drop(key)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go. It learns from this stage's own input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _without(docs, quality.quality_scores(docs, model).where("predicted = 0"), "rejected")


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; documents without words all stay."""
    return _without(docs, jaccard_join.near_duplicates(docs, links=False).where("n_shingles > 0 and component_id < doc_id"), "copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _without(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"), "leaks")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in brackets, and n_chars follows; the other columns stay."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = pii.personal_data(docs.select(F.struct(*rest).alias("row"), "text"), key="row")
    clean = found.select("row.*", F.col("redacted").alias("text"), F.length("redacted").cast("long").alias("n_chars"))
    return clean.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_a_kind),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("tokens", tokenize),
]

#: The stages' models and tokenizers are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
