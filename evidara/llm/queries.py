"""The registered query of each operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evidara.llm.bpe import encode_decode
from evidara.llm.common import table
from evidara.llm.decontamination import decontaminate
from evidara.llm.hard_negatives import mine, relabelled
from evidara.llm.html_text import extract
from evidara.llm.jaccard_join import near_duplicates
from evidara.llm.periodic_runs import periodic_runs, planted, run_digests
from evidara.llm.permutation_index import nearest
from evidara.llm.pii import personal_data
from evidara.llm.quality import quality_scores
from evidara.llm.quality import train as train_quality
from evidara.llm.simhash import near_duplicates as simhash_classes
from evidara.llm.token_counts import token_counts
from evidara.llm.toxicity import toxicity_scores
from evidara.llm.toxicity import train as train_toxicity
from evidara.llm.warc import round_trip


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents")).drop("redacted")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(table(spark, sf_dir, "embeddings")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_pii": op5_pii,
    "op6_html_text": op6_html_text,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_permutation_index": op10_permutation_index,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash": op13_simhash,
}

#: Five hex digits of the SHA-1 are four base32 digits.
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, {1 + 5 * i}, 5) AS INTEGER) >> {shift}) & 31), 1)" for i in range(8) for shift in (15, 10, 5, 0))

#: Of the others SQL can't say the model, the tokenizer or the class of a document over whole tables; tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": f"""SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))""",
    "op11_hard_negatives": """WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE own <> label AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
}
