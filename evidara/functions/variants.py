"""JSON columns as VARIANT: leaves of any depth, pointers, coverage of their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.plans.lineage import cut, settings


def leaves(rows: DataFrame, key: str, column: str, depth: int = 64) -> DataFrame:
    """key, path, kind (number, text, boolean, null), value (as text), number of each leaf of a JSON text, whatever its depth.

    Objects and arrays are walked level by level as one recursive query; empty ones have no leaf. Texts that are no JSON, and
    nulls, have none either; beyond depth levels nothing is walked. Repeated keys count each. Names in a path are as they are.
    """
    spark = rows.sparkSession
    start = cut(rows.select(F.col(key).alias("key"), F.col(column).alias("doc")), "documents")
    with settings(spark, {"spark.sql.cteRecursionLevelLimit": str(depth + 2), "spark.sql.cteRecursionRowLimit": "-1"}):
        walked = cut(spark.sql(
            """WITH RECURSIVE leaf(key, path, v, depth) AS (
                SELECT key, '$', try_parse_json(doc), 0 FROM {start}
                UNION ALL
                SELECT l.key, concat(l.path, CASE WHEN p.key IS NULL THEN concat('[', p.pos, ']') ELSE concat('.', p.key) END), p.value, l.depth + 1
                FROM leaf l, LATERAL variant_explode(l.v) p WHERE l.depth < {depth}
            ) SELECT key, path, schema_of_variant(v) AS kind, try_variant_get(v, '$', 'string') AS value FROM leaf WHERE v IS NOT NULL""",
            start=start, depth=depth,
        ).where("NOT startswith(kind, 'OBJECT') AND NOT startswith(kind, 'ARRAY')"), "leaves")
    kind = F.when(F.col("kind") == "VOID", "null").when(F.col("kind") == "STRING", "text").when(F.col("kind") == "BOOLEAN", "boolean").otherwise("number")
    return walked.select(F.col("key").alias(key), "path", kind.alias("kind"), F.when(kind != "null", F.col("value")).alias("value"), F.when(kind == "number", F.col("value").cast("double")).alias("number"))


def pointer(column: str, path: str, kind: str) -> F.Column:
    """A value of a JSON text by its path ($.a.b[0]), or null where it isn't there or of another kind."""
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def coverage(found: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """by, path (array places as []), documents, leaves, numeric, texts, nulls, least, most: which paths hold numbers, and where."""
    path = F.regexp_replace("path", r"\[\d+\]", "[]")
    is_ = lambda kind: F.count_if(F.col("kind") == kind)
    return found.groupBy(*(by or []), path.alias("path")).agg(F.count_distinct(key).alias("documents"), F.count("*").alias("leaves"), is_("number").alias("numeric"), is_("text").alias("texts"), is_("null").alias("nulls"), F.min("number").alias("least"), F.max("number").alias("most"))
