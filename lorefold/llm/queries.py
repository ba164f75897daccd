"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefold.llm.groups import connected_groups
from lorefold.llm.names import link_names
from lorefold.llm.neighbours import close_pairs
from lorefold.llm.mixing import mix_documents, mixture_shares
from lorefold.llm.packing import pack_documents, packing_report
from lorefold.llm.pii import find_personal, redact
from lorefold.llm.spam import spam_documents
from lorefold.sources.tables import table

#: The model whose vectors are current.
CURRENT_MODEL = "hashvec-384-r2"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = table(spark, sf_dir, "projection_embeddings").filter(F.col("model_version") == CURRENT_MODEL)
    return close_pairs(current, "entity_id", "entity_type", "embedding", dims=384, k=10, least=0.80)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_groups(table(spark, sf_dir, "projection_redirects"), "from_id", "to_id")


def _personal(spark: SparkSession, sf_dir: str, *, whole: bool = True) -> DataFrame:
    entities = table(spark, sf_dir, "projection_entities")
    requests = table(spark, sf_dir, "adjudication_requests")
    aliases = table(spark, sf_dir, "projection_aliases").join(entities.filter("entity_type = 'Person'").select("entity_id").distinct(), "entity_id", "left_semi")
    listed = requests.select("entity_type", F.explode("candidates.name").alias("text"))
    people = (
        entities.filter("entity_type = 'Person'").select(F.col("name").alias("text")).unionAll(aliases.select("alias"))
        .unionAll(requests.filter("entity_type = 'Person'").select("mention_text")).unionAll(listed.filter("entity_type = 'Person'").select("text"))
    )
    projects = entities.filter("entity_type = 'Project'").select(F.col("name").alias("text")).unionAll(listed.filter("entity_type = 'Project'").select("text"))
    return find_personal(table(spark, sf_dir, "captures"), people, projects, whole=whole)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personal(spark, sf_dir, whole=False)


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_personal(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_names(*(table(spark, sf_dir, n) for n in ("projection_entities", "projection_aliases", "adjudication_requests")))


def p7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "packing_containers"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packing(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mixture_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mixture_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p7_packing": p7_packing,
    "p7_fill": p7_fill,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

ORACLE: dict[str, str] = {
    "p1_found": """
WITH u AS (
  SELECT DISTINCT entity_id, entity_type, embedding::DOUBLE[] AS v FROM projection_embeddings
  WHERE model_version = 'hashvec-384-r2' AND entity_id IS NOT NULL AND entity_type IS NOT NULL AND len(embedding) = 384
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT a.entity_id AS a, b.entity_id AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS s
  FROM u a JOIN u b ON a.entity_type = b.entity_type AND a.entity_id <> b.entity_id
), k AS (
  SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10
)
SELECT DISTINCT least(a, b) AS entity_a, greatest(a, b) AS entity_b FROM k WHERE s >= 0.8
""",
    "p3_found": """
WITH RECURSIVE ids AS (
  SELECT from_id AS id FROM projection_redirects WHERE from_id IS NOT NULL
  UNION SELECT to_id FROM projection_redirects WHERE to_id IS NOT NULL
), links AS (
  SELECT from_id AS a, to_id AS b FROM projection_redirects WHERE from_id <> to_id
  UNION SELECT to_id, from_id FROM projection_redirects WHERE from_id <> to_id
), reach AS (
  SELECT id AS record_id, id AS other FROM ids
  UNION
  SELECT r.record_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT record_id, min(other) AS group_id FROM reach GROUP BY record_id
""",
}
