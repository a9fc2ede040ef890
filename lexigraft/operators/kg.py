"""The knowledge graph as SQL over catalog views: concepts, cross-references, relations and their checks.

Each function registers nothing and returns a DataFrame; the staging tables are
given by view name. A key with a null column never counts as a repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONCEPT_KEY = ["cui"]
XREF_KEY = ["source_dataset", "source_table", "source_id", "cui", "xref_type"]
RELATION_KEY = ["source_dataset", "source_doc_id", "relation_type", "subject_cui", "object_cui", "subject_source_id", "object_source_id"]


def insert_ignore(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without repeats of a key, the first by all columns staying; rows with a null in the key all stay."""
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    # rows with a null key spread by their own hash instead of meeting in one group
    spread = F.when(whole, F.lit(0)).otherwise(F.monotonically_increasing_id() + 1)
    ranked = rows.withColumn("_own", spread)
    order = [F.col(c) for c in rows.columns if c not in keys] or [F.lit(0)]
    return ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_own").orderBy(*order))).filter("_rank = 1").drop("_own", "_rank")


def upsert(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by load order."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("_rank = 1").drop("_rank")


def concepts(spark: SparkSession, atoms: str, types: str) -> DataFrame:
    """cui, preferred_name, semantic_type: the preferred English name, else any name; types sorted and joined by a bar."""
    return spark.sql(f"""
        WITH ranked AS (
          SELECT cui, str, row_number() OVER (PARTITION BY cui ORDER BY CASE WHEN ispref = 'Y' THEN 0 ELSE 1 END, CASE WHEN ts = 'P' THEN 0 ELSE 1 END, aui) AS place
          FROM {atoms} WHERE lat = 'ENG'),
        english AS (SELECT cui, str FROM ranked WHERE place = 1),
        any_name AS (SELECT cui, min(str) AS str FROM {atoms} GROUP BY cui),
        kinds AS (SELECT cui, listagg(DISTINCT sty, '|') WITHIN GROUP (ORDER BY sty) AS semantic_type FROM {types} GROUP BY cui)
        SELECT a.cui, coalesce(e.str, a.str) AS preferred_name, k.semantic_type
        FROM any_name a LEFT JOIN english e ON a.cui = e.cui LEFT JOIN kinds k ON a.cui = k.cui""")


def annotation_xrefs(spark: SparkSession, entities: str, atoms: str, dataset: str, sabs: tuple[str, ...]) -> DataFrame:
    """Cross-references of annotated ids (ids array<string>) to the smallest cui of their code."""
    wanted = ", ".join(f"'{s}'" for s in sabs)
    return spark.sql(f"""
        WITH ids AS (SELECT DISTINCT i.id FROM {entities} t LATERAL VIEW explode(t.ids) i AS id WHERE i.id NOT IN ('', '-', '-1')),
        cuis AS (SELECT code, min(cui) AS cui FROM {atoms} WHERE sab IN ({wanted}) GROUP BY code)
        SELECT '{dataset}' AS source_dataset, 'entities' AS source_table, ids.id AS source_id, cuis.cui, 'identifier' AS xref_type
        FROM ids JOIN cuis ON ids.id = cuis.code""")


def vocabulary_xrefs(spark: SparkSession, atoms: str, dataset: str) -> DataFrame:
    return spark.sql(f"SELECT DISTINCT '{dataset}' AS source_dataset, sab AS source_table, code AS source_id, cui, 'atom' AS xref_type FROM {atoms} WHERE code <> 'NOCODE'")


def annotation_relations(spark: SparkSession, relations: str, xrefs: str, dataset: str) -> DataFrame:
    """Relations of annotated documents (pmid, relation_type, subject_id, object_id, novelty, evidence) between cuis."""
    return spark.sql(f"""
        WITH ids AS (SELECT source_id, min(cui) AS cui FROM {xrefs} WHERE source_dataset = '{dataset}' GROUP BY source_id)
        SELECT '{dataset}' AS source_dataset, r.pmid AS source_doc_id, r.relation_type, s.cui AS subject_cui, o.cui AS object_cui,
               r.subject_id AS subject_source_id, r.object_id AS object_source_id, r.novelty, r.evidence
        FROM {relations} r JOIN ids s ON r.subject_id = s.source_id JOIN ids o ON r.object_id = o.source_id""")


def vocabulary_relations(spark: SparkSession, rels: str, dataset: str) -> DataFrame:
    """Relations between cuis of a vocabulary; they have no document, so none is a repeat of another."""
    return spark.sql(f"""
        SELECT '{dataset}' AS source_dataset, CAST(NULL AS STRING) AS source_doc_id, coalesce(nullif(rela, ''), rel) AS relation_type,
               cui1 AS subject_cui, cui2 AS object_cui, CAST(NULL AS STRING) AS subject_source_id, CAST(NULL AS STRING) AS object_source_id,
               CAST(NULL AS STRING) AS novelty, CAST(NULL AS STRING) AS evidence
        FROM {rels} WHERE cui1 <> '' AND cui2 <> ''""")


def orphans(rows: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key isn't an orphan."""
    return rows.filter(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def latest(rows: DataFrame, created: str, *ties: str, n: int = 10) -> DataFrame:
    """The newest rows, for a look at them: a top-k report."""
    return rows.orderBy(F.desc(created), *ties).limit(n)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


def create_tables(spark: SparkSession, database: str) -> None:
    """The graph's tables as Parquet tables of a database; keys are kept by insert_ignore and upsert."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in (
        ("concepts", "cui STRING, preferred_name STRING, semantic_type STRING, created_at TIMESTAMP"),
        ("concept_xrefs", "source_dataset STRING, source_table STRING, source_id STRING, cui STRING, xref_type STRING"),
        ("relations", "source_dataset STRING, source_doc_id STRING, relation_type STRING, subject_cui STRING, object_cui STRING, subject_source_id STRING, object_source_id STRING, novelty STRING, evidence STRING"),
    ):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
