"""Vocabulary files: pipe-separated rows with a trailing bar, and tab-separated release files with a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_filled
from ..schemas import RRF
from .order import place


def read_rrf(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The named columns of a pipe-separated file, all strings, and ord, the row's place (order.place).

    Missing last columns are empty, further ones and the trailing bar are
    dropped, empty lines are skipped, quotes are ordinary characters.
    """
    columns = RRF[name]
    lines = spark.read.text(path)
    lines = lines.select("value", place(lines).alias("ord")).filter("value <> ''")
    parts = F.split("value", r"\|", -1)
    return lines.select(*(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)), "ord")


def vocabulary_tables(conso: DataFrame, rel: DataFrame, sty: DataFrame, maps: DataFrame) -> dict[str, DataFrame]:
    """The narrow tables that mapping reads (schemas ATOMS, RELS, TYPES, CURATED)."""
    return {
        "atoms": conso.filter("cui <> '' and sab <> '' and code not in ('', 'NOCODE')").select("cui", "sab", "tty", "code", "str", "ord"),
        "rels": rel.filter("cui1 <> ''").select("cui1", "rel", "cui2", "rela", "sab", "ord"),
        "types": sty.filter("cui <> '' and sty <> ''").groupBy("cui", "sty").agg(F.min("ord").alias("ord")),
        "curated": maps.select(F.col("mapsetsab").alias("mapset"), first_filled(F.col("fromexpr"), F.col("fromid")).alias("from_code"), first_filled(F.col("toexpr"), F.col("toid")).alias("to_code"), "rel", "ord").filter("from_code is not null and to_code is not null"),
    }


def load_filter(conso: DataFrame, english_only: bool = False, vocabularies: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the wanted language and vocabularies; without either, all rows."""
    out = conso.filter("lat = 'ENG'") if english_only else conso
    return out.filter(F.col("sab").isin(*vocabularies)) if vocabularies else out


#: Header names of release files and the names that operators use.
RELEASE_NAMES = {
    "conceptId": "concept_id", "typeId": "type_id", "sourceId": "source_id", "destinationId": "destination_id", "referencedComponentId": "referenced_id",
    "domainConstraint": "domain_constraint", "domainId": "domain_id", "attributeCardinality": "cardinality", "ruleStrengthId": "rule_strength_id",
    "contentTypeId": "content_type_id", "rangeConstraint": "range_constraint", "mapTarget": "map_target", "effectiveTime": "effective_time",
}


def read_reference_set(spark: SparkSession, path: str, active_only: bool = False) -> DataFrame:
    """A release file: header, tabs, no quoting, all strings; ord is the row's place; known headers get operators' names."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    df = df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(RELEASE_NAMES.get(c, c)) for c in df.columns), place(df).alias("ord"))
    return df.filter("active = '1'") if active_only else df


def active_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.filter("active = '1'").select("id").distinct()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric key it is read in ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        low, high = reader.load().agg(F.min(key), F.max(key)).first()
        if low is not None:
            reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
