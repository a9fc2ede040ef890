"""Keyed tables of files: their layouts and checks, loads that keep keys, and resets.

A table is a folder of Parquet parted by a hash of the key. A load stages its rows,
finds the parts that they fall in, and replaces only these, each as a whole, so a
load's work follows its rows and not the table. A row with a null in its key never
counts as a repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import RRF
from .hierarchy import settled


@dataclass(frozen=True)
class Table:
    """Columns with types, the key, columns that may not be null, and the values that a column may have."""

    columns: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.columns.split(", ")]


def _strings(names: list[str]) -> str:
    return ", ".join(f"{n} string" for n in names)


_DOCUMENTS = Table("pmid bigint, title string, abstract string, split string, source_file string", ("pmid",), ("pmid", "title", "abstract", "split", "source_file"), {"split": ("train", "dev", "test")})
_SPAN = ("pmid", "start_offset", "end_offset", "mention", "entity_type")
_RELEASE = "id bigint, effective_time date, active boolean, module_id bigint"
_TERM = Table(f"{_RELEASE}, concept_id bigint, language_code string, type_id bigint, term string, case_significance_id bigint", ("id",), ("id", "effective_time", "active", "module_id", "concept_id", "language_code", "type_id", "term", "case_significance_id"))
_EDGE = Table(f"{_RELEASE}, source_id bigint, destination_id bigint, relationship_group int, type_id bigint, characteristic_type_id bigint, modifier_id bigint", ("id",), ("id", "effective_time", "active", "module_id", "source_id", "destination_id", "relationship_group", "type_id", "characteristic_type_id", "modifier_id"))
_MEMBER = "id string, effective_time date, active boolean, module_id bigint, refset_id bigint, referenced_component_id bigint"
#: The tables, their keys and checks.
TABLES = {
    "cdr.documents": _DOCUMENTS,
    "cdr.entities": Table("pmid bigint, start_offset int, end_offset int, mention string, entity_type string, mesh_id_raw string, mesh_id string, mesh_id_list array<string>, composite_mentions string", (*_SPAN, "mesh_id_raw", "composite_mentions"), _SPAN),
    "cdr.relations": Table("pmid bigint, relation_type string, subject_id string, object_id string", ("pmid", "relation_type", "subject_id", "object_id"), ("pmid", "relation_type", "subject_id", "object_id")),
    "biored.documents": _DOCUMENTS,
    "biored.entities": Table("pmid bigint, start_offset int, end_offset int, mention string, entity_type string, identifier_raw string, identifier_list array<string>, normalized_identifier string", (*_SPAN, "identifier_raw"), (*_SPAN, "identifier_raw")),
    "biored.relations": Table("pmid bigint, relation_type string, subject_id string, object_id string, novelty string", ("pmid", "relation_type", "subject_id", "object_id", "novelty"), ("pmid", "relation_type", "subject_id", "object_id", "novelty")),
    "umls.mrconso": Table(_strings(RRF["MRCONSO"]), ("aui",), ("aui", "cui", "str")),
    "umls.mrrel": Table(_strings(RRF["MRREL"]), ("rui",), ("cui1", "rel", "cui2")),
    "umls.mrsty": Table(_strings(RRF["MRSTY"]), ("cui", "tui"), ("cui", "tui", "sty")),
    "umls.mrdef": Table(_strings(RRF["MRDEF"]), ("atui",), ("cui", "def")),
    "umls.mrmap": Table(_strings(RRF["MRMAP"]), ("mapatn", "mapid"), ("mapsetcui",)),
    "snomed.concepts": Table(f"{_RELEASE}, definition_status_id bigint", ("id",), ("id", "effective_time", "active", "module_id", "definition_status_id")),
    "snomed.descriptions": _TERM,
    "snomed.text_definitions": _TERM,
    "snomed.relationships": _EDGE,
    "snomed.stated_relationships": _EDGE,
    "snomed.extended_map": Table(f"{_MEMBER}, map_group int, map_priority int, map_rule string, map_advice string, map_target string, correlation_id bigint, map_category_id bigint", ("id",), ("id", "effective_time", "active", "module_id", "refset_id", "referenced_component_id", "map_group", "map_priority")),
    "snomed.simple_map": Table(f"{_MEMBER}, map_target string", ("id",), ("id", "effective_time", "active", "module_id", "refset_id", "referenced_component_id", "map_target")),
    "kg.concepts": Table("cui string, preferred_name string, semantic_type string", ("cui",), ("cui", "preferred_name")),
    "kg.concept_xrefs": Table("source_dataset string, source_table string, source_id string, cui string, xref_type string", ("source_dataset", "source_table", "source_id", "cui", "xref_type"), ("source_dataset", "source_table", "source_id", "cui")),
    "kg.relations": Table("source_dataset string, source_doc_id string, relation_type string, subject_cui string, object_cui string, subject_source_id string, object_source_id string, novelty string, evidence string", ("source_dataset", "source_doc_id", "relation_type", "subject_cui", "object_cui", "subject_source_id", "object_source_id"), ("source_dataset", "relation_type", "subject_cui", "object_cui")),
}
#: Parts of a table.
PARTS = 32


def violations(rows: DataFrame, table: Table) -> DataFrame:
    """(rule, rows) of a table's checks that rows break; none if all hold."""
    tests = [(f"{c} is null", F.col(c).isNull()) for c in table.required] + [(f"{c} not in {', '.join(v)}", F.coalesce(~F.col(c).isin(*v), F.lit(False))) for c, v in table.allowed.items()]
    if not tests:
        return rows.sparkSession.createDataFrame([], "rule string, rows long")
    counts = rows.agg(*(F.count_if(t).alias(f"c{i}") for i, (_, t) in enumerate(tests)))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("rows")) for i, (name, _) in enumerate(tests)))
    return counts.select(F.explode(each).alias("v")).select("v.rule", "v.rows").filter("rows > 0")


def _whole(key: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for c in key:
        out = out & F.col(c).isNotNull()
    return out


def _part(table: Table) -> Column:
    """A row's part: by its key, or by all its columns if the key has a null, so that such rows don't meet."""
    return F.pmod(F.when(_whole(table.key), F.xxhash64(*table.key)).otherwise(F.xxhash64(*table.names)), F.lit(PARTS)).cast("int")


def read(spark: SparkSession, table: Table, path: str) -> DataFrame:
    """A table's rows; a path that nothing was loaded to has none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return spark.createDataFrame([], table.columns)
    return spark.read.schema(f"{table.columns}, _part int").parquet(path).select(*table.names, "_part").drop("_part")


def load(rows: DataFrame, table: Table, path: str, replace: bool = False, order: str | None = None) -> int:
    """Load rows into a table and return how many keys are new. Other columns than the table's are dropped.

    A key that is there keeps its row, or gets the new one with replace. Of a load's
    own repeats the first by `order` counts, with replace the last; without an order
    the least by all columns. Rows that break a check raise, and nothing is loaded.
    """
    spark = rows.sparkSession
    kept = [order] if order and order not in table.names else []
    staged = settled(rows.select(*(F.col(c).cast(kind) for c, kind in (x.split(" ", 1) for x in table.columns.split(", "))), *kept).withColumn("_part", _part(table)))
    broken = violations(staged, table).collect()
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r['rows']} rows" for r in broken))
    own = staged.filter(_whole(table.key))
    places = [F.desc(order) if replace else F.asc(order)] if order else []
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(*table.key).orderBy(*places, *table.names)))
    fresh = settled(ranked.filter("_rank = 1").drop("_rank", *kept).unionByName(staged.filter(~_whole(table.key)).drop(*kept)))
    touched = [r[0] for r in fresh.select("_part").distinct().collect()]  # PARTS at most
    there = read(spark, table, path).withColumn("_part", _part(table)).filter(F.col("_part").isin(*touched)) if touched else None
    if there is None:
        return 0
    new = fresh.join(there.select(*table.key), list(table.key), "left_anti")
    added = new.count()
    merged = fresh.unionByName(there.join(fresh.select(*table.key), list(table.key), "left_anti")) if replace else there.unionByName(new)
    merged = settled(merged.select(*table.names, "_part"))
    merged.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    return added


def reset(spark: SparkSession, table: Table, path: str) -> None:
    """Empty a table; its folder and columns stay."""
    spark.createDataFrame([], f"{table.columns}, _part int").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def read_copy(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Rows of the tab-separated text form of bulk loads (sources.documents.write_copy), by columns with types."""
    field_of = F.split("value", "\t", -1)

    def plain(text: Column) -> Column:
        out = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))  # a doubled backslash is set aside first
        for escaped, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
            out = F.replace(out, F.lit(escaped), F.lit(char))
        return F.replace(out, F.lit("\u0000"), F.lit("\\"))

    def value(i: int, kind: str) -> Column:
        text = F.get(field_of, F.lit(i))
        if kind == "boolean":
            out = text == "t"
        elif kind == "array<string>":
            items = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
            out = F.transform(items, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
        else:
            out = plain(text).cast(kind)
        return F.when(text != "\\N", out)

    return spark.read.text(path).select(*(value(i, kind).alias(name) for i, (name, kind) in enumerate(x.split(" ", 1) for x in columns.split(", "))))
