"""Weakly labelled documents from bulk annotations: row filters, joins and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import decode, role_code, strip_prefix
from .documents import stamp_concepts, stamp_relations


def entity_classes(rows: DataFrame, scope: DataFrame) -> DataFrame:
    """Add (canonical_type, semantic_class) to rows with entity_type: of the first registry that has it, then by synonym, else ''."""
    def registry(corpus: str, name: str) -> DataFrame:
        return F.broadcast(scope.filter(F.col("corpus") == corpus).select("entity_type", F.col("semantic_class").alias(name)))

    out = rows.join(registry("BC5CDR", "_a"), "entity_type", "left").join(registry("BioRED", "_b"), "entity_type", "left")
    other = lambda i: decode(F.col("entity_type"), {k: v[i] for k, v in C.TYPE_SYNONYMS.items()}, F.lit(None).cast("string"))
    known = F.coalesce("_a", "_b")
    return out.withColumns({"canonical_type": F.when(known.isNotNull(), F.col("entity_type")).otherwise(F.coalesce(other(0), F.col("entity_type"))), "semantic_class": F.coalesce(known, other(1), F.lit(""))}).drop("_a", "_b")


def _stamped(docs: DataFrame, mapped: DataFrame, table: DataFrame, sample: DataFrame, least_score: float) -> DataFrame:
    """Sampled documents with certain targets and relations, and flags: `_pair` (a mapped chemical and a mapped disease), `_seen` relations."""
    sure = mapped.filter((F.col("confidence") >= C.FOOTPRINT_CONFIDENCE) & F.col("target_active")).withColumn("confidence", F.lit(C.SILVER_CONFIDENCE))
    own = docs.join(sample.select("pmid"), "pmid", "left_semi").withColumn("_seen", F.size("relations"))
    own = own.withColumn("relations", F.filter("relations", lambda r: F.coalesce(r["extra"]["source_score"], F.lit(0.0)) >= least_score))
    out = stamp_relations(stamp_concepts(own, sure), table, lookup_corpus="BioRED")
    has = lambda cls: F.exists("entities", lambda e: (e["semantic_class"] == cls) & e["mapped_id"].isNotNull())
    return out.withColumn("_pair", F.coalesce(has("chemical") & has("disease"), F.lit(False)))


def convert(docs: DataFrame, mapped: DataFrame, table: DataFrame, sample: DataFrame, least_score: float = C.LEAST_SCORE) -> DataFrame:
    """Sampled documents with certain targets and relations: kept if a chemical and a disease are mapped and a relation is left."""
    out = _stamped(docs, mapped, table, sample, least_score)
    return out.filter(F.col("_pair") & (F.size("relations") > 0)).drop("_pair", "_seen")


def conversion_funnel(docs: DataFrame, mapped: DataFrame, table: DataFrame, sample: DataFrame, least_score: float = C.LEAST_SCORE) -> DataFrame:
    """One row: documents seen, sampled, kept and dropped by cause; entities seen and mapped; relations seen and left by score.

    A document without a mapped pair counts under that cause alone.
    """
    rows = _stamped(docs, mapped, table, sample, least_score)
    left = F.size("relations") > 0
    mapped_entities = F.size(F.filter("entities", lambda e: e["mapped_id"].isNotNull()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    counts = rows.agg(
        F.count("*").alias("sampled"), F.count_if(F.col("_pair") & left).alias("kept"), F.count_if(~F.col("_pair")).alias("no_pair"), F.count_if(F.col("_pair") & ~left).alias("no_relations"),
        total(F.size("entities")).alias("entities"), total(mapped_entities).alias("entities_mapped"), total(F.col("_seen")).alias("relations"), total(F.size("relations")).alias("relations_scored"),
    )
    return docs.agg(F.count("*").alias("documents")).crossJoin(counts)  # one row each


def relation_counts(relations: DataFrame) -> DataFrame:
    """Loaded bulk relations by source name and label, whether or not they end up in a document."""
    label = decode(F.col("relation"), C.BULK_RELATIONS, F.lit(C.DEFAULT_RELATION))
    return relations.groupBy("relation", label.alias("label")).agg(F.count("*").alias("relations"))


def bulk_relations(rows: DataFrame, gold: DataFrame, most: int | None = None) -> DataFrame:
    """(pmid, relation, subject, object) of bulk rows (pmid, relation, subject, object, ord) between chemicals and diseases.

    Gold pmids go. With `most` (C.BULK_PMIDS in the reference) reading stops at
    the first row of the pmid after so many, so later rows of pmids already
    taken are lost too; None keeps all rows.
    """
    kind = lambda c: F.substring_index(c, "|", 1)
    code = lambda c: strip_prefix(role_code(F.col(c)))
    out = rows.select("pmid", "relation", kind("subject").alias("subject_type"), code("subject").alias("subject"), kind("object").alias("object_type"), code("object").alias("object"), "ord")
    both = F.col("subject_type").isin("Chemical", "Disease") & F.col("object_type").isin("Chemical", "Disease")
    out = out.filter(both & ~F.col("subject").isin("", "-") & ~F.col("object").isin("", "-")).join(gold.select("pmid"), "pmid", "left_anti")
    if most is None:
        return out.drop("ord")
    firsts = out.groupBy("pmid").agg(F.min("ord").alias("first"))
    stop = firsts.orderBy("first").limit(most + 1).agg(F.count("*").alias("n"), F.max("first").alias("stop"))
    return out.crossJoin(F.broadcast(stop)).filter((F.col("n") <= most) | (F.col("ord") < F.col("stop"))).drop("n", "stop", "ord")


def bulk_mentions(rows: DataFrame, pmids: DataFrame) -> DataFrame:
    """(pmid, code, mention): the first non-empty name of each code in a document, by ord."""
    own = rows.join(pmids.select("pmid").distinct(), "pmid", "left_semi")
    name = F.trim(F.substring_index("mentions", "|", 1))
    own = own.select("pmid", strip_prefix(F.col("code")).alias("code"), name.alias("mention"), "ord").filter("mention <> ''")
    return own.groupBy("pmid", "code").agg(F.min_by("mention", "ord").alias("mention"))


def bulk_documents(relations: DataFrame, mentions: DataFrame, mapped: DataFrame, most: int | None = C.BULK_DOCUMENTS) -> DataFrame:
    """One document per relation whose ends have a name: text, spans, targets and the weighted label; all of them if most is None."""
    named = lambda s: mentions.select("pmid", F.col("code").alias(s), F.col("mention").alias(f"{s}_text"))
    target = lambda s: mapped.select(F.col("code").alias(s), F.col("target_id").alias(f"{s}_id"), (F.col("confidence") * C.BULK_WEIGHT).alias(f"{s}_confidence"))
    rows = relations.join(named("subject"), ["pmid", "subject"]).join(named("object"), ["pmid", "object"]).join(target("subject"), "subject", "left").join(target("object"), "object", "left")
    label = decode(F.col("relation"), C.BULK_RELATIONS, F.lit(C.DEFAULT_RELATION))
    begin = F.char_length("subject_text") + 1 + F.char_length(label) + 1
    entity = lambda s, at: F.struct(at.alias("span_start"), (at + F.char_length(f"{s}_text")).alias("span_end"), F.col(f"{s}_text").alias("surface_text"), F.lower(f"{s}_type").alias("semantic_class"), F.col(s).alias("original_code"), F.col(f"{s}_id").alias("mapped_id"), F.col(f"{s}_confidence").alias("mapping_confidence"))
    out = rows.select(
        "pmid", "relation", F.concat_ws(" ", "subject_text", label, "object_text").alias("text"),
        F.array(entity("subject", F.lit(0)), entity("object", begin)).alias("entities"),
        F.array(F.struct(F.lit(0).alias("subject_idx"), F.lit(1).alias("object_idx"), label.alias("target_relation"), F.lit(C.DEFAULT_TIER).alias("tier"))).alias("relations"),
    )
    return out if most is None else out.orderBy("pmid", "relation", "text").limit(most)


def label_distribution(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("relations").alias("r")).groupBy(F.col("r.target_relation").alias("target_relation")).agg(F.count("*").alias("relations")).orderBy(F.desc("relations"), "target_relation")


def unknown_types(docs: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent types without a class: a top-k report."""
    rows = docs.select(F.explode("entities").alias("e")).filter("coalesce(e.semantic_class, '') = ''")
    return rows.groupBy(F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity_type").limit(top)
