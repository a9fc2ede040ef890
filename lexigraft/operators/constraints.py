"""Domain and range rules of attributes, and the compatibility tables that a solver looks up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import decode, expression_roots, expression_tokens


def descriptions(rows: DataFrame, needed: DataFrame, full_name: str = C.FULL_NAME) -> DataFrame:
    """One term for each needed id from rows (concept_id, type_id, term, active, ord).

    The first term stays if it ends with a bracket; else the first full name after it that does, or the last full name.
    """
    own = rows.filter(F.col("active") == "1").join(needed.select(F.col("id").alias("concept_id")).distinct(), "concept_id", "left_semi")
    terms = own.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("ord", "term", (F.col("type_id") == full_name).alias("full")))).alias("terms"))
    step = lambda now, t: F.when(now.isNull(), t["term"]).when(t["full"] & ~F.endswith(now, F.lit(")")), t["term"]).otherwise(now)
    return terms.select(F.col("concept_id").alias("id"), F.aggregate("terms", F.lit(None).cast("string"), step).alias("term"))


def domain_rules(domains: DataFrame) -> DataFrame:
    """(domain, expression, tokens, roots) of the domain reference set; a domain without roots is its own."""
    rows = domains.filter(F.col("active") == "1")
    roots = expression_roots(F.col("domain_constraint"))
    return rows.select(
        F.col("referenced_id").alias("domain"),
        F.col("domain_constraint").alias("expression"),
        expression_tokens(F.col("domain_constraint")).alias("tokens"),
        F.when(F.size(roots) == 0, F.array("referenced_id")).otherwise(roots).alias("roots"),
    )


def attribute_rules(attributes: DataFrame, ranges: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """One row per attribute with its domains and ranges as arrays; attributes of either set are kept."""
    strength, content = decode(F.col("rule_strength_id"), C.RULE_STRENGTH), decode(F.col("content_type_id"), C.CONTENT_TYPE)
    domains = attributes.filter(F.col("active") == "1").withColumnRenamed("domain_id", "domain").join(F.broadcast(rules), "domain", "left")
    domains = domains.groupBy(F.col("referenced_id").alias("attribute")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "domain", F.coalesce("roots", F.array("domain")).alias("roots"), "grouped", "cardinality", strength.alias("strength"), content.alias("content")))).alias("domains")
    )
    wide = ranges.filter(F.col("active") == "1").groupBy(F.col("referenced_id").alias("attribute")).agg(
        F.array_sort(F.collect_list(F.struct("ord", F.col("range_constraint").alias("expression"), expression_roots(F.col("range_constraint")).alias("roots"), strength.alias("strength"), content.alias("content")))).alias("ranges")
    )
    return domains.join(wide, "attribute", "full_outer").join(names.select(F.col("id").alias("attribute"), F.col("term").alias("name")), "attribute", "left")


def anchors(rules: DataFrame) -> DataFrame:
    """Every root of a domain or a range, once."""
    flat = lambda c: rules.select(F.explode(F.flatten(F.transform(c, lambda x: x["roots"]))).alias("id"))
    return flat("domains").union(flat("ranges")).distinct()


def relation_constraints(rules: DataFrame) -> DataFrame:
    """(relation, attribute, domains, ranges) of the relations that stand for attributes; absent ones have null arrays."""
    spark = rules.sparkSession
    wanted = spark.createDataFrame(list(C.TIER1_ATTRIBUTES.items()), "relation string, attribute string")
    return F.broadcast(wanted).join(rules, "attribute", "left").select("relation", "attribute", "domains", "ranges")


def compatible_concepts(below: DataFrame, classes: dict[str, tuple[str, ...]] = C.CLASS_ANCHORS) -> DataFrame:
    """(semantic_class, concept) for each concept at or under an anchor of the class; below is (start, reached) of the anchors."""
    spark = below.sparkSession
    own = spark.createDataFrame([(k, a) for k, ids in classes.items() for a in ids], "semantic_class string, anchor string")
    under = below.join(F.broadcast(own), below["start"] == own["anchor"]).select("semantic_class", F.col("reached").alias("concept"))
    return under.union(own.select("semantic_class", "anchor")).distinct()


def valid_pairs(constraints: DataFrame, below: DataFrame, classes: dict[str, tuple[str, ...]] = C.CLASS_ANCHORS) -> DataFrame:
    """(relation, subject_class, object_class, valid) for every combination of the few relations and classes.

    A class fits a side if one of its anchors is a root of that side or lies under one, or if the side has no roots.
    """
    spark = constraints.sparkSession
    own = spark.createDataFrame([(k, a) for k, ids in classes.items() for a in ids], "semantic_class string, anchor string")
    above = below.select(F.col("start").alias("root"), F.col("reached").alias("anchor")).union(own.select("anchor", "anchor"))
    above = own.join(above, "anchor", "left").groupBy("semantic_class").agg(F.collect_set("root").alias("fits"))
    flat = lambda c: F.coalesce(F.flatten(F.transform(c, lambda x: x["roots"])), F.array().cast("array<string>"))
    sides = constraints.select("relation", flat("domains").alias("from_roots"), flat("ranges").alias("to_roots"))
    subject = above.select(F.col("semantic_class").alias("subject_class"), F.col("fits").alias("subject_fits"))
    object_ = above.select(F.col("semantic_class").alias("object_class"), F.col("fits").alias("object_fits"))
    fits = lambda roots, have: (F.size(roots) == 0) | F.arrays_overlap(roots, have)
    joined = sides.crossJoin(F.broadcast(subject)).crossJoin(F.broadcast(object_))
    return joined.select("relation", "subject_class", "object_class", (fits("from_roots", "subject_fits") & fits("to_roots", "object_fits")).alias("valid"))
