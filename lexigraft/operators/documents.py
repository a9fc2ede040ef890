"""Nested documents: assembly, stamping of concepts and relations, synthesis, splits and their audits.

Relations point at entities by position, so arrays are rewritten in place with
transform() or rebuilt in their order, never collected without it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import join_text, percent, split_composite, strip_prefix, strip_suffix
from ..schemas import CANDIDATE, SCHEMA_VERSION
from .lookup import attach


def first_index(codes: Column, wanted: Column) -> Column:
    """The 0-based place of a code, or else of the first of its comma-joined parts that is there; null if none is."""
    place = lambda c: F.nullif(F.array_position(codes, c), F.lit(0).cast("long")) - 1
    parts = F.filter(F.transform(F.split(wanted, ","), lambda p: place(F.trim(p))), lambda p: p.isNotNull())
    return F.coalesce(place(wanted), F.try_element_at(parts, F.lit(1))).cast("int")


def assemble(raw: DataFrame, scope: DataFrame, corpus: str, split: str) -> DataFrame:
    """Documents of raw annotated text (schemas.RAW_DOCUMENT); relations whose ends aren't found are left out."""
    own = scope.filter(F.col("corpus") == corpus)
    types = own.agg(F.map_from_entries(F.collect_list(F.struct("entity_type", F.struct("semantic_class", "in_scope")))).alias("_types"))
    docs = raw.withColumnsRenamed({"entities": "_entities", "relations": "_relations"}).crossJoin(F.broadcast(types))  # one row: the registry of a corpus
    code = lambda e: F.nullif(F.trim(e["code"]), F.lit(""))
    spec = lambda e: F.try_element_at("_types", F.coalesce(e["entity_type"], F.lit("")))
    none = F.lit(None).cast("string")

    def entity(e: Column, i: Column) -> Column:
        return F.struct(
            F.concat(F.lit("T"), i + 1).alias("id"),
            e["start"].alias("span_start"),
            e["end"].alias("span_end"),
            F.coalesce(e["mention"], F.lit("")).alias("surface_text"),
            F.coalesce(e["entity_type"], F.lit("")).alias("entity_type"),
            spec(e)["semantic_class"].alias("semantic_class"),
            code(e).alias("original_code"),
            none.alias("mapped_id"),
            F.lit(None).cast("double").alias("mapping_confidence"),
            F.lit(None).cast("boolean").alias("target_active"),
            F.coalesce(~spec(e)["in_scope"], F.lit(False)).alias("out_of_scope"),
            F.struct(F.nullif(e["extra"], F.lit("")).alias("source_extra"), F.lit(None).cast("boolean").alias("silver"), none.alias("source")).alias("extra"),
        )

    docs = docs.withColumn("_codes", F.transform("_entities", code))  # a column, or each end of each relation makes it anew
    codes = F.col("_codes")

    def relation(r: Column) -> Column:
        return F.struct(
            first_index(codes, F.trim(r["subject"])).alias("subject_idx"),
            first_index(codes, F.trim(r["object"])).alias("object_idx"),
            F.coalesce(r["relation_type"], F.lit("")).alias("source_relation_type"),
            none.alias("target_relation"),
            F.lit(None).cast("int").alias("tier"),
            F.lit(None).cast("double").alias("target_probability"),
            F.nullif(r["novelty"], F.lit("")).alias("novelty"),
            F.struct(
                none.alias("subject_class"), none.alias("object_class"), F.lit(None).cast("boolean").alias("default_used"), F.lit(None).cast(f"array<{CANDIDATE}>").alias("target_candidates"),
                none.alias("attribute_id"), F.lit(None).cast("boolean").alias("silver"), r["score"].alias("source_score"), none.alias("source_relation"),
            ).alias("extra"),
        )

    relations = F.filter(F.transform("_relations", relation), lambda r: r["subject_idx"].isNotNull() & r["object_idx"].isNotNull())
    return docs.select(
        "pmid",
        F.lit(corpus).alias("corpus"),
        F.lit(split).alias("split"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
        join_text(F.col("title"), F.col("abstract")).alias("text"),
        F.transform("_entities", entity).alias("entities"),
        relations.alias("relations"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def coded(docs: DataFrame) -> DataFrame:
    """Documents with no more of them than entities' codes, which is all that outcomes of a mapping need: texts, spans and relations stay out of shuffles."""
    return docs.select("pmid", "corpus", "split", F.transform("entities", lambda e: F.struct(e["original_code"].alias("original_code"), e["out_of_scope"].alias("out_of_scope"))).alias("entities"))


def stamp_concepts(docs: DataFrame, mapped: DataFrame) -> DataFrame:
    """Write each entity's target from mapped (code, target_id, confidence, target_active).

    Of a composite code's targets an active one comes first, then the more
    certain, then the earlier part; an inactive target's confidence is halved.
    Out-of-scope entities and sentinel codes are cleared. Documents need no
    unique key, and may come in any order each time that they are read.
    """
    wanted = lambda e: F.when(~F.coalesce(e["out_of_scope"], F.lit(False)), e["original_code"])
    bare = lambda p: strip_prefix(p, any_case=True)
    parts = lambda e: F.coalesce(F.filter(F.transform(split_composite(wanted(e)), bare), lambda p: ~p.isin(*C.SENTINELS)), F.array().cast("array<string>"))
    # a code's best target, its place in the order first
    confidence = F.when(F.col("target_active"), F.col("confidence")).otherwise(F.bround(F.col("confidence") * C.INACTIVE_FACTOR, 6))
    value = F.struct((~F.col("target_active")).cast("int").alias("inactive"), (-F.col("confidence")).alias("doubt"), F.col("target_id"), confidence.alias("confidence"), "target_active")
    best = mapped.select(F.col("code").alias("key"), value.alias("value")).groupBy("key").agg(F.min("value").alias("value"))
    stamped = attach(docs, F.flatten(F.transform("entities", parts)), best, "_best")

    def hit(e: Column) -> Column:
        """The best target of an entity's parts, looked up once."""
        found = F.transform(parts(e), lambda p, i: F.struct(F.try_element_at(F.filter("_best", lambda b: b["key"] == p), F.lit(1))["value"].alias("value"), i.alias("part")))
        known = F.filter(found, lambda x: x["value"].isNotNull())
        return F.array_min(F.transform(known, lambda x: F.struct(x["value"]["inactive"].alias("inactive"), x["value"]["doubt"].alias("doubt"), x["part"].alias("part"), x["value"].alias("value"))))["value"]

    def entity(e: Column, best: Column) -> Column:
        return e.withField("mapped_id", best["target_id"]).withField("mapping_confidence", best["confidence"]).withField("target_active", best["target_active"])

    return stamped.withColumn("entities", F.zip_with("entities", F.transform("entities", hit), entity)).select(*(F.col(f"`{c}`") for c in docs.columns))


def relation_candidates(table: DataFrame) -> DataFrame:
    """The candidates of each key of the relation table, and its best: the likeliest, of equals the first."""
    keys = ["corpus", "source_relation_type", "subject_class", "object_class"]
    return table.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "target_relation", "tier", "probability"))), lambda c: F.struct(c["target_relation"].alias("target_relation"), c["tier"].alias("tier"), c["probability"].alias("probability"))).alias("candidates"),
        F.max_by(F.struct("target_relation", "tier", "probability"), F.struct("probability", -F.col("ord"))).alias("best"),
    )


def stamp_relations(docs: DataFrame, table: DataFrame, lookup_corpus: str | None = None) -> DataFrame:
    """Write each relation's target and candidates from the relation table (a few hundred rows, broadcast as one map).

    Keys that the table lacks get the default relation; a relation whose
    position is outside the entities passes unchanged. lookup_corpus: look up as
    if documents came from this corpus.
    """
    key = lambda c, r, s, o: F.concat_ws("|", c, r, s, o)
    best = relation_candidates(table)
    entries = best.select(F.struct(key(F.col("corpus"), F.col("source_relation_type"), F.col("subject_class"), F.col("object_class")), F.struct("best", "candidates")).alias("entry"))
    lookup = entries.agg(F.map_from_entries(F.collect_list("entry")).alias("_table"))
    joined = docs.crossJoin(F.broadcast(lookup))  # one row
    joined = joined.withColumn("_classes", F.transform("entities", lambda e: F.coalesce(e["semantic_class"], F.lit(""))))
    corpus = F.lit(lookup_corpus) if lookup_corpus else F.col("corpus")

    def known(r: Column) -> Column:
        """A relation's classes and its row of the table, looked up once."""
        subject, object_ = F.get("_classes", r["subject_idx"]), F.get("_classes", r["object_idx"])
        row = F.try_element_at("_table", key(corpus, r["source_relation_type"], F.coalesce(subject, F.lit("")), F.coalesce(object_, F.lit(""))))
        return F.struct(subject.alias("subject"), object_.alias("object"), row.alias("row"))

    def relation(r: Column, k: Column) -> Column:
        subject, object_, found = k["subject"], k["object"], k["row"]
        default = F.struct(F.lit(C.DEFAULT_RELATION).alias("target_relation"), F.lit(C.DEFAULT_TIER).alias("tier"), F.lit(1.0).alias("probability"))
        chosen = F.coalesce(found["best"], default)
        extra = r["extra"].withField("subject_class", subject).withField("object_class", object_).withField("default_used", found.isNull())
        extra = extra.withField("target_candidates", F.coalesce(found["candidates"], F.array(default)))
        stamped = r.withField("target_relation", chosen["target_relation"]).withField("tier", chosen["tier"]).withField("target_probability", chosen["probability"]).withField("extra", extra)
        return F.when((r["subject_idx"] < 0) | (r["object_idx"] < 0) | subject.isNull() | object_.isNull(), r).otherwise(stamped)

    return joined.withColumn("relations", F.zip_with("relations", F.transform("relations", known), relation)).drop("_table", "_classes")


def conversion_summary(docs: DataFrame) -> DataFrame:
    return docs.groupBy("corpus", "split").agg(F.count("*").alias("documents"), F.sum(F.size("entities")).alias("entities"), F.sum(F.size("relations")).alias("relations"))


def unregistered_types(docs: DataFrame) -> DataFrame:
    rows = docs.select("corpus", F.explode("entities").alias("e")).filter("e.semantic_class is null and e.entity_type <> ''")
    return rows.groupBy("corpus", F.col("e.entity_type").alias("entity_type")).agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "corpus", "entity_type")


def mapping_outcomes(docs: DataFrame) -> DataFrame:
    """Entities of each corpus and split: mapped and active, mapped and inactive, unmapped, out of scope."""
    count = lambda test: F.sum(F.size(F.filter("entities", test)))
    scoped = lambda e: ~F.coalesce(e["out_of_scope"], F.lit(False))
    return docs.groupBy("corpus", "split").agg(
        count(lambda e: scoped(e) & e["mapped_id"].isNotNull() & F.coalesce(e["target_active"], F.lit(False))).alias("active"),
        count(lambda e: scoped(e) & e["mapped_id"].isNotNull() & ~F.coalesce(e["target_active"], F.lit(False))).alias("inactive"),
        count(lambda e: scoped(e) & e["mapped_id"].isNull()).alias("unmapped"),
        count(lambda e: ~scoped(e)).alias("out_of_scope"),
    )


def mapping_shares(outcomes: DataFrame) -> DataFrame:
    """Outcomes with the percentage of each among entities in scope, to one digit."""
    scoped = F.col("active") + F.col("inactive") + F.col("unmapped")
    return outcomes.withColumns({f"{c}_pct": percent(F.col(c), scoped, 1) for c in ("active", "inactive", "unmapped")})


def defaulted_pairs(docs: DataFrame) -> DataFrame:
    """Relations that the table lacks, by source relation and classes of both ends."""
    rows = docs.select(F.explode("relations").alias("r")).filter("r.extra.default_used")
    return rows.groupBy(F.col("r.source_relation_type").alias("source_relation_type"), F.col("r.extra.subject_class").alias("subject_class"), F.col("r.extra.object_class").alias("object_class")).agg(F.count("*").alias("relations"))


def relation_outcomes(docs: DataFrame) -> DataFrame:
    """Relations by split and target: counts, defaulted ones and those with several candidates, with totals over splits."""
    rows = docs.select("split", F.explode("relations").alias("r"))
    out = rows.rollup("split", "r.target_relation").agg(
        F.count("*").alias("relations"), F.count_if("r.extra.default_used").alias("defaulted"), F.count_if(F.size("r.extra.target_candidates") > 1).alias("several"), F.count_if(F.col("r.tier") == 1).alias("tier1"), F.grouping_id().alias("level")
    )
    return out


def eligibility(docs: DataFrame) -> DataFrame:
    """Documents with cause, class and code of the first entity whose target isn't verified; null if all are."""
    real = lambda e: ~F.coalesce(e["out_of_scope"], F.lit(False)) & e["semantic_class"].isin("chemical", "disease") & e["original_code"].isNotNull() & ~e["original_code"].isin(*C.SENTINELS)
    bad = lambda e: real(e) & (e["mapped_id"].isNull() | ~F.coalesce(e["target_active"], F.lit(True)))
    first = F.try_element_at(F.filter("entities", bad), F.lit(1))
    cause = F.when(first["mapped_id"].isNull(), "no_verified_mapping").otherwise("inactive_target")
    return docs.withColumn("drop", F.when(first.isNotNull(), F.struct(cause.alias("cause"), first["semantic_class"].alias("semantic_class"), first["original_code"].alias("code"))))


def assemble_split(sources: list[DataFrame], split: str, gold: tuple[str, ...], filter_unverified: bool) -> DataFrame:
    """The union of sources as one split; outside train only gold corpora may come in and unverified documents go."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source, allowMissingColumns=True)
    out = eligibility(out.withColumn("split", F.lit(split)))
    if split != "train":
        strange = F.when(~F.col("corpus").isin(*gold), F.raise_error(F.concat(F.lit("not a gold corpus in "), F.lit(split), F.lit(": "), F.col("corpus"))).cast("boolean"))
        out = out.filter(strange.isNull())
    return out if filter_unverified else out.withColumn("drop", F.lit(None).cast(out.schema["drop"].dataType))


def split_audit(assembled: DataFrame) -> DataFrame:
    """Documents of each corpus, split and cause: seen is kept and dropped together."""
    cause = F.coalesce(F.col("drop.cause"), F.lit("kept"))
    return assembled.groupBy("split", "corpus", cause.alias("cause")).agg(F.count("*").alias("documents"))


def synthesise(triples: DataFrame, terms: DataFrame, below: DataFrame, least_causative: int = C.LEAST_CAUSATIVE) -> DataFrame:
    """Documents from stated triples (source_id, destination_id, type_id, active, ord) whose ends lie in scope.

    below: (start, reached) of the scope anchors, strict. Raises if fewer than
    least_causative causative triples are left.
    """
    anchor = C.SCOPE_ANCHORS
    flags = below.groupBy(F.col("reached").alias("id")).agg(*(F.max(F.col("start") == a).alias(name) for name, a in anchor.items()))
    of = lambda s: flags.select(F.col("id").alias(f"{s}_id"), *(F.col(n).alias(f"{s}_{n}") for n in anchor))
    rows = triples.filter((F.col("active") == "1") & F.col("type_id").isin(*C.SYNTHETIC_ATTRIBUTES))
    rows = rows.join(of("source"), "source_id").join(of("destination"), "destination_id")
    chemical = F.col("destination_substance") | F.col("destination_product")
    causative = F.col("type_id") == C.TIER1_ATTRIBUTES["causative-agent"]
    other = F.col("destination_finding") | F.col("destination_event") | F.col("destination_procedure")
    rows = rows.filter(F.col("source_finding") & F.when(causative, chemical).otherwise(other))
    named = lambda s: terms.select(F.col("id").alias(f"{s}_id"), strip_suffix(F.col("term")).alias(f"{s}_term"))
    rows = rows.join(named("source"), "source_id").join(named("destination"), "destination_id")
    label = F
    for key, name in C.SYNTHETIC_ATTRIBUTES.items():
        label = label.when(F.col("type_id") == key, F.lit(name))
    rows = rows.select("*", label.otherwise(F.lit(None)).alias("label"), F.when(chemical, "chemical").otherwise("disease").alias("object_class"))
    found = rows.filter(causative).count()
    if found < least_causative:
        raise ValueError(f"{found} causative triples in scope, fewer than {least_causative}")
    index = F.row_number().over(Window.partitionBy("bucket").orderBy("ord", "source_id", "destination_id", "type_id")) - 1
    # numbers run on from part to part: of a file's block, or of plain numbers, so many rows each
    part = "struct(ord.file, ord.block, shiftright(ord.row, 20))" if "struct" in dict(rows.dtypes)["ord"] else "shiftright(ord, 20)"
    buckets = rows.withColumn("bucket", F.expr(part))
    starts = buckets.groupBy("bucket").count().withColumn("start", F.coalesce(F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "start")
    rows = buckets.join(F.broadcast(starts), "bucket").withColumn("number", F.col("start") + index)
    verb = F.concat(F.lit(" "), F.col("label"), F.lit(" "))
    text = F.concat("source_term", verb, "destination_term", F.lit("."))
    begin = F.char_length("source_term") + F.char_length(verb)
    entity = lambda i, s, e, term, kind, cls, target: F.struct(F.lit(f"T{i}").alias("id"), s.alias("span_start"), e.alias("span_end"), term.alias("surface_text"), kind.alias("entity_type"), cls.alias("semantic_class"), target.alias("mapped_id"), F.lit(C.SYNTHETIC_CONFIDENCE).alias("mapping_confidence"), F.lit(True).alias("target_active"))
    return rows.select(
        F.format_string("SYNTHETIC_%07d", "number").alias("pmid"),
        F.lit("synthetic").alias("corpus"),
        text.alias("text"),
        F.array(
            entity(1, F.lit(0), F.char_length("source_term"), F.col("source_term"), F.lit("DiseaseOrPhenotypicFeature"), F.lit("disease"), F.col("source_id")),
            entity(2, begin, begin + F.char_length("destination_term"), F.col("destination_term"), F.when(F.col("object_class") == "chemical", "ChemicalEntity").otherwise("DiseaseOrPhenotypicFeature"), F.col("object_class"), F.col("destination_id")),
        ).alias("entities"),
        F.array(F.struct(F.lit(0).alias("subject_idx"), F.lit(1).alias("object_idx"), F.col("label").alias("target_relation"), F.lit(1).alias("tier"), F.lit(1.0).alias("target_probability"), F.col("type_id").alias("attribute_id"))).alias("relations"),
    )
