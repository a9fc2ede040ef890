"""Codes to target concepts: four tiers of evidence, the best candidate of each code, and reports on the result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import normalise_code, percent, split_composite


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; ties fall to the order given, which should be total."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def best_of(df: DataFrame, keys: list[str], order: list[Column], values: list[str]) -> DataFrame:
    """The values of each key's least row by an ascending order; tasks keep one row of a key before the shuffle."""
    least = F.min_by(F.struct(*values), F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))))
    return df.groupBy(*keys).agg(least.alias("_least")).select(*keys, *(F.col(f"_least.{v}").alias(v) for v in values))


def term_rank(tty: Column, ranks: Mapping[str, int] = C.TERM_RANK) -> Column:
    out = F
    for name, rank in ranks.items():
        out = out.when(tty == name, F.lit(rank))
    return out.otherwise(F.lit(C.OTHER_RANK))


def target_atoms(atoms: DataFrame, sab: str) -> DataFrame:
    """The best atom of the target vocabulary for each cui: term rank, then the shorter term, then the code."""
    own = atoms.filter(F.col("sab") == sab)
    best = first_by(own, ["cui"], [term_rank(F.col("tty")), F.length("str"), F.col("code")])
    return best.select("cui", F.col("code").alias("target_id"), F.col("str").alias("term"), "tty")


CANDIDATE = ("code", "target_id", "term", "tty", "confidence", "method", "tier")


def curated_candidates(codes: DataFrame, curated: DataFrame, atoms: DataFrame, target: str) -> DataFrame:
    """Tier 1: curated maps, with the term of the first cui that has the target's code, else the code itself."""
    named = atoms.filter(F.col("sab") == target).groupBy(F.col("code").alias("to_code")).agg(F.min_by(F.struct("str", "tty"), "ord").alias("atom"))
    hits = curated.filter(F.col("to_code").rlike(r"^\d{6,18}$")).join(codes, curated["from_code"] == codes["code"]).join(named, "to_code", "left")
    return hits.select(
        "code",
        F.col("to_code").alias("target_id"),
        F.coalesce("atom.str", "to_code").alias("term"),
        F.coalesce("atom.tty", F.lit("")).alias("tty"),
        F.lit(C.CURATED_CONFIDENCE).alias("confidence"),
        F.concat(F.lit("curated:"), "mapset").alias("method"),
        F.lit(1).alias("tier"),
    ).distinct()


def code_cuis(codes: DataFrame, atoms: DataFrame, source: str) -> DataFrame:
    return atoms.filter(F.col("sab") == source).join(codes, "code").groupBy("code", "cui").agg(F.min("ord").alias("ord"))


def shared_candidates(cuis: DataFrame, targets: DataFrame) -> DataFrame:
    """Tier 2: the target's atom under the same cui."""
    return cuis.join(targets, "cui").select("code", "target_id", "term", "tty", F.lit(C.SHARED_CONFIDENCE).alias("confidence"), F.concat(F.lit("shared:"), "cui").alias("method"), F.lit(2).alias("tier"))


def hop_candidates(cuis: DataFrame, rels: DataFrame, targets: DataFrame) -> DataFrame:
    """Tier 3: the target's atom of a cui one relation away."""
    confidence = F
    for rel, value in C.HOP_CONFIDENCE.items():
        confidence = confidence.when(F.col("rel") == rel, F.lit(value))
    near = rels.filter(F.col("rel").isin(*C.HOP_CONFIDENCE)).select(F.col("cui1").alias("cui"), F.col("cui2").alias("other"), "rel")
    hop = cuis.join(near, "cui").join(targets.withColumnRenamed("cui", "other"), "other")
    return hop.select("code", "target_id", "term", "tty", confidence.otherwise(F.lit(0.0)).alias("confidence"), F.concat(F.lit("hop:"), "rel").alias("method"), F.lit(3).alias("tier")).distinct()


def type_candidates(cuis: DataFrame, types: DataFrame, roots: DataFrame) -> DataFrame:
    """Tier 4: the top concept of a semantic type, once for each top, named by its first type."""
    typed = cuis.withColumnRenamed("ord", "cui_ord").join(types, "cui").join(F.broadcast(roots), "sty")
    first = first_by(typed, ["code", "target_id"], [F.col("cui_ord"), F.col("ord"), F.col("sty")])
    return first.select("code", "target_id", "term", F.lit("").alias("tty"), F.lit(C.FALLBACK_CONFIDENCE).alias("confidence"), F.concat(F.lit("type:"), "sty").alias("method"), F.lit(4).alias("tier"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """One candidate for each code: the lowest tier, then confidence, term rank, shorter term and smaller id."""
    order = [F.col("tier"), -F.col("confidence"), term_rank(F.col("tty")), F.length("term"), F.col("target_id"), F.col("method"), F.col("term")]
    return best_of(candidates, ["code"], order, [c for c in candidates.columns if c != "code"]).select(*candidates.columns)


def map_codes(codes: DataFrame, atoms: DataFrame, rels: DataFrame, types: DataFrame, curated: DataFrame, roots: DataFrame, source: str, target: str) -> DataFrame:
    """The best target of every code that has one: four bulk joins, one union and one aggregate.

    All codes of a cui have the same hops, so a cui's best one is found first and joined to them.
    """
    cuis, targets = code_cuis(codes, atoms, source), target_atoms(atoms, target)
    hops = best_candidates(hop_candidates(cuis.select("cui", F.col("cui").alias("code")).distinct(), rels, targets).select(*CANDIDATE))
    tiers = [
        curated_candidates(codes, curated, atoms, target),
        shared_candidates(cuis, targets),
        cuis.select("code", "cui").join(hops.withColumnRenamed("code", "cui"), "cui"),
        type_candidates(cuis, types, roots),
    ]
    out = tiers[0].select(*CANDIDATE)
    for tier in tiers[1:]:
        out = out.unionByName(tier.select(*CANDIDATE))
    return best_candidates(out)


def unmapped(codes: DataFrame, mapped: DataFrame, known: DataFrame) -> DataFrame:
    """Codes without a target, and whether they have no evidence at all or no path from it."""
    seen = known.select("code").distinct().withColumn("_seen", F.lit(True))
    rest = codes.join(mapped.select("code"), "code", "left_anti").join(seen, "code", "left")
    return rest.withColumn("reason", F.when(F.col("_seen"), "no_path").otherwise("no_evidence")).drop("_seen")


def harvest(mentions: DataFrame, scope: DataFrame) -> DataFrame:
    """Counts of (corpus, semantic_class, code) over mentions (corpus, entity_type, codes) whose type is in scope."""
    typed = mentions.join(F.broadcast(scope.filter("in_scope")), ["corpus", "entity_type"])
    parts = typed.select("corpus", "semantic_class", F.explode(split_composite(F.col("codes"))).alias("part"))
    codes = parts.select("corpus", "semantic_class", normalise_code(F.col("part")).alias("code"))
    return codes.filter("code is not null").groupBy("corpus", "semantic_class", "code").agg(F.count("*").alias("frequency"))


def rollup(counts: DataFrame) -> DataFrame:
    """Per code: total frequency and the sorted classes and corpora, comma-joined."""
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    return counts.filter("frequency > 0").groupBy("code").agg(F.sum("frequency").alias("frequency"), joined("semantic_class").alias("classes"), joined("corpus").alias("corpora"))


def coverage(counts: DataFrame, mapped: DataFrame, threshold: float = C.HIGH_CONFIDENCE) -> DataFrame:
    """Per corpus and class: mentions, mapped and surely mapped ones, their shares and the mean confidence."""
    joined = counts.join(mapped.select("code", "confidence"), "code", "left")
    of = lambda test: F.sum(F.when(test, F.col("frequency")).otherwise(F.lit(0)))
    out = joined.groupBy("corpus", "semantic_class").agg(
        F.sum("frequency").alias("total_mentions"),
        of(F.col("confidence").isNotNull()).alias("mapped_mentions"),
        of(F.col("confidence") >= threshold).alias("sure_mentions"),
        F.sum(F.col("confidence") * F.col("frequency")).alias("_weight"),
    )
    text = lambda part: F.format_string("%.1f", F.when(F.col("total_mentions") == 0, 0.0).otherwise(100.0 * F.col(part) / F.col("total_mentions")))
    mean = F.when(F.col("mapped_mentions") == 0, F.lit(0.0)).otherwise(F.col("_weight") / F.col("mapped_mentions"))
    return out.select("corpus", "semantic_class", "total_mentions", "mapped_mentions", "sure_mentions", text("mapped_mentions").alias("mapped_pct"), text("sure_mentions").alias("sure_pct"), F.format_string("%.3f", mean).alias("mean_confidence"))


def method_tally(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy(F.substring_index("method", ":", 1).alias("method")).agg(F.count("*").alias("codes"))


def review_queue(mapped: DataFrame, threshold: float = C.HIGH_CONFIDENCE, top: int = 100) -> DataFrame:
    """The most frequent codes of low confidence: a top-k report."""
    return mapped.filter(F.col("confidence") < threshold).orderBy(F.desc("frequency"), "confidence", "code").limit(top)


def verify(mapped: DataFrame, active: DataFrame) -> DataFrame:
    """Flag the targets that are among the active concepts (id)."""
    known = active.select(F.col("id").alias("target_id")).distinct().withColumn("_active", F.lit(True))
    return mapped.join(known, "target_id", "left").withColumn("target_active", F.coalesce("_active", F.lit(False))).drop("_active")


def verification_summary(verified: DataFrame) -> DataFrame:
    inactive = ~F.col("target_active")
    out = verified.agg(
        F.count("*").alias("codes"),
        F.count_if(F.col("target_active")).alias("active"),
        F.count_if(inactive).alias("inactive"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("mentions"),
        F.coalesce(F.sum(F.when(inactive, F.col("frequency"))), F.lit(0)).alias("inactive_mentions"),
    )
    return out.withColumns({"inactive_pct": percent(F.col("inactive"), F.col("codes")), "inactive_mention_pct": percent(F.col("inactive_mentions"), F.col("mentions"))})


def scope_audit(mentions: DataFrame, scope: DataFrame) -> DataFrame:
    """Per corpus and type: mentions, distinct real ids, and whether the type is in scope, out of it or unregistered."""
    real = F.when(~F.col("code").isin(*C.SENTINELS), F.col("code"))
    counts = mentions.groupBy("corpus", "entity_type").agg(F.count("*").alias("mentions"), F.count_distinct(real).alias("unique_ids"))
    tag = F.when(F.col("in_scope").isNull(), "unregistered").when(F.col("in_scope"), "in_scope").otherwise("out_of_scope")
    return counts.join(F.broadcast(scope), ["corpus", "entity_type"], "left").withColumn("scope", tag)


def scope_summary(audit: DataFrame) -> DataFrame:
    """Sums over the types of a scope; distinct ids are added up, not counted anew."""
    return audit.groupBy("corpus", "scope").agg(F.sum("mentions").alias("mentions"), F.sum("unique_ids").alias("unique_ids"))
