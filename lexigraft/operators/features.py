"""Token labels, entity pairs and synonym pairs as training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import strip_suffix


#: Characters of a stretch of text in which tokens and entities are matched.
STRETCH = 256


def tokens(docs: DataFrame, pattern: str = r"\w+|[^\w\s]") -> DataFrame:
    """(doc, pos, start, end, token) by a regular expression: a plain stand-in for a word-piece tokenizer."""
    rows = docs.select("doc", "text", F.posexplode(F.split(F.regexp_replace("text", f"({pattern})", "\u0001$1\u0002"), "\u0001")).alias("pos", "piece")).filter("pos > 0")
    window = Window.partitionBy("doc").orderBy("pos")
    before = F.col("_lead") + F.coalesce(F.sum(F.char_length(F.translate("piece", "\u0002", ""))).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_lead", F.char_length(F.substring_index(F.regexp_replace("text", f"({pattern})", "\u0001$1\u0002"), "\u0001", 1)))
    token = F.substring_index("piece", "\u0002", 1)
    return rows.select("doc", (F.col("pos") - 1).alias("pos"), before.cast("int").alias("start"), (before + F.char_length(token)).cast("int").alias("end"), token.alias("token"))


def bio_align(token_rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc, pos, tag): B- at an entity's first overlapping token, I- up to its last, O elsewhere.

    token_rows (doc, pos, start, end, mask), entities (doc, ord, span_start,
    span_end, semantic_class). A later entity writes over an earlier one. Tokens
    of no width or with mask 0 take no part. Tokens meet only entities of the same
    stretch of STRETCH characters.
    """
    stretches = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / STRETCH))).alias("_part")
    usable = token_rows.filter("`end` > `start` and mask = 1").select("doc", "pos", "start", "end", stretches("start", "end"))
    wanted = entities.select("doc", "ord", "span_start", "span_end", "semantic_class", stretches("span_start", "span_end"))
    hit = usable.join(wanted, ["doc", "_part"]).filter("`end` > span_start and `start` < span_end")
    spans = hit.groupBy("doc", "ord", "semantic_class").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    filled = spans.select("doc", "ord", "semantic_class", "first", F.explode(F.sequence("first", "last")).alias("pos"))
    tag = F.concat(F.when(F.col("pos") == F.col("first"), "B-").otherwise("I-"), F.col("semantic_class"))
    last = filled.groupBy("doc", "pos").agg(F.max_by(tag, "ord").alias("tag"))
    return token_rows.select("doc", "pos").join(last, ["doc", "pos"], "left").select("doc", "pos", F.coalesce("tag", F.lit("O")).alias("tag"))


def bio_decode(tags: DataFrame) -> DataFrame:
    """(doc, first, last, semantic_class) of tags (doc, pos, tag); an I- that continues nothing begins an entity."""
    window = Window.partitionBy("doc").orderBy("pos")
    cls = F.substring("tag", 3, 1 << 20)
    before = F.lag("tag").over(window)
    goes_on = F.startswith("tag", F.lit("I-")) & before.isNotNull() & (before != "O") & (F.substring(before, 3, 1 << 20) == cls)
    rows = tags.withColumns({"_cls": cls, "_new": (~F.coalesce(goes_on, F.lit(False))).cast("int")})
    rows = rows.withColumn("_run", F.sum("_new").over(window)).filter("tag <> 'O'")
    return rows.groupBy("doc", "_run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("_cls").alias("semantic_class")).drop("_run")


def hash_order(*columns: Column | str, seed: int = 0) -> Column:
    """An order that looks random and is the same in every run and engine: the md5 of the joined values."""
    return F.md5(F.concat_ws("|", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns), F.lit(str(seed))))


def entity_pairs(entities: DataFrame, positives: DataFrame, ratio: float = C.NEGATIVE_RATIO, most: int = C.MAX_PAIRS, seed: int = 0) -> DataFrame:
    """(doc, i, j, label, weight): every positive pair once, by its likeliest row, and negatives in hash order.

    entities (doc, idx), positives (doc, i, j, label, probability, ord). A
    document without positives has no negatives; positives stay even beyond `most`.
    """
    kind = entities.schema["idx"].dataType
    pair = F.struct(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "probability", (-F.col("ord")).alias("early"), "label")
    told = positives.select("doc", F.lit(None).cast(kind).alias("idx"), pair.alias("pair"))
    rows = entities.select("doc", "idx").unionByName(told, allowMissingColumns=True)
    # one shuffle, by document; all that follows stays where the document is
    docs = rows.groupBy("doc").agg(F.collect_list("idx").alias("ids"), F.sort_array(F.collect_list("pair"), asc=False).alias("pairs"))
    apart = lambda x, before: (x["i"] != before["i"]) | (x["j"] != before["j"])
    docs = docs.select("doc", "ids", F.filter("pairs", lambda x, k: (k == 0) | apart(x, F.get("pairs", k - 1))).alias("kept"))
    p = F.size("kept")
    room = F.when(F.col("doc").isNotNull(), F.greatest(F.least(F.bround(F.lit(ratio) * p), F.lit(most) - p), F.lit(0))).otherwise(0)
    docs = docs.withColumn("room", room)
    # a row for the positive pairs, then one for each entity that others may be paired with
    some = F.when(F.col("room") > 0, F.col("ids")).otherwise(F.array().cast(entities.schema["idx"].dataType.simpleString().join(("array<", ">"))))
    each = docs.select("*", F.explode(F.concat(F.array(F.lit(None).cast(kind)), some)).alias("i"))
    each = each.withColumn("own", F.transform(F.filter("kept", lambda x: x["i"] == F.col("i")), lambda x: x["j"]))
    one = lambda i, j, label, weight, known: F.struct(i.alias("i"), j.alias("j"), label.alias("label"), weight.alias("weight"), F.lit(known).alias("known"))
    positive = F.transform("kept", lambda x: one(x["i"], x["j"], x["label"], x["probability"], True))
    other = F.transform(F.filter("ids", lambda j: (j != F.col("i")) & ~F.array_contains("own", j)), lambda j: one(F.col("i"), j, F.lit("no-relation"), F.lit(1.0), False))
    out = each.select("doc", "room", F.explode(F.when(F.col("i").isNull(), positive).otherwise(other)).alias("x")).select("doc", "room", "x.*")
    ranked = out.withColumn("_rank", F.row_number().over(Window.partitionBy("doc", "known").orderBy(hash_order("doc", "i", "j", seed=seed), "i", "j")))
    return ranked.filter("known or _rank <= room").select("doc", "i", "j", "label", "weight")


def synonym_counts(terms: DataFrame, least: int = 2) -> DataFrame:
    """(concept_id, terms) of distinct terms (concept_id, term): how many each concept has, of those that have several."""
    return terms.groupBy("concept_id").agg(F.count("*").alias("terms")).filter(F.col("terms") >= least)


def pair_budget(counts: DataFrame, cap: int) -> DataFrame:
    """One row of synonym_counts() rows: the pairs that an epoch draws, at most cap for a concept."""
    n = F.col("terms")
    return counts.agg(F.coalesce(F.sum(F.least(n * (n - 1) / 2, F.lit(cap))), F.lit(0)).cast("long").alias("pairs"))


def synonym_rows(rows: DataFrame) -> DataFrame:
    """(concept_id, term) of active description rows: each name without its suffix once for a concept."""
    return rows.filter("active = '1'").select("concept_id", strip_suffix(F.col("term")).alias("term")).filter("term <> ''").distinct()


def numbered_terms(terms: DataFrame) -> DataFrame:
    """Terms (concept_id, term) with index: each concept's numbered from 0 by the md5 of the terms, then by the terms.

    A concept's terms are ranked in up to 4,096 ranges of md5, so that a large concept is many small windows.
    """
    rows = terms.withColumn("_part", F.substring(F.md5("term"), 1, 3))
    before = Window.partitionBy("concept_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("concept_id", "_part").count().select("concept_id", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("concept_id", "_part").orderBy("term")) - 1
    return rows.withColumn("_place", place).join(starts, ["concept_id", "_part"]).select("concept_id", (F.col("_start") + F.col("_place")).alias("index"), "term")


#: Strides of pair numbers; one that divides the number of pairs gives way to the other.
STRIDES = (2_147_483_647, 2_147_483_629)


def synonym_pairs(terms: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """(concept_id, a, b): up to cap pairs of the terms (concept_id, term) of each concept, none twice.

    The pairs of n terms are numbered from 0 to n(n-1)/2; a concept draws numbers in a stride
    prime to their count, from a start by hash, so pairs that aren't drawn are never made.
    """
    counts = terms.groupBy("concept_id").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_all", F.expr("_n * (_n - 1) div 2"))
    start = F.conv(F.substring(hash_order("concept_id", seed=seed), 1, 8), 16, 10).cast("long")
    stride = F.when(F.col("_all") % STRIDES[0] == 0, F.lit(STRIDES[1])).otherwise(F.lit(STRIDES[0]))
    drawn = counts.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_all"), F.lit(cap)) - 1)))
    drawn = drawn.select("concept_id", ((start + F.col("_k") * stride) % F.col("_all")).alias("_m"))
    # pair m of i < j has j(j-1)/2 <= m < j(j+1)/2; the root may be off by one
    near = drawn.withColumn("_j", F.floor((1 + F.sqrt(1 + 8 * F.col("_m").cast("double"))) / 2))
    below = lambda j: F.expr(f"({j}) * (({j}) - 1) div 2")
    near = near.withColumn("_j", F.when(below("_j") > F.col("_m"), F.col("_j") - 1).when(below("_j + 1") <= F.col("_m"), F.col("_j") + 1).otherwise(F.col("_j")))
    ends = near.select("concept_id", (F.col("_m") - below("_j")).alias("_i"), "_j")
    own = numbered_terms(terms)
    of = lambda key, name: own.select("concept_id", F.col("index").alias(key), F.col("term").alias(name))
    return ends.join(of("_i", "a"), ["concept_id", "_i"]).join(of("_j", "b"), ["concept_id", "_j"]).select("concept_id", "a", "b")


def preferred_terms(rows: DataFrame, full_name: str = C.FULL_NAME, synonym: str = C.SYNONYM, active_concepts: DataFrame | None = None) -> DataFrame:
    """(concept_id, term): the first full name without its suffix, else the first non-empty synonym, by ord."""
    own = rows.filter("active = '1'")
    if active_concepts is not None:
        own = own.join(active_concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi")
    name = F.nullif(strip_suffix(F.col("term")), F.lit(""))
    full = F.min_by(F.when(F.col("type_id") == full_name, name), F.when((F.col("type_id") == full_name) & name.isNotNull(), F.col("ord")))
    plain = F.nullif(F.trim("term"), F.lit(""))
    other = F.min_by(F.when(F.col("type_id") == synonym, plain), F.when((F.col("type_id") == synonym) & plain.isNotNull(), F.col("ord")))
    return own.groupBy("concept_id").agg(F.coalesce(full, other).alias("term")).filter("term is not null")


def term_pool(terms: DataFrame) -> DataFrame:
    """(term, index) of terms (term): every distinct one once, numbered without gaps by the md5 of the terms, then by the terms.

    Terms are ranked within one of 4,096 ranges of md5; the ranges' starts are so many rows at most.
    """
    part = F.substring(F.md5("term"), 1, 3)
    terms = terms.select("term").distinct().withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = terms.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("term")) - 1
    return terms.withColumn("_place", place).join(F.broadcast(starts), "_part").select("term", (F.col("_start") + F.col("_place")).alias("index"))


def batch_labels(rows: DataFrame) -> DataFrame:
    """Rows (batch, pos, concept_id) with label: the concepts of a batch numbered from 0 by their first appearance.

    A batch is of a fixed size, so its window is small.
    """
    first = F.min("pos").over(Window.partitionBy("batch", "concept_id"))
    return rows.withColumn("_first", first).withColumn("label", F.dense_rank().over(Window.partitionBy("batch").orderBy("_first")) - 1).drop("_first")


def first_concepts(concepts: DataFrame, most: int) -> DataFrame:
    """The first `most` ids in order of their text: a cap that a caller asks for."""
    return concepts.select("id").distinct().orderBy("id").limit(most)


def multi_similarity_loss(pairs: DataFrame, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, margin: float = 0.1) -> DataFrame:
    """(anchor, loss) of similarities (anchor, other, same, similarity) in a batch, with hard mining by a margin."""
    group = Window.partitionBy("anchor")
    least_same = F.min(F.when(F.col("same"), F.col("similarity"))).over(group)
    most_other = F.max(F.when(~F.col("same"), F.col("similarity"))).over(group)
    rows = pairs.withColumns({"_low": least_same, "_high": most_other})
    hard = F.when(F.col("same"), F.col("similarity") - margin < F.col("_high")).otherwise(F.col("similarity") + margin > F.col("_low"))
    pull = F.sum(F.when(hard & F.col("same"), F.exp(-alpha * (F.col("similarity") - base))))
    push = F.sum(F.when(hard & ~F.col("same"), F.exp(beta * (F.col("similarity") - base))))
    out = rows.groupBy("anchor").agg(pull.alias("_pull"), push.alias("_push"))
    part = lambda c, w: F.log1p(F.coalesce(c, F.lit(0.0))) / F.lit(w)
    return out.select("anchor", (part("_pull", alpha) + part("_push", beta)).alias("loss"))
