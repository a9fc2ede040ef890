"""The is-a graph: nodes and edges, depth, closure, membership, neighbourhoods and information content.

Closures grow from the ids that are asked for, one hop a round; a round joins
only the pairs that the round before has added, so paths are never enumerated.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a plain local session without one gets a temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigraft-"))
        where = context.getCheckpointDir().get()
    return where.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Cut a loop's lineage by a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task at most, about, where a table's rows meet others.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a table of so many rows by its keys into as many tasks as its size asks for, so that a task's memory doesn't grow with it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), *keys)


def edges(relationships: DataFrame, is_a: str = C.IS_A) -> DataFrame:
    """Distinct (child, parent, ord) of active is-a relationships (source_id, destination_id, type_id, active, ord)."""
    rows = relationships.filter((F.col("active") == "1") & (F.col("type_id") == is_a))
    return rows.groupBy(F.col("source_id").alias("child"), F.col("destination_id").alias("parent")).agg(F.min("ord").alias("ord"))


def nodes(concepts: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Active concepts and every end of an edge, which may be inactive."""
    return concepts.filter(F.col("active") == "1").select("id").union(edge_rows.select("child")).union(edge_rows.select("parent")).distinct()


#: Rounds whose tables are then written as one.
ROUNDS = 16


def closure(edge_rows: DataFrame, seeds: DataFrame, up: bool = True, max_hops: int | None = None) -> DataFrame:
    """(start, reached, hops) for every node that a seed (id) reaches, itself excluded, hops being the fewest.

    up follows child to parent. Rounds go on until nothing new is reached; with
    max_hops a node further away than that raises. A start that reaches itself
    lies on a cycle and raises.
    """
    step = edge_rows.select(F.col("child" if up else "parent").alias("at"), F.col("parent" if up else "child").alias("reached"))
    step = settled(step.distinct())
    front = settled(seeds.select(F.col("id").alias("start")).distinct().join(step, F.col("start") == F.col("at")).select("start", "reached", F.lit(1).alias("hops")))
    found, hop = front, 1
    while not front.isEmpty():
        if max_hops is not None and hop > max_hops:
            raise ValueError(f"nodes more than {max_hops} hops away")
        hop += 1
        if hop % ROUNDS == 0:
            found = settled(found)
        near = front.select("start", F.col("reached").alias("at")).join(step, "at").select("start", "reached").distinct()
        front = settled(near.join(found.select("start", "reached"), ["start", "reached"], "left_anti").withColumn("hops", F.lit(hop)))
        found = found.unionByName(front)
    if not found.filter("start = reached").isEmpty():
        raise ValueError("the hierarchy has a cycle")
    return found


def cycle_nodes(edge_rows: DataFrame) -> DataFrame:
    """Nodes on or between cycles: those left when leaves and roots are peeled off again and again."""
    left = settled(edge_rows.select("child", "parent").distinct())
    while True:
        inner = left.join(left.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").join(left.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi")
        inner = settled(inner.select("child", "parent"))
        if inner.count() == left.count():
            return inner.select(F.col("child").alias("id")).distinct()
        left = inner


def layers(edge_rows: DataFrame) -> DataFrame:
    """(id, layer): the longest way down from a node without parents; nodes on or under a cycle are absent.

    A node comes off once all its parents have; a round touches the children of
    the round before and the nodes that still wait for a parent.
    """
    # joined by sorting: sent whole, a table of each round would go through the driver
    steps = settled(edge_rows.select("child", "parent").distinct())
    needs = settled(steps.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("need")))
    front = steps.select(F.col("parent").alias("id")).distinct().hint("merge").join(needs, "id", "left_anti").select("id", F.lit(0).alias("layer"))
    front, waiting, layer = settled(front), None, 0
    out = front
    while not front.isEmpty():
        layer += 1
        got = steps.hint("merge").join(front.select(F.col("id").alias("parent")), "parent").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("got"))
        got = got if waiting is None else got.union(waiting).groupBy("id").agg(F.sum("got").alias("got"))
        counted = settled(got.hint("merge").join(needs, "id"))
        front, waiting = counted.filter("got = need").select("id", F.lit(layer).alias("layer")), counted.filter("got < need").select("id", "got")
        out = settled(out.union(front)) if layer % ROUNDS == 0 else out.union(front)
    return out


def depths(edge_rows: DataFrame, root: str = C.ROOT) -> DataFrame:
    """(id, depth): the fewest is-a steps from the root; what it doesn't reach is absent."""
    spark = edge_rows.sparkSession
    seed = spark.range(1).select(F.lit(root).cast(edge_rows.schema["child"].dataType).alias("id"))
    below = closure(edge_rows, seed, up=False)
    return seed.select("id", F.lit(0).alias("depth")).union(below.select("reached", "hops"))


def memberships(edge_rows: DataFrame, root: str = C.ROOT) -> DataFrame:
    """(id, tops, semantic_type): the root's children above or at a node, sorted, and the first of them."""
    tops = edge_rows.filter(F.col("parent") == root).select(F.col("child").alias("id")).distinct()
    below = closure(edge_rows, tops, up=False).select(F.col("start").alias("top"), F.col("reached").alias("id"))
    both = below.union(tops.select(F.col("id").alias("top"), "id"))
    out = both.groupBy("id").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    return out.withColumn("semantic_type", F.array_min("tops"))


def is_descendant(pairs: DataFrame, above: DataFrame) -> DataFrame:
    """Pairs (id, of) with below: whether id lies under `of`, by closure rows above (start, reached); nothing lies under itself."""
    hits = above.select(F.col("start").alias("id"), F.col("reached").alias("of")).distinct().withColumn("_hit", F.lit(True))
    return pairs.join(hits, ["id", "of"], "left").select("id", "of", F.coalesce("_hit", F.lit(False)).alias("below"))


def describe(ids: DataFrame, depth_rows: DataFrame, tops: DataFrame) -> DataFrame:
    """(id, depth, tops) of each id asked for; one that the graph doesn't hold has no depth and no tops."""
    kind = tops.schema["tops"].dataType.simpleString()
    found = ids.select("id").distinct().join(depth_rows, "id", "left").join(tops.select("id", "tops"), "id", "left")
    return found.select("id", "depth", F.coalesce("tops", F.array().cast(kind)).alias("tops"))


def descendant_counts(edge_rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, descendants) of each anchor; one that has none counts 0."""
    below = closure(edge_rows, anchors, up=False).groupBy(F.col("start").alias("id")).agg(F.count("*").alias("descendants"))
    return anchors.select("id").distinct().join(below, "id", "left").select("id", F.coalesce("descendants", F.lit(0)).alias("descendants"))


def information_content(descendants: DataFrame, size: int) -> DataFrame:
    """(id, ic) = -log2((descendants + 1) / size)."""
    return descendants.select("id", (-F.log2((F.col("descendants") + 1) / F.lit(size))).alias("ic"))


def lin_similarity(pairs: DataFrame, ancestors: DataFrame, ic: DataFrame) -> DataFrame:
    """lin of pairs (a, b): twice the greatest content of a common ancestor over the sum of both.

    ancestors (start, reached) excludes the start itself, which counts as its own
    ancestor here. An ancestor without a row in ic counts 0. Equal ids give 1; no
    common ancestor or no content gives 0.
    """
    own = ancestors.select("start", "reached").union(ic.select("id", "id"))
    own = own.join(ic.select(F.col("id").alias("reached"), "ic"), "reached", "left").select("start", "reached", F.coalesce("ic", F.lit(0.0)).alias("ic"))
    # a node's ancestors by falling content, so the first that two nodes share is the one that counts
    sets = own.groupBy("start").agg(F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("_o"), "reached", "ic"))).alias("s")).join(ic.select(F.col("id").alias("start"), "ic"), "start", "left")
    sets = settled(sets.select("start", F.col("s.reached").alias("ids"), F.col("s.ic").alias("ics"), F.coalesce("ic", F.lit(0.0)).alias("ic")))
    of = lambda s: sets.select(F.col("start").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "ics", "ic")))
    pairs = settled(pairs)
    count = pairs.count()
    out = spread(spread(pairs, count, "a").join(of("a"), "a", "left"), count, "b").join(of("b").drop("ics_b"), "b", "left")
    first = F.get(F.array_intersect("ids_a", "ids_b"), F.lit(0))
    out = out.select("a", "b", "ic_a", "ic_b", F.get("ics_a", F.array_position("ids_a", first).cast("int") - 1).alias("top"))
    total = F.coalesce("ic_a", F.lit(0.0)) + F.coalesce("ic_b", F.lit(0.0))
    value = F.when(F.col("a") == F.col("b"), F.lit(1.0)).when(F.col("top").isNull() | (total <= 0), F.lit(0.0)).otherwise(2 * F.col("top") / total)
    return out.select("a", "b", value.alias("lin"))


def neighbourhood(edge_rows: DataFrame, seeds: DataFrame, cap: int = C.NEIGHBOURS) -> DataFrame:
    """(start, id, hops, rank): a seed, its parents, grandparents, children, grandchildren and siblings, first `cap` of them.

    edges carry ord; the order is the ring, then the ords along the way, then the id.
    Of a node's children only the first `cap` are followed: whatever of these stands
    in an earlier ring takes a place there, so later children never come in.
    """
    few = edge_rows.withColumn("_place", F.row_number().over(Window.partitionBy("parent").orderBy("ord", "child"))).filter(F.col("_place") <= cap)
    up = edge_rows.select(F.col("child").alias("at"), F.col("parent").alias("next"), "ord")
    down = few.select(F.col("parent").alias("at"), F.col("child").alias("next"), "ord")
    none = F.lit(None).cast(edge_rows.schema["ord"].dataType)
    self_ = seeds.select(F.col("id").alias("start"), F.col("id").alias("id"), F.lit(0).alias("hops"), F.lit(0).alias("ring"), none.alias("o1"), none.alias("o2"))

    def one(step: DataFrame, ring: int) -> DataFrame:
        return seeds.select(F.col("id").alias("start")).join(step, F.col("start") == F.col("at")).select("start", F.col("next").alias("id"), F.lit(1).alias("hops"), F.lit(ring).alias("ring"), F.col("ord").alias("o1"), none.alias("o2"))

    def two(base: DataFrame, step: DataFrame, ring: int) -> DataFrame:
        return base.join(step, F.col("id") == F.col("at")).select("start", F.col("next").alias("id"), F.lit(2).alias("hops"), F.lit(ring).alias("ring"), "o1", F.col("ord").alias("o2"))

    parents, children = one(up, 1), one(down, 3)
    rows = self_.unionByName(parents).unionByName(two(parents, up, 2)).unionByName(children).unionByName(two(children, down, 4)).unionByName(two(parents, down, 5))
    order = [F.col("ring"), F.col("o1"), F.col("o2"), F.col("id")]
    first = rows.withColumn("_first", F.row_number().over(Window.partitionBy("start", "id").orderBy(*order))).filter("_first = 1")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("start").orderBy(*order))).filter(F.col("rank") <= cap).select("start", "id", "hops", "rank")


def graph_stats(edge_rows: DataFrame, node_rows: DataFrame, depth_rows: DataFrame, tops: DataFrame) -> DataFrame:
    """One row: nodes, edges, depth, and nodes under several tops."""
    return (
        node_rows.agg(F.count("*").alias("nodes"))
        .crossJoin(edge_rows.agg(F.count("*").alias("edges")))
        .crossJoin(depth_rows.agg(F.max("depth").alias("max_depth")))
        .crossJoin(tops.agg(F.count_if(F.size("tops") > 1).alias("multi_inherit")))
    )
