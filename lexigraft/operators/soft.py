"""Soft label distributions over target concepts, their boost, and lookups into them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import cosine, hop_similarity
from .hierarchy import settled


def softmax_rows(rows: DataFrame, keys: list[str], score: str, temperature: float = C.TEMPERATURE) -> DataFrame:
    """Add prob: the softmax of a score within each key."""
    group = Window.partitionBy(*keys)
    power = F.exp((F.col(score) - F.max(score).over(group)) / F.lit(temperature))
    return rows.withColumn("_power", power).withColumn("prob", F.col("_power") / F.sum("_power").over(group)).drop("_power")


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


#: Vectors of a block at most, about; tiles to make if there are vectors enough.
BLOCK, TILES = 8_192, 64


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, id, similarity, rank): the k rows of most cosine for each query, itself left out; what is equal after rounding falls to the smaller id.

    Both are (id long, vector array<double>). Queries and rows are dealt into
    blocks, and each pair of blocks is a tile, one group of a task: so neither side
    goes through the driver, and a tile holds two blocks whatever the tables' sizes.
    A tile hands on k rows for each of its queries. Vectors are compared with those
    of their length; null and zero ones and those with a null or non-finite
    component are near nothing. No queries or no rows give no rows.
    """
    asked, against = (df.select(F.col("id").cast("long").alias("id"), "vector").filter("vector is not null") for df in (queries, rows))
    n_asked, n_against = asked.count(), against.count()
    across = max(1, -(-n_asked // BLOCK))
    down = max(1, -(-n_against // BLOCK), min(-(-TILES // across), n_against // 256))
    # rows are dealt in turn, whatever their ids; each goes to the tiles of its column or row
    turn = lambda n: F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(n)).cast("int")
    tiled = lambda df, own, other, of, to: df.withColumn(of, turn(own)).withColumn(to, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    left = tiled(asked, across, down, "i", "j").select("i", "j", "id", "vector")
    right = tiled(against, down, across, "j", "i").select(*(F.col(c).alias(f"{c}_") for c in ("i", "j", "id", "vector")))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        sizes = set(left["vector"].combine_chunks().value_lengths().to_pylist()) if left.num_rows and right.num_rows else ()
        right = right.rename_columns(left.column_names) if sizes else right
        for size in sizes:
            names, matrix = unit_table(left, size)
            others, vectors = unit_table(right, size)
            order = np.argsort(others)
            others, vectors = others[order], vectors[order]
            for lo in range(0, len(names) if len(others) else 0, 1024):
                near = np.round(matrix[lo : lo + 1024] @ vectors.T, 12)
                near[names[lo : lo + 1024, None] == others] = -np.inf
                first = np.argsort(-np.round(near, digits), axis=1, kind="stable")[:, :k]  # ids rise, so equal ones are in order
                found = np.take_along_axis(near, first, axis=1)
                real = np.isfinite(found)
                out.append((np.broadcast_to(names[lo : lo + 1024, None], found.shape)[real], others[first][real], found[real]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, float))]
        return pa.table(columns, names=["query", "id", "similarity"])

    found = left.groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInArrow(best, "query long, id long, similarity double")
    return top_k(found, ["query"], [F.desc(F.round("similarity", digits)), F.col("id")], k)


def unit_table(rows: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the rows of a length; those that have no direction are left out."""
    vectors = rows["vector"].combine_chunks()
    own = np.flatnonzero(vectors.value_lengths().to_numpy() == size)
    flat = vectors.take(pa.array(own)).flatten()
    with np.errstate(all="ignore"):
        matrix = unit_rows(flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1))
    good = np.isfinite(matrix).all(axis=1) & (size > 0)
    return rows["id"].to_numpy()[own][good], matrix[good]


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows become not-a-number."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def soft_map(codes: DataFrame, near: DataFrame, names: DataFrame, encode: Callable[[Column], Column], lin: DataFrame, temperature: float = C.TEMPERATURE) -> DataFrame:
    """Distributions of codes (code, primary) over the targets near their primary one (primary, target_id, hops): equal shares of name, hop and content similarity.

    names is (key, name) of codes and targets, encode a name's vector; lin is (a, b, lin).
    A name is encoded once and two names are compared once, however many codes and targets bear them.
    """
    spark = codes.sparkSession
    of = lambda key, name: names.select(F.col("key").alias(key), F.col("name").alias(name))
    targets = near.join(lin.select(F.col("a").alias("primary"), F.col("b").alias("target_id"), "lin"), ["primary", "target_id"], "left").join(of("target_id", "_other"), "target_id", "left")
    targets, codes = settled(targets), settled(codes.join(of("code", "_name"), "code", "left").select("code", "primary", "_name"))
    pairs = codes.select("_name", "primary").distinct().join(targets.select("primary", "_other").distinct(), "primary").select("_name", "_other").distinct()
    # few bytes, but much work: spread over all cores
    vectors = codes.select("_name").union(targets.select("_other")).filter("_name is not null").distinct().repartition(spark.sparkContext.defaultParallelism)
    vectors = settled(vectors.select("_name", encode(F.col("_name")).alias("_v")))
    pairs = pairs.join(vectors, "_name").join(vectors.select(F.col("_name").alias("_other"), F.col("_v").alias("_w")), "_other")
    alike = settled(pairs.repartition(spark.sparkContext.defaultParallelism).select("_name", "_other", cosine(F.col("_v"), F.col("_w")).alias("sim_string")))
    rows = codes.join(targets, "primary").join(alike, ["_name", "_other"], "left")
    scored = rows.select("code", "target_id", "hops", F.coalesce("sim_string", F.lit(0.0)).alias("sim_string"), hop_similarity(F.col("hops")).alias("sim_hop"), F.coalesce("lin", F.lit(0.0)).alias("sim_content"))
    scored = scored.withColumn("similarity", (F.col("sim_string") + F.col("sim_hop") + F.col("sim_content")) / F.lit(3.0))
    out = softmax_rows(scored, ["code"], "similarity", temperature)
    return out.withColumn("prob", F.bround("prob", 6))


def preferred_source_names(codes: DataFrame, atoms: DataFrame, sab: str = "MSH", kinds: tuple[str, ...] = ("MH", "PEP")) -> DataFrame:
    """(code, name) of codes (code, fallback): the first named atom of the kinds under the first of the code's cuis that has one.

    Atoms of a cui need not be of the code itself. Codes without such an atom keep their fallback.
    """
    own = atoms.filter(F.col("sab") == sab)
    cuis = own.join(codes.select("code"), "code").groupBy("code", "cui").agg(F.min("ord").alias("_place"))
    names = own.filter(F.col("tty").isin(*kinds) & (F.col("str") != "")).groupBy("cui").agg(F.min_by("str", "ord").alias("_name"))
    best = cuis.join(names, "cui").groupBy("code").agg(F.min_by("_name", "_place").alias("_name"))
    return codes.join(best, "code", "left").select("code", F.coalesce("_name", "fallback").alias("name"))


def candidate_lists(soft: DataFrame) -> DataFrame:
    """(code, candidates): each code's targets by falling probability; of equals the nearer, then the smaller id."""
    one = F.struct((-F.col("prob")).alias("_p"), "hops", "target_id", "prob")
    rows = soft.groupBy("code").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return rows.select("code", F.transform("c", lambda x: x.dropFields("_p")).alias("candidates"))


def soft_summary(soft: DataFrame) -> DataFrame:
    """One row: codes, candidates of a code (min, max, mean), the primary's probability and the mean of the codes' means."""
    per_code = soft.groupBy("code").agg(F.count("*").alias("n"), F.max(F.when(F.col("hops") == 0, F.col("prob"))).alias("primary"), F.avg("similarity").alias("mean"))
    return per_code.agg(F.count("*").alias("codes"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean_candidates"), F.min("primary").alias("primary_min"), F.max("primary").alias("primary_max"), F.avg("primary").alias("primary_mean"), F.avg("mean").alias("mean_of_means"))


def norm_targets(mentions: DataFrame, soft: DataFrame) -> DataFrame:
    """A distribution for each mention (mention, code, mapped_id, confidence): its code's, or all on its mapped target.

    Probabilities of one target are added, then each mention's are made to sum to 1; a mention without mass has no rows.
    """
    keep = ["code", "mapped_id", "confidence"]
    asked = mentions.groupBy("mention").agg(F.collect_list(F.struct(*keep)).alias("_m"))
    sums = soft.groupBy("code", "target_id").agg(F.sum("prob").alias("prob"))
    # a mention of one row has its code's distribution, which is made once for all its mentions
    totals = sums.groupBy("code").agg(F.sum("prob").alias("_total"), F.max(F.col("target_id").isNull()).alias("_open"))
    own = sums.join(totals, "code").filter("not _open").select("code", "target_id", (F.col("prob") / F.nullif(F.col("_total"), F.lit(0.0))).alias("prob"))
    one = asked.filter(F.size("_m") == 1).select("mention", F.get("_m", F.lit(0)).alias("_m")).select("mention", *(F.col(f"_m.{c}").alias(c) for c in keep))
    weight = F.coalesce("confidence", F.lit(1.0)).alias("weight")
    told = one.join(own, "code").select("mention", "target_id", "prob", weight)
    plain = one.join(totals.filter("not _open").select("code"), "code", "left_anti")
    # mentions of several rows, and codes with rows without a target, are added up for each mention
    several = asked.filter(F.size("_m") > 1).select("mention", F.explode("_m").alias("_m")).select("mention", *(F.col(f"_m.{c}").alias(c) for c in keep))
    found = plain.unionByName(several).join(soft.select("code", "target_id", "prob"), "code", "left")
    rows = found.select("mention", F.coalesce("target_id", "mapped_id").alias("target_id"), F.when(F.col("target_id").isNotNull(), F.col("prob")).otherwise(F.lit(1.0)).alias("prob"), F.coalesce("confidence", F.lit(1.0)).alias("weight"))
    rows = rows.filter("target_id is not null").groupBy("mention", "target_id").agg(F.sum("prob").alias("prob"), F.max("weight").alias("weight"))
    total = F.sum("prob").over(Window.partitionBy("mention"))
    rows = rows.withColumn("prob", F.col("prob") / F.nullif(total, F.lit(0.0)))
    return told.unionByName(rows).filter("prob is not null")


def votes(assignments: DataFrame) -> DataFrame:
    """Votes (code, target_id, votes) of solved documents' chosen concepts."""
    return assignments.filter("target_id is not null").groupBy("code", "target_id").agg(F.count("*").alias("votes"))


def boost(soft: DataFrame, counts: DataFrame, factor: float = C.BOOST, appended: float = C.APPENDED) -> DataFrame:
    """Lift each code's most voted target: doubled if it is there, else added, then all made to sum to 1.

    Of equal votes the smaller target id wins. Codes without a distribution stay out.
    """
    chosen = counts.groupBy("code").agg(F.min_by("target_id", F.struct(-F.col("votes"), F.col("target_id"))).alias("chosen"))
    chosen = chosen.join(soft.select("code").distinct(), "code", "left_semi")
    lifted = soft.join(chosen, "code", "left").withColumn("prob", F.when(F.col("target_id") == F.col("chosen"), F.col("prob") * factor).otherwise(F.col("prob")))
    new = chosen.join(soft.select("code", F.col("target_id").alias("chosen")), ["code", "chosen"], "left_anti")
    rows = lifted.select("code", "target_id", "prob").unionByName(new.select("code", F.col("chosen").alias("target_id"), F.lit(appended).alias("prob")))
    return rows.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy("code")))
