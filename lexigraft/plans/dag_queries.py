"""The hierarchy on a growing graph with several parents, diamonds, several tops and, for the cycle report, planted cycles.

A part lies under its number divided by 2, 3 or 4, as its lines' suppliers say; 0 is
the root, and numbers only fall on the way up. Backward edges of some parts make cycles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources.documents import cached_tables
from .base import query, table

DAG = "dag AS (SELECT l_partkey AS child, l_partkey // (2 + l_suppkey % 3) AS parent, min(l_suppkey) AS ord FROM lineitem WHERE l_partkey > 0 GROUP BY ALL)"
UP = "up(start, reached, hops) AS (SELECT child, parent, 1 FROM dag UNION SELECT start, parent, hops + 1 FROM up JOIN dag ON child = reached)"
WITH = f"WITH RECURSIVE {DAG}, {UP}"


def dag(spark: SparkSession, sf: str) -> DataFrame:
    parent = F.expr("l_partkey div (2 + l_suppkey % 3)")
    return table(spark, sf, "lineitem").filter("l_partkey > 0").groupBy(F.col("l_partkey").alias("child"), parent.alias("parent")).agg(F.min("l_suppkey").alias("ord"))


def parts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("child").alias("id")).distinct()


@query(WITH + " SELECT start, reached, min(hops) AS hops FROM up GROUP BY ALL")
def q68_dag_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    """Ancestors of every part over all ways; of several ways the shortest counts."""
    rows = H.settled(dag(spark, sf))
    return H.closure(rows, parts(rows))


@query(WITH + " SELECT reached AS id, count(DISTINCT start) AS descendants FROM up GROUP BY 1")
def q68b_dag_descendants(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.settled(dag(spark, sf))
    return H.descendant_counts(rows, rows.select(F.col("parent").alias("id")).distinct())


@query(WITH + """, ids AS (SELECT child AS id FROM dag UNION SELECT parent FROM dag)
SELECT id, CAST(coalesce(max(hops), 0) AS INTEGER) AS layer FROM ids LEFT JOIN up ON start = id GROUP BY id""")
def q68c_dag_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Topological layers: the longest way down to each part."""
    return H.layers(dag(spark, sf))


@query(WITH + """, tops AS (SELECT child AS top FROM dag WHERE parent = 0),
m AS (SELECT start AS id, reached AS top FROM up WHERE reached IN (SELECT top FROM tops) UNION SELECT top, top FROM tops)
SELECT id, string_agg(CAST(top AS VARCHAR), ',' ORDER BY top) AS tops, min(top) AS semantic_type FROM m GROUP BY id""")
def q68d_dag_tops(spark: SparkSession, sf: str) -> DataFrame:
    """The tops over each part, of which many have several."""
    found = H.memberships(H.settled(dag(spark, sf)), 0)
    return found.select("id", F.array_join(F.transform("tops", lambda t: t.cast("string")), ",").alias("tops"), "semantic_type")


@query(WITH + """, ids AS (SELECT child AS id FROM dag UNION SELECT parent FROM dag), tops AS (SELECT child AS top FROM dag WHERE parent = 0),
m AS (SELECT start AS id, reached AS top FROM up WHERE reached IN (SELECT top FROM tops) UNION SELECT top, top FROM tops)
SELECT (SELECT count(*) FROM ids) AS nodes, (SELECT count(*) FROM dag) AS edges, (SELECT max(d) FROM (SELECT min(hops) AS d FROM up WHERE reached = 0 GROUP BY start)) AS max_depth,
(SELECT count(*) FROM (SELECT id FROM m GROUP BY id HAVING count(*) > 1)) AS multi_inherit""")
def q68e_dag_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = H.settled(dag(spark, sf))
    ids = H.nodes(rows.select(F.col("child").alias("id"), F.lit("1").alias("active")), rows)
    return H.graph_stats(rows, ids, H.depths(rows, 0), H.memberships(rows, 0))


@query(f"""WITH RECURSIVE {DAG}, e AS (SELECT child, parent FROM dag UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 97 = 5),
r(start, reached) AS (SELECT child, parent FROM e UNION SELECT start, parent FROM r JOIN e ON child = reached),
c AS (SELECT start AS id FROM r WHERE start = reached)
SELECT id FROM c UNION (SELECT reached FROM r JOIN c ON id = start INTERSECT SELECT start FROM r JOIN c ON id = reached)""")
def q68f_dag_cycles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts on or between cycles, which edges back from a half make."""
    back = table(spark, sf, "part").filter("p_partkey % 97 = 5").select(F.expr("p_partkey div 2").alias("child"), F.col("p_partkey").alias("parent"))
    return H.cycle_nodes(dag(spark, sf).select("child", "parent").union(back))


@query(f"""WITH {DAG}, s AS (SELECT DISTINCT child AS start FROM dag),
r AS (SELECT start, start AS id, 0 AS hops, 0 AS ring, 0 AS o1, 0 AS o2 FROM s
  UNION ALL SELECT child, parent, 1, 1, ord, 0 FROM dag
  UNION ALL SELECT a.child, b.parent, 2, 2, a.ord, b.ord FROM dag a JOIN dag b ON b.child = a.parent
  UNION ALL SELECT parent, child, 1, 3, ord, 0 FROM dag JOIN s ON start = parent
  UNION ALL SELECT a.parent, b.child, 2, 4, a.ord, b.ord FROM dag a JOIN s ON start = a.parent JOIN dag b ON b.parent = a.child
  UNION ALL SELECT a.child, b.child, 2, 5, a.ord, b.ord FROM dag a JOIN dag b ON b.parent = a.parent),
f AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY ring, o1, o2) AS first FROM r),
k AS (SELECT start, id, hops, row_number() OVER (PARTITION BY start ORDER BY ring, o1, o2, id) AS rank FROM f WHERE first = 1)
SELECT start, id, hops, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 30""")
def q68g_dag_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbourhood of every part: parents, grandparents, children, grandchildren and siblings, the first 30."""
    rows = H.settled(dag(spark, sf))
    return H.neighbourhood(rows, parts(rows)).select("start", "id", "hops", F.col("rank").cast("int").alias("rank"))


@query(WITH + """, p AS (SELECT DISTINCT l_partkey AS id, l_suppkey % 40 AS "of" FROM lineitem), u AS (SELECT DISTINCT start, reached FROM up)
SELECT id, "of", reached IS NOT NULL AS below FROM p LEFT JOIN u ON start = id AND reached = "of\"""")
def q68h_dag_below(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each line's part lies under a small number."""
    rows = H.settled(dag(spark, sf))
    pairs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 40).alias("of")).distinct()
    below = H.closure(rows, pairs.select(F.col("of").alias("id")).distinct(), up=False)  # from the few numbers asked for, not from every part
    return H.is_descendant(pairs, below.select(F.col("reached").alias("start"), F.col("start").alias("reached")))


@query(WITH + """, tops AS (SELECT child AS top FROM dag WHERE parent = 0), a AS (SELECT p_partkey AS id FROM part UNION SELECT p_partkey + 1000000000 FROM part WHERE p_size = 1),
d AS (SELECT start AS id, min(hops) AS depth FROM up WHERE reached = 0 GROUP BY 1 UNION ALL SELECT 0, 0),
m AS (SELECT start AS id, reached AS top FROM up WHERE reached IN (SELECT top FROM tops) UNION SELECT top, top FROM tops), t AS (SELECT id, string_agg(CAST(top AS VARCHAR), ',' ORDER BY top) AS tops FROM m GROUP BY id)
SELECT id, CAST(depth AS INTEGER) AS depth, coalesce(tops, '') AS tops FROM a LEFT JOIN d USING (id) LEFT JOIN t USING (id)""")
def q68i_dag_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Depth and tops of the parts asked for, of which some aren't in the graph; both tables come from a cache by its input's files."""
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf, "part").filter("p_size = 1").select(F.col("p_partkey") + 1000000000))
    path, inputs = f"{H.shared_folder(spark)}/hierarchy-{uuid.uuid4().hex}", [f"{sf}/lineitem.parquet"]

    def build() -> dict[str, DataFrame]:
        rows = H.settled(dag(spark, sf))
        return {"depths": H.depths(rows, 0), "tops": H.memberships(rows, 0)}

    cached_tables(spark, path, inputs, build, ("depths", "tops"))
    found = cached_tables(spark, path, inputs, dict, ("depths", "tops"))  # read, not built
    out = H.describe(asked, found["depths"], found["tops"])
    return out.select("id", "depth", F.array_join(F.transform("tops", lambda t: t.cast("string")), ",").alias("tops"))
