"""Graph queries: nations, customers and orders as links; orders and parts as calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph as gr
from weftline.plans import query
from weftline.staging import table

LINKS_SQL = """(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'in' AS rel FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'has' FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'has' FROM customer)"""


def links(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    edge = lambda df, a, b, rel: df.select(a.alias("src"), b.alias("dst"), F.lit(rel).alias("rel"))
    return edge(n, name("n", "n_nationkey"), name("r", "n_regionkey"), "in").unionByName(edge(n, name("r", "n_regionkey"), name("n", "n_nationkey"), "has")).unionByName(edge(c, name("n", "c_nationkey"), name("c", "c_custkey"), "has"))


@query(
    "link_bfs_nodes_edges",
    f"""WITH RECURSIVE walk(id, d) AS (SELECT 'n3', 0 UNION SELECT l.dst, d + 1 FROM walk JOIN {LINKS_SQL} l ON l.src = walk.id WHERE d < 3), first AS (SELECT id, min(d) AS depth FROM walk GROUP BY id)
SELECT 'node' AS what, id AS a, NULL AS b, depth FROM first UNION ALL SELECT 'edge', l.src, l.dst, NULL FROM {LINKS_SQL} l JOIN first f ON l.src = f.id AND f.depth < 3""",
)
def link_bfs_nodes_edges(spark, sf_dir):
    nodes, edges = gr.link_bfs(links(spark, sf_dir), "n3", 3)
    none = F.lit(None)
    return nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), none.cast("string").alias("b"), "depth").unionByName(edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), none.cast("int").alias("depth")))


CALLS_SQL = "(SELECT 'o' || l_orderkey AS caller, 'o' || l_partkey AS callee FROM lineitem)"


@query(
    "bfs_depth_capped",
    f"""WITH e AS (SELECT caller, callee, count(*) AS paths FROM {CALLS_SQL} GROUP BY ALL), l1 AS (SELECT *, 1 AS depth FROM e WHERE caller = 'o5'),
s2 AS (SELECT DISTINCT callee AS n FROM l1 WHERE callee != 'o5'), l2 AS (SELECT e.*, 2 AS depth FROM e WHERE caller IN (SELECT n FROM s2)),
s3 AS (SELECT DISTINCT callee AS n FROM l2 WHERE callee != 'o5' AND callee NOT IN (SELECT n FROM s2)), l3 AS (SELECT e.*, 3 AS depth FROM e WHERE caller IN (SELECT n FROM s3))
SELECT * FROM l1 UNION ALL SELECT * FROM l2 WHERE (SELECT count(*) FROM l1) + (SELECT count(*) FROM l2) <= 500
UNION ALL SELECT * FROM l3 WHERE (SELECT count(*) FROM l1) + (SELECT count(*) FROM l2) + (SELECT count(*) FROM l3) <= 500""",
)
def bfs_depth_capped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    name = lambda c: F.concat(F.lit("o"), F.col(c).cast("string"))
    return gr.call_bfs(li.select(name("l_orderkey").alias("caller"), name("l_partkey").alias("callee")), "o5", depth=3, max_edges=500)[0]


@query("neighbourhood", f"SELECT DISTINCT dst AS id, 'out' AS direction FROM {LINKS_SQL} WHERE src = 'n7' UNION SELECT DISTINCT src, 'in' FROM {LINKS_SQL} WHERE dst = 'n7'")
def neighbourhood(spark, sf_dir):
    return gr.neighbours(links(spark, sf_dir), "n7")


@query("unique_symbol_match", "SELECT 'ambiguous' AS verdict, NULL AS name_path UNION ALL SELECT 'ok', (SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3) UNION ALL SELECT 'missing', NULL")
def unique_symbol_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = n.select(F.concat_ws("/", "r_name", "n_name").alias("name_path")).unionByName(n.select(F.concat_ws("/", "r_name", F.lit("main")).alias("name_path")))
    third = n.where("n_nationkey = 3").select("n_name").first()[0]
    return gr.unique_match(s, "main").unionByName(gr.unique_match(s, third)).unionByName(gr.unique_match(s, "nowhere"))
