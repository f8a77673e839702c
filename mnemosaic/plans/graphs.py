"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.functions import text
from mnemosaic.operators import graph, search

from .registry import query
from .views import EDGES, MEM, NAME_GRAPH, graph_edges, memories, name_graph, table


def _nodes(e):  # noqa: ANN001, ANN202
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct().withColumn("type", F.substring("node", 1, 1))


@query("a13_graph_stats", f"WITH {EDGES} SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY relation")
def a13(spark, d):
    return graph_edges(spark, d).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("a14_g2_edge_weights", "WITH p AS (SELECT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT src, dst, 1 + 0.5::DOUBLE * (count(*) - 1) AS weight FROM p GROUP BY src, dst")
def a14(spark, d):
    p = table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return p.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg((1 + 0.5 * (F.count("*") - 1)).alias("weight"))


@query("a15_g1_mentions", "SELECT user_id AS name, count(*) AS mention_count, min(ts) AS created_at, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_type, round(arg_max(value, (ts, event_id)), 6)::DOUBLE AS last_value FROM events GROUP BY user_id")
def a15(spark, d):
    """Mentions of an entity: counted, with the first and last time; of its properties the latest stay."""
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("mention_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.max_by("event_type", at).alias("last_type"), F.round(F.max_by("value", at), 6).alias("last_value"))


@query("g2_relations", f"WITH {EDGES}, old AS (SELECT src, dst, relation, 1.0::DOUBLE AS weight FROM e WHERE relation <> 'based_in'), new AS (SELECT src, dst, relation FROM e WHERE relation <> 'part_of' UNION ALL SELECT src, 'x' || dst, 'near' FROM e WHERE relation = 'based_in'), c AS (SELECT src, dst, relation, 1 + 0.5 * (count(*) - 1) AS weight FROM new GROUP BY ALL) SELECT coalesce(c.src, old.src) AS src, coalesce(c.dst, old.dst) AS dst, coalesce(c.relation, old.relation) AS relation, (CASE WHEN old.src IS NULL THEN c.weight WHEN c.src IS NULL THEN old.weight ELSE old.weight + c.weight - 0.5 END)::DOUBLE AS weight FROM c FULL JOIN old ON c.src = old.src AND c.dst = old.dst AND c.relation = old.relation")
def g2(spark, d):
    e = graph_edges(spark, d)
    old = e.where("relation <> 'based_in'").withColumn("weight", F.lit(1.0))
    new = e.where("relation <> 'part_of'").unionByName(e.where("relation = 'based_in'").selectExpr("src", "concat('x', dst) AS dst", "'near' AS relation"))
    return graph.add_relations(_nodes(old).withColumnRenamed("node", "name"), old, new)[1]


@query("g2_missing_ends", f"WITH {EDGES}, old AS (SELECT src, dst FROM e WHERE relation <> 'based_in'), have AS (SELECT src AS name FROM old UNION SELECT dst FROM old), new AS (SELECT src AS name FROM e UNION SELECT dst FROM e UNION SELECT 'x' || dst FROM e WHERE relation = 'based_in') SELECT name, substr(name, 1, 1) AS type FROM have UNION ALL SELECT name, 'concept' FROM new WHERE name NOT IN (SELECT name FROM have)")
def g2_ends(spark, d):
    """Nodes after new relations: ends that weren't there are created."""
    e = graph_edges(spark, d)
    old = e.where("relation <> 'based_in'").withColumn("weight", F.lit(1.0))
    new = e.unionByName(e.where("relation = 'based_in'").selectExpr("src", "concat('x', dst) AS dst", "'near' AS relation"))
    return graph.add_relations(_nodes(old).withColumnRenamed("node", "name"), old, new)[0]


@query("g3_f19_f20_neighbors", f"WITH {EDGES} SELECT src, relation FROM e WHERE dst = 'n3' AND relation = 'lives_in' AND contains(lower(src), 'c1')")
def g3(spark, d):
    return graph_edges(spark, d).where("dst = 'n3' AND relation = 'lives_in'").where(F.contains(F.lower("src"), F.lit("c1"))).select("src", "relation")


@query("f20_by_type", f"WITH {EDGES}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n WHERE substr(node, 1, 1) = 'n' ORDER BY node LIMIT 10")
def f20(spark, d):
    """The first ten entities of a type, by name."""
    return _nodes(graph_edges(spark, d)).where("type = 'n'").orderBy("node").limit(10).select("node")


@query("g4_j6_network", f"WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b AS (SELECT 'n3' AS node, 0 AS depth UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.node WHERE b.depth < 3) SELECT node, min(depth)::INT AS depth FROM b GROUP BY node")
def g4(spark, d):
    return graph.network(graph_edges(spark, d), "n3", 3)


@query("g4_network_edges", f"WITH RECURSIVE {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), b AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT u.dst, b.depth + 1 FROM b JOIN u ON u.src = b.node WHERE b.depth < 2), s AS (SELECT DISTINCT node FROM b), q AS (SELECT 'c7' AS node, 0 AS depth UNION SELECT e.dst, q.depth + 1 FROM q JOIN e ON e.src = q.node WHERE q.depth < 2), dd AS (SELECT node, min(depth) AS depth FROM q GROUP BY node) SELECT e.src, e.dst, e.relation, coalesce(x.depth, 2)::INT AS src_depth, coalesce(y.depth, 2)::INT AS dst_depth FROM e LEFT JOIN dd x ON x.node = e.src LEFT JOIN dd y ON y.node = e.dst WHERE e.src IN (SELECT node FROM s) AND e.dst IN (SELECT node FROM s)")
def g4_edges(spark, d):
    """All edges among the nodes around an entity, with the depth that directed paths give their ends."""
    nodes, among = graph.network_edges(graph_edges(spark, d), "c7", 2)
    return among.join(nodes.toDF("src", "src_depth"), "src").join(nodes.toDF("dst", "dst_depth"), "dst").select("src", "dst", "relation", "src_depth", "dst_depth")


@query("g13_search_by_entity", f"WITH {EDGES}, s AS (SELECT 'n3' AS node UNION SELECT src FROM e WHERE dst = 'n3' UNION SELECT dst FROM e WHERE src = 'n3') SELECT src, dst, relation FROM e WHERE src IN (SELECT node FROM s) AND dst IN (SELECT node FROM s)")
def g13(spark, d):
    """What an entity is linked with, and the links among those."""
    return graph.network_edges(graph_edges(spark, d), "n3", 1)[1].select("src", "dst", "relation")


@query("g5_j7_paths", f"WITH {EDGES}, p AS (SELECT [a.src, a.dst] AS path FROM e a WHERE a.src = 'c7' AND a.dst LIKE 'r%' UNION ALL SELECT [a.src, a.dst, b.dst] FROM e a JOIN e b ON a.dst = b.src WHERE a.src = 'c7' AND b.dst LIKE 'r%') SELECT path, 1.0::DOUBLE / (len(path) - 1) AS score FROM p")
def g5(spark, d):
    e = graph_edges(spark, d)
    return graph.paths(e, "c7", e.where("src LIKE 'n%'").select(F.col("dst").alias("node")), 3)


@query("g6_u2_common_neighbors", "WITH e AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT dst FROM e WHERE src = 'c1' INTERSECT SELECT dst FROM e WHERE src = 'c4'")
def g6(spark, d):
    """Suppliers of two customers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    e = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.common_neighbors(e, "c1", "c4")


@query("g7_j8_j9_k9_infer", f"""WITH {EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS node FROM u), f AS (SELECT DISTINCT dst FROM u WHERE src = 'n3'),
s AS (SELECT DISTINCT u.dst FROM f JOIN u ON u.src = f.dst WHERE u.dst NOT IN (SELECT dst FROM f) AND u.dst <> 'n3'), t AS (SELECT DISTINCT u.dst FROM s JOIN u ON u.src = s.dst WHERE u.dst NOT IN (SELECT dst FROM f UNION ALL SELECT dst FROM s) AND u.dst <> 'n3'),
k AS (SELECT node AS dst FROM n WHERE substr(node, 1, 1) = 'n' AND node <> 'n3' AND node NOT IN (SELECT dst FROM f UNION ALL SELECT dst FROM s UNION ALL SELECT dst FROM t)),
a AS (SELECT * FROM (SELECT dst, 0.6::DOUBLE AS confidence FROM s ORDER BY dst LIMIT 5) UNION ALL SELECT * FROM (SELECT dst, 0.4 FROM t ORDER BY dst LIMIT 3) UNION ALL SELECT * FROM (SELECT dst, 0.3 FROM k ORDER BY dst LIMIT 5)) SELECT dst, confidence FROM a ORDER BY confidence DESC, dst LIMIT 10""")
def g7(spark, d):
    e = graph_edges(spark, d)
    return graph.infer(e, _nodes(e), "n3")


@query("g8_delete_entity", f"WITH {EDGES} SELECT relation, count(*) AS n FROM e WHERE src <> 'n3' AND dst <> 'n3' GROUP BY relation")
def g8(spark, d):
    return graph_edges(spark, d).where("src <> 'n3' AND dst <> 'n3'").groupBy("relation").agg(F.count("*").alias("n"))


@query("g9_j19_merge", f"WITH {EDGES}, a(old, new) AS (VALUES ('n3', 'n4'), ('n5', 'n4')) SELECT coalesce(s.new, e.src) AS src, coalesce(t.new, e.dst) AS dst, count(*) AS n FROM e LEFT JOIN a s ON e.src = s.old LEFT JOIN a t ON e.dst = t.old GROUP BY 1, 2")
def g9(spark, d):
    a = spark.createDataFrame([("n3", "n4"), ("n5", "n4")], "old string, new string")
    e = graph_edges(spark, d).join(a.toDF("src", "s"), "src", "left").join(a.toDF("dst", "t"), "dst", "left")
    return e.groupBy(F.coalesce("s", "src").alias("src"), F.coalesce("t", "dst").alias("dst")).agg(F.count("*").alias("n"))


@query("g9_merged_nodes", f"WITH {EDGES}, n AS (SELECT dst AS name, count(*) AS mention_count FROM e GROUP BY dst), a(old, new) AS (VALUES ('n3', 'n4'), ('n5', 'n4')) SELECT coalesce(new, name) AS name, sum(mention_count)::BIGINT AS mention_count, list_sort(coalesce(list(DISTINCT name) FILTER (new IS NOT NULL), [])) AS aliases FROM n LEFT JOIN a ON n.name = a.old GROUP BY 1")
def g9_nodes(spark, d):
    """Merged entities: their mentions are added, and the names they had are aliases."""
    n = graph_edges(spark, d).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("mention_count"))
    return graph.merge_entities(n, spark.createDataFrame([("n3", "n4"), ("n5", "n4")], "old string, new string"))


@query("g10_k11_disambiguate", "SELECT n_name AS name, CASE WHEN lower(n_name) = 'nation_1' THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence FROM nation WHERE lower(n_name) = 'nation_1' OR (length(n_name) > 2 AND contains(lower(n_name), 'nation_1'))")
def g10(spark, d):
    n = F.lower("n_name")
    score = F.when(n == "nation_1", 1.0).when((F.length(n) > 2) & F.contains(n, F.lit("nation_1")), 0.85)
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), score.alias("confidence")).where("confidence IS NOT NULL")


@query("g11_j5_equivalence", """WITH RECURSIVE nm AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation), p AS (SELECT x.id AS a, y.id AS b FROM nm x JOIN nm y ON x.id < y.id AND (x.name = y.name OR (length(x.name) > 2 AND length(y.name) > 2 AND (contains(x.name, y.name) OR contains(y.name, x.name))))),
u AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node) SELECT node, min(root) AS root FROM r GROUP BY node""")
def g11(spark, d):
    """Entities whose names are alike, and what follows from that: names that are equal or lie within one another."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    return graph.equivalence(graph.alike(n))


@query("g12_j10_suggest", f"""WITH {MEM}, {NAME_GRAPH}, gn AS (SELECT src AS name FROM ge UNION SELECT dst FROM ge), gm AS (SELECT name, id FROM gn JOIN mem ON contains(lower(content), name)),
kn AS (SELECT src AS a, dst AS b FROM ge UNION SELECT dst, src FROM ge) SELECT x.name AS a, y.name AS b, count(*) AS together FROM gm x JOIN gm y ON x.id = y.id AND x.name < y.name WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.a = x.name AND kn.b = y.name) GROUP BY 1, 2""")
def g12(spark, d):
    """Names that memories mention together and no edge links yet."""
    edges = name_graph(spark, d)
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return graph.suggested(search.mentions(memories(spark, d), names).select("name", "id"), edges)


_FOUND = "f AS (SELECT conv_id, turn, unnest(list_filter([" + ", ".join(f"'{w}'" for w in text.TECH) + "], lambda w: contains(lower(text), lower(w)))) AS name FROM conversations)"


@query("g14_populate", f"WITH {_FOUND} SELECT name, 'technology' AS type, count(*) AS mention_count FROM f GROUP BY name")
def g14(spark, d):
    """The graph of all messages: entities that the rules find, with their mentions."""
    found = table(spark, d, "conversations").select(F.explode(text.graph_entities(F.col("text"))).alias("x")).select("x.*")
    return graph.populated(found)[0]


FILES = [("a.md", "2024-01-01", "❌ [ write report ]\n偏好：深色主题\n✅ call"), ("b.md", "2024-01-05", "✅ write report\n偏好: 深色主题\nnothing"), ("c.md", "2024-01-05", "❌ call mother\n偏好：浅色"), ("d.md", "2024-01-09", "✅ [call]\n偏好：浅色")]


@query("g15_a30_contradictions", "SELECT * FROM (VALUES ('task_status', 'write report', ['2024-01-01', '2024-01-05']), ('preference', '深色主题', ['2024-01-01', '2024-01-05']), ('preference', '浅色', ['2024-01-05', '2024-01-09'])) AS t(kind, entity, dates)")
def g15(spark, d):
    """Tasks that are open in one note and done in another, and preferences under several dates; the expected rows are written by hand."""
    return graph.contradictions(spark.createDataFrame(FILES, "path string, date string, content string"))
