"""Entity graph as two tables; traversals are bounded loops of joins, with lineage cut in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemosaic.sources.io import shared_dir, staging


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that the cluster shares; a local master gets a folder of its own where none is set."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def network(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """node, depth: nodes within `depth` undirected hops of start."""
    both = undirected(edges).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int")
    front = seen
    for d in range(1, depth + 1):
        nxt = both.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def network_edges(edges: DataFrame, start: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` undirected hops with their directed depth (`depth` where no directed path leads there), and all edges among them."""
    seen = network(edges, start, depth).select("node")
    steps = edges.select("src", "dst").distinct()
    reached = edges.sparkSession.createDataFrame([(start, 0)], "node string, steps int")
    front = reached
    for d in range(1, depth + 1):
        nxt = steps.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut(nxt.join(reached, "node", "left_anti").withColumn("steps", F.lit(d)))
        reached = reached.unionByName(front)
    nodes = seen.join(reached, "node", "left").select("node", F.coalesce("steps", F.lit(depth)).alias("depth"))
    among = edges.join(seen.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, among


def paths(edges: DataFrame, start: str, ends: DataFrame, max_depth: int) -> DataFrame:
    """path (array), score 1 / length: simple directed paths to the nodes (node) of ends, all ends at once; a path goes on past an end."""
    step = edges.select("src", "dst").distinct()
    now = step.where(F.col("src") == start).select(F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    every = now
    for _ in range(max_depth - 1):
        now = now.join(step, F.col("last") == step.src).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last"))
        every = every.unionByName(now)
    return every.join(ends.select(F.col("node").alias("last")).distinct(), "last", "left_semi").select("path", (1.0 / (F.size("path") - 1)).alias("score"))


def add_relations(nodes: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (name, type) and edges (src, dst, relation, weight) after new rows (src, dst, relation): a repeated relation weighs .5 more, and missing ends become concepts."""
    counted = new.groupBy("src", "dst", "relation").agg((1 + 0.5 * (F.count("*") - 1)).alias("weight"))
    old = edges.select("src", "dst", "relation", F.col("weight").alias("old"))
    both = counted.join(old, ["src", "dst", "relation"], "full").select("src", "dst", "relation", F.when(F.col("old").isNull(), F.col("weight")).when(F.col("weight").isNull(), F.col("old")).otherwise(F.col("old") + F.col("weight") - 0.5).alias("weight"))
    ends = new.select(F.col("src").alias("name")).unionByName(new.select(F.col("dst").alias("name"))).distinct()
    missing = ends.join(nodes.select("name"), "name", "left_anti").withColumn("type", F.lit("concept"))
    return nodes.select("name", "type").unionByName(missing), both


def merge_entities(nodes: DataFrame, into: DataFrame) -> DataFrame:
    """nodes (name, mention_count) after merging (old, new): counts are added, and the merged names become aliases."""
    named = nodes.join(into, nodes.name == into.old, "left").withColumn("target", F.coalesce("new", "name"))
    alias = F.when(F.col("new").isNotNull(), F.col("name"))
    return named.groupBy(F.col("target").alias("name")).agg(F.sum("mention_count").alias("mention_count"), F.array_sort(F.collect_set(alias)).alias("aliases"))


def populated(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, type, mention_count) and edges (src, dst, relation, weight) of extracted rows (id, relation, type, subject, entity): an entity's first type by name stays."""
    nodes = found.groupBy(F.col("entity").alias("name")).agg(F.min("type").alias("type"), F.count("*").alias("mention_count"))
    subject = found.where("subject IS NOT NULL").groupBy(F.col("subject").alias("src"), F.col("entity").alias("dst"), "relation").agg((1 + 0.5 * (F.count("*") - 1)).alias("weight"))
    return nodes, subject


def suggested(mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, together: names (name, id) that stand in the same memories and have no edge in either direction. A memory names few."""
    pairs = mentions.alias("x").join(mentions.alias("y"), "id").where(F.col("x.name") < F.col("y.name")).groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count("*").alias("together"))
    known = undirected(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def common_neighbors(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col("src") == a).select("dst").intersect(edges.where(F.col("src") == b).select("dst"))


def infer(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    """dst, confidence: second degree .6 (5 at most), third .4 (3), same type without a link .3 (5); the best 10."""
    near = undirected(edges).distinct()
    first = near.where(F.col("src") == start).select("dst").distinct()
    hop = lambda df: df.select(F.col("dst").alias("src")).join(near, "src").select("dst").distinct()
    not_in = lambda df, *others: [df := df.join(o, "dst", "left_anti") for o in others][-1].where(F.col("dst") != start)
    second = not_in(hop(first), first)
    third = not_in(hop(second), first, second)
    kind = nodes.where(F.col("node") == start).select("type")
    alike = not_in(nodes.join(kind, "type").select(F.col("node").alias("dst")), first, second, third)
    some = lambda df, c, n: df.orderBy("dst").limit(n).withColumn("confidence", F.lit(c))
    return some(second, 0.6, 5).unionByName(some(third, 0.4, 3)).unionByName(some(alike, 0.3, 5)).orderBy(F.desc("confidence"), "dst").limit(10)


def alike(names: DataFrame) -> DataFrame:
    """a, b of entities (id, name) whose names are equal, or of which one, longer than two characters, lies within another. Names meet in their parts of three characters, not all with all."""
    low = names.where("length(name) > 2")
    parts = low.select("id", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3))))).alias("part"))
    first = low.select(F.col("id").alias("a"), F.col("name").alias("short"), F.substring("name", 1, 3).alias("part"))
    within = first.join(parts, "part").where((F.col("a") != F.col("id")) & F.contains("name", F.col("short"))).select("a", F.col("id").alias("b"))
    equal = names.alias("x").join(names.alias("y"), "name").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return within.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def equivalence(pairs: DataFrame) -> DataFrame:
    """node, root: classes of linked nodes, by smallest labels. Labels jump to their label's label in each round, so chains settle in few rounds, however long."""
    ends = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = cut(undirected(ends).distinct())
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("low"))
        low = cut(labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root")))
        # The root of a label takes the least label that any of its nodes saw, then every label follows its root.
        hook = low.groupBy(F.col("was").alias("root")).agg(F.min("root").alias("to"))
        hooked = low.join(hook.select(F.col("root").alias("was"), "to"), "was").select("node", "was", F.least("root", "to").alias("root"))
        jump = hooked.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = cut(hooked.join(jump, hooked.root == jump["at"]).select("node", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("was")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def contradictions(files: DataFrame) -> DataFrame:
    """kind, entity, dates of files (path, date, content): a task that is marked done in one file and open in another, and a preference under two dates."""
    lines = files.select("path", "date", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^.*(?:[❌✅]|偏好[：:]).*$"), F.lit(0))).alias("line"))
    task = F.trim(F.regexp_replace(F.regexp_extract("line", r"[❌✅]\s*\[?\s*([^\]\n]+)", 1), r"\s+$", ""))
    tasks = lines.withColumn("entity", task).where("entity <> ''").groupBy("entity")
    tasks = tasks.agg(F.countDistinct("path").alias("n"), F.bool_or(F.col("line").contains("❌")).alias("open"), F.bool_or(F.col("line").contains("✅")).alias("done"), F.array_sort(F.collect_set("date")).alias("dates"))
    wishes = lines.withColumn("entity", F.substring(F.trim(F.regexp_extract("line", r"偏好[：:]\s*(.+)", 1)), 1, 30)).where("entity <> ''").groupBy("entity").agg(F.array_sort(F.collect_set("date")).alias("dates"))
    return tasks.where("n > 1 AND open AND done").select(F.lit("task_status").alias("kind"), "entity", "dates").unionByName(wishes.where("size(dates) > 1").select(F.lit("preference").alias("kind"), "entity", "dates"))
