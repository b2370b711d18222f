"""Knowledge-graph operators over triples (source, relation, target, confidence).

Traversals are loops of equi-joins on a frontier that only grows by new nodes; each round's frontier is written to the shared
folder, so that plans stay short at any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.operators.shared import stored
from memloom.operators.skew import product_join

#: Relation types with the opposite of each and whether it is transitive.
RELATIONS = {
    "合作": ("竞争", True), "竞争": ("合作", False), "认识": (None, True), "雇佣": ("被雇佣", False), "管理": ("被管理", True), "任职于": (None, False), "拥有资产": (None, False), "亲属": (None, True),
    "使用": (None, False), "依赖": ("独立", True), "包含": ("属于", True), "实现": (None, False), "调用": ("被调用", False), "开发": (None, False),
    "是一种": (None, True), "相关": (None, True), "属于": ("包含", True), "位于": (None, False), "收购": ("被收购", False), "投资": ("被投资", False),
}
#: Relation weights of the enterprise vocabulary, and which are transitive.
WEIGHTED = {
    "IsA": (1.0, True), "PartOf": (0.9, True), "HasA": (0.8, False), "WorksFor": (0.9, False), "Manages": (0.8, True), "CollaboratesWith": (0.7, True), "Knows": (0.5, True), "Uses": (0.8, False),
    "DependsOn": (0.9, True), "Implements": (0.8, False), "IntegratesWith": (0.7, True), "RelatedTo": (0.5, True), "Causes": (0.7, True), "HasProperty": (0.6, False), "HappenedBefore": (0.6, True), "HappenedAfter": (0.6, True),
}


def entities(kg: DataFrame) -> DataFrame:
    """Distinct names at either end."""
    return kg.select(F.explode(F.array("source", "target")).alias("name")).distinct()


def degree(kg: DataFrame) -> DataFrame:
    """Edges at each node, either end."""
    return kg.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def neighbors(kg: DataFrame, name: str, relation: str | None = None) -> DataFrame:
    """Outgoing and incoming edges of a node with the other end and the direction."""
    kg = kg if relation is None else kg.where(F.col("relation") == relation)
    out = kg.where(F.col("source") == name).select(F.col("target").alias("name"), "relation", F.lit("out").alias("direction"), "confidence")
    return out.unionByName(kg.where(F.col("target") == name).select(F.col("source").alias("name"), "relation", F.lit("in").alias("direction"), "confidence"))


def _both(kg: DataFrame, directed: bool) -> DataFrame:
    e = kg.select(F.col("source").alias("u"), F.col("target").alias("v"))
    return (e if directed else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))).distinct()


def k_hop(kg: DataFrame, start: str, depth: int, directed: bool = False) -> DataFrame:
    """(name, distance): breadth first, so the distance is the shortest; the start is left out.

    Each round's new nodes are stored, so that plans stay short at any depth; rounds end when there are none.
    """
    edges = stored(_both(kg, directed), "edges")
    seen = frontier = kg.sparkSession.range(1).select(F.lit(start).alias("name"), F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        frontier = _next(frontier, edges, seen).withColumn("distance", F.lit(d))
        frontier = stored(frontier, "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("distance > 0")


def _next(frontier: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes one edge from the frontier that weren't seen before."""
    step = frontier.join(edges, F.col("name") == F.col("u")).select(F.col("v").alias("name")).distinct()
    return step.join(seen.select("name"), "name", "left_anti")


def shortest_paths(kg: DataFrame, start: str, end: str, most: int, directed: bool = False) -> DataFrame:
    """(hops, path) of every shortest path of at most `most` edges between two different nodes.

    Breadth first from both ends, each time from the smaller frontier, every round stored. When the two meet, the rounds are walked back
    from where they met: what is left are the edges of shortest paths alone, and paths are put together along them, with no dead ends.
    """
    spark = kg.sparkSession
    edges = stored(_both(kg, directed), "edges")
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    one = lambda x: stored(spark.range(1).select(F.lit(x).alias("name")), "frontier")
    rounds, sizes, ways = ([one(start)], [one(end)]), [1, 1], (edges, back)
    met = None
    while start != end and met is None and len(rounds[0]) + len(rounds[1]) - 2 < most:
        side = 0 if sizes[0] <= sizes[1] else 1
        own, other = rounds[side], rounds[1 - side]
        seen = own[0]
        for r in own[1:]:
            seen = seen.unionByName(r)
        new = stored(_next(own[-1], ways[side], seen), "frontier")
        sizes[side] = new.count()
        if not sizes[side]:
            break
        own.append(new)
        both = stored(new.join(other[-1], "name", "left_semi"), "met")
        met = both if not both.isEmpty() else None
    if met is None:
        return spark.createDataFrame([], "hops int, path array<string>")
    steps: list[DataFrame] = []
    for side in (0, 1):  # from the meeting nodes back to each end, by the edges between a round and the one before it
        held, walked = met, []
        for r in reversed(rounds[side][:-1]):
            e = ways[side].join(r.select(F.col("name").alias("u")), "u").join(held.select(F.col("name").alias("v")), "v")
            e = stored(e.select("u", "v"), "steps")
            walked.append(e)
            held = e.select(F.col("u").alias("name")).distinct()
        steps = [*reversed(walked)] if side == 0 else steps + [e.select(F.col("v").alias("u"), F.col("u").alias("v")) for e in walked]
    paths = spark.range(1).select(F.array(F.lit(start)).alias("path"))
    for e in steps:
        paths = paths.join(e, F.element_at("path", -1) == F.col("u")).select(F.concat("path", F.array("v")).alias("path"))
    return paths.select(F.lit(len(steps)).alias("hops"), "path")


def _is(relations: list[str]) -> Column:
    return F.col("relation").isin(*relations)


def infer(kg: DataFrame, transitive: list[str], factor: float = 0.8) -> DataFrame:
    """Edges that transitive relations imply and no edge of any relation states: confidence min * factor, the best of several.

    A node that many edges reach and leave is a heavy key of the join, dealt over a grid of tasks.
    """
    t = kg.where(_is(transitive))
    a = t.select(F.col("source").alias("source"), "relation", F.col("target").alias("mid"), F.col("confidence").alias("c1"))
    b = t.select(F.col("source").alias("mid"), "relation", F.col("target").alias("target"), F.col("confidence").alias("c2"))
    new = product_join(a, b, ["mid", "relation"], "source", "target").where("source <> target").groupBy("source", "relation", "target").agg(F.round(F.max(F.least("c1", "c2") * factor), 6).alias("confidence"))
    return new.join(kg.select("source", "target").distinct(), ["source", "target"], "left_anti").select("source", "relation", "target", "confidence")


def contradictions(kg: DataFrame, opposites: dict[str, str]) -> DataFrame:
    """(source, target, r1, r2, c1, c2): opposite relations between the same ends; mutual opposites report both orders."""
    pairs = F.create_map(*(F.lit(x) for kv in opposites.items() for x in kv))
    one = kg.where(_is(list(opposites))).select("source", "target", F.col("relation").alias("r1"), F.col("confidence").alias("c1"), pairs[F.col("relation")].alias("r2"))
    two = kg.select("source", "target", F.col("relation").alias("r2"), F.col("confidence").alias("c2"))
    return one.join(two, ["source", "target", "r2"]).select("source", "target", "r1", "r2", "c1", "c2")


def resolved(kg: DataFrame, opposites: dict[str, str]) -> DataFrame:
    """kg without the weaker edge of each contradiction; of equal ones the later name goes."""
    c = contradictions(kg, opposites)
    lost = c.where("c1 < c2 OR (c1 = c2 AND r1 > r2)").select("source", F.col("r1").alias("relation"), "target").distinct()
    return kg.join(lost, ["source", "relation", "target"], "left_anti")


def merged(kg: DataFrame, names: list[str], canonical: str) -> DataFrame:
    """kg with several names as one; loops that this makes go, equal edges become one with the best confidence."""
    put = lambda c: F.when(F.col(c).isin(*names), canonical).otherwise(F.col(c)).alias(c)
    m = kg.select(put("source"), "relation", put("target"), "confidence").where("source <> target")
    return m.groupBy("source", "relation", "target").agg(F.max("confidence").alias("confidence"))


def co_occurrence(mentions: DataFrame, group: str, name: str, least: int = 1) -> DataFrame:
    """(a, b, n): unordered pairs of names that share a group; a group of very many names is dealt over a grid of tasks."""
    m = mentions.select(group, name).distinct()
    a, b = m.withColumnRenamed(name, "a"), m.withColumnRenamed(name, "b")
    return product_join(a, b, [group], "a", "b").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def hebbian(pairs: DataFrame, kg: DataFrame, least: int = 3, relation: str = "相关") -> DataFrame:
    """Edges that pairs seen often enough imply and the graph lacks, either way round."""
    known = kg.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    new = pairs.where(F.col("n") >= least).join(known, ["a", "b"], "left_anti")
    return new.select(F.col("a").alias("source"), F.lit(relation).alias("relation"), F.col("b").alias("target"), F.round(F.least(0.1 * F.col("n"), F.lit(0.9)), 6).alias("confidence"))


def boosted(kg: DataFrame, pairs: DataFrame, step: float = 0.05) -> DataFrame:
    """kg with confidence raised by `step` for each co-occurrence of its ends, at most 1."""
    p = pairs.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "n")
    j = kg.join(p, (F.least("source", "target") == F.col("_a")) & (F.greatest("source", "target") == F.col("_b")), "left")
    return j.select("source", "relation", "target", F.round(F.least(F.col("confidence") + F.coalesce("n", F.lit(0)) * step, F.lit(1.0)), 6).alias("confidence"))


def best_of(kg: DataFrame) -> DataFrame:
    """Merged extraction results: the most confident row of each triple."""
    return kg.groupBy("source", "relation", "target").agg(F.max("confidence").alias("confidence"), F.count("*").alias("seen"))


def verified(names: DataFrame, edges: DataFrame, sure: float = 0.9) -> DataFrame:
    """Edges both of whose ends are in their text or sure; names are (doc, name, text, confidence)."""
    ok = names.where((F.col("confidence") >= sure) | F.lower("text").contains(F.lower("name"))).select("doc", "name").distinct()
    for end in ("source", "target"):
        edges = edges.join(ok.withColumnRenamed("name", end), ["doc", end], "left_semi")
    return edges


def resolved_names(mentions: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions with their canonical name and whether the graph has it already."""
    a = aliases.select(F.lower("alias").alias("_k"), "canonical")
    m = mentions.join(a, F.lower("name") == F.col("_k"), "left").select("name", F.coalesce("canonical", "name").alias("canonical"))
    k = known.select(F.lower("name").alias("_n")).distinct().withColumn("is_existing", F.lit(True))
    return m.join(k, F.lower("canonical") == F.col("_n"), "left").select("name", "canonical", F.coalesce("is_existing", F.lit(False)).alias("is_existing"))


def learned_types(defaults: DataFrame, learned: DataFrame) -> DataFrame:
    """Type table (name, category, opposite, transitive) with learned rows over the built-in ones of the same name."""
    return learned.unionByName(defaults.join(learned.select("name"), "name", "left_anti"))


def with_feedback(kg: DataFrame, feedback: DataFrame) -> DataFrame:
    """kg after feedback (source, relation, target, correct): confirmed triples have confidence 1 and are added where missing, denied ones go."""
    keys = ["source", "relation", "target"]
    denied = feedback.where("NOT correct").select(*keys).distinct()
    right = feedback.where("correct").select(*keys).distinct().withColumn("confidence", F.lit(1.0))
    left = kg.join(feedback.select(*keys).distinct(), keys, "left_anti").select(*keys, "confidence")
    return left.unionByName(right.join(denied, keys, "left_anti"))


def self_update(kg: DataFrame, new: DataFrame, aliases: dict[str, str], pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """One round of upkeep: new triples in, aliases to their names, confidence raised by co-occurrence, doubtful edges out."""
    both = kg.select("source", "relation", "target", "confidence").unionByName(new.select("source", "relation", "target", "confidence"))
    if aliases:
        names = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
        both = both.withColumns({c: F.coalesce(names[F.col(c)], F.col(c)) for c in ("source", "target")}).where("source <> target")
    return boosted(best_of(both).drop("seen"), pairs).where(F.col("confidence") >= least)
