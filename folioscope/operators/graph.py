"""Operators on the concept graph: edges (src, dst, type, strength).

Searches keep one row a pair of start and node, grow by joins of the frontier
with the edges, and cut lineage after each hop. Equal-length paths: the largest
product of weights wins, then the least path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.lineage import materialize

#: Weights of relationship types and of mentions.
TYPE_WEIGHTS = {"REQUIRES": 1.0, "EXTENDS": 0.9, "USES": 0.8, "ADDRESSES": 0.7, "SPECIALIZES": 0.6, "GENERALIZES": 0.6, "ALTERNATIVE_TO": 0.5, "RELATED_TO": 0.4}
MENTION_WEIGHTS = {"defines": 1.0, "reference": 0.6, "example": 0.4}
OTHER_WEIGHT = 0.5


def type_weight(column: Column | str) -> Column:
    return _looked_up(column, TYPE_WEIGHTS)


def mention_weight(column: Column | str) -> Column:
    return _looked_up(column, MENTION_WEIGHTS)


def _looked_up(column: Column | str, weights: dict[str, float]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(column) if isinstance(column, str) else column), F.lit(OTHER_WEIGHT))


def arcs(edges: DataFrame, directed: bool) -> DataFrame:
    """src, dst, type and weight of each step that a search may take; of parallel edges the heaviest."""
    one = edges.select("src", "dst", "type")
    both = one if directed else one.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.max_by("type", F.struct(type_weight("type"), "type")).alias("type")).withColumn("weight", type_weight("type"))


def distances(edges: DataFrame, starts: DataFrame, hops: int = 2, directed: bool = False) -> DataFrame:
    """start, node, hops, weight (the largest product over shortest paths) and path of every node within ``hops`` of a start (id)."""
    step = materialize(arcs(edges, directed), "arcs")
    seen = starts.select(F.col("id").alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops"), F.lit(1.0).alias("weight"), F.array("start").alias("path"))
    frontier = seen
    for hop in range(1, hops + 1):
        grown = frontier.join(step.select(F.col("src").alias("node"), F.col("dst").alias("__to"), F.col("weight").alias("__w")), "node")
        grown = grown.select("start", F.col("__to").alias("node"), (F.col("weight") * F.col("__w")).alias("weight"), F.concat("path", F.array("__to")).alias("path"))
        grown = grown.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        best = grown.groupBy("start", "node").agg(F.min(F.struct(-F.col("weight"), "path")).alias("b"))
        frontier = materialize(best.select("start", "node", F.lit(hop).alias("hops"), (-F.col("b.col1")).alias("weight"), F.col("b.path").alias("path")), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, hops: int = 5, directed: bool = False) -> DataFrame:
    """step, node and the type of the edge into it, of one shortest path; no rows if there is none within ``hops``. Stops at the hop that reaches the end."""
    spark = edges.sparkSession
    step = materialize(arcs(edges, directed), "arcs")
    frontier = spark.createDataFrame([(start, 1.0, [start])], "node string, weight double, path array<string>")
    seen = frontier.select("node")
    for _ in range(hops):
        if start == end or frontier.where(F.col("node") == end).limit(1).count():
            break
        grown = frontier.join(step.select(F.col("src").cast("string").alias("node"), F.col("dst").cast("string").alias("__to"), F.col("weight").alias("__w")), "node")
        grown = grown.select(F.col("__to").alias("node"), (F.col("weight") * F.col("__w")).alias("weight"), F.concat("path", F.array("__to")).alias("path")).join(seen, "node", "left_anti")
        frontier = materialize(grown.groupBy("node").agg(F.min(F.struct(-F.col("weight"), "path")).alias("b")).select("node", (-F.col("b.col1")).alias("weight"), F.col("b.path").alias("path")), "frontier")
        seen = seen.unionByName(frontier.select("node"))
    found = frontier.where(F.col("node") == end).select(F.posexplode("path").alias("step", "node"), "path").withColumn("__from", F.get(F.col("path"), F.col("step") - 1))
    into = step.select(F.col("src").cast("string").alias("__from"), F.col("dst").cast("string").alias("node"), "type")
    return found.join(into, ["__from", "node"], "left").select("step", "node", "type")


def neighbourhood(edges: DataFrame, center: str, hops: int = 1, types: list[str] | None = None, directed: bool = False, limit: int | None = None) -> DataFrame:
    """node and hops of the nodes within ``hops`` of the center, itself left out; the nearest first if limited."""
    spark = edges.sparkSession
    kept = edges if types is None else edges.where(F.col("type").isin(types))
    kind = dict(edges.dtypes)["src"]
    start = spark.range(1).select(F.lit(center).cast(kind).alias("id"))
    rows = distances(kept, start, hops, directed).where("hops > 0").select("node", "hops")
    return rows if limit is None else rows.orderBy("hops", "node").limit(limit)


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among ``nodes`` (node)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")


def related_concepts(edges: DataFrame, start: str, depth: int = 2, strength: float = 0.0) -> DataFrame:
    """node, distance and types on the way of what can be reached along edges, or against undirected ones; only the start is barred from a return, the nearest way counts, of equal ones the least."""
    kind = dict(edges.dtypes)["src"]
    kept = edges.where(F.col("strength") >= strength)
    step = kept.select("src", "dst", "type")
    if "is_directed" in edges.columns:
        step = step.unionByName(kept.where("NOT is_directed").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
    step = materialize(step.distinct(), "steps")
    frontier = edges.sparkSession.range(1).select(F.lit(start).cast(kind).alias("node"), F.array().cast("array<string>").alias("types"))
    every = None
    for hop in range(1, depth + 1):
        grown = frontier.join(step.withColumnRenamed("src", "node"), "node").where(F.col("dst") != F.lit(start).cast(kind))
        frontier = materialize(grown.select(F.col("dst").alias("node"), F.concat("types", F.array("type")).alias("types")).groupBy("node").agg(F.min("types").alias("types")), "related")
        level = frontier.withColumn("distance", F.lit(hop))
        every = level if every is None else every.unionByName(level)
    return every.groupBy("node").agg(F.min(F.struct("distance", "types")).alias("b")).select("node", "b.distance", F.array_join("b.types", ">").alias("path"))


def graph_scores(edges: DataFrame, query_concepts: DataFrame, chunk_concepts: DataFrame, hops: int = 2, weighted: bool = True, self_match: bool = True, directed: bool = False, mentions: bool = False) -> DataFrame:
    """id (of the chunk) and graph_score: the mean over pairs of query and chunk concepts of weight / (length + 1), at most 1.

    Pairs beyond ``hops`` give 0. ``self_match`` lets a concept meet itself at
    length 0. ``mentions`` multiplies by the mean over the chunk's concepts of
    mention weight and relevance (unknown relevance 1). Chunks are linked by
    chunk_concepts (chunk_id, concept_id, mention_type, relevance_score); a
    concept with several mentions counts once, by its strongest.
    """
    near = distances(edges, query_concepts.select("id"), hops, directed).where("hops > 0" if not self_match else "true")
    value = (F.col("weight") if weighted else F.lit(1.0)) / (F.col("hops") + 1)
    per_node = near.groupBy(F.col("node").alias("concept_id")).agg(F.sum(value).alias("value"))
    strength = mention_weight("mention_type") * F.coalesce("relevance_score", F.lit(1.0))
    links = chunk_concepts.groupBy("chunk_id", "concept_id").agg(F.max(strength).alias("strength"))
    totals = query_concepts.select("id").distinct().agg(F.count("*").alias("q"))
    rows = links.join(per_node, "concept_id", "left").groupBy("chunk_id").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("sum"), F.count("*").alias("c"), F.avg("strength").alias("strength"))
    score = F.least(F.coalesce(F.try_divide(F.col("sum"), F.col("q") * F.col("c")), F.lit(0.0)), F.lit(1.0))
    return rows.crossJoin(F.broadcast(totals)).select(F.col("chunk_id").alias("id"), (score * F.col("strength") if mentions else score).alias("graph_score"))


def best_explanations(near: DataFrame, chunk_concepts: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """chunk_id, rank and text of the shortest links between query and chunk concepts; ``near`` is a table of distances."""
    met = chunk_concepts.select("chunk_id", F.col("concept_id").alias("node")).distinct().join(near.where("hops > 0"), "node")
    by = Window.partitionBy("chunk_id").orderBy("hops", F.desc("weight"), "start", "node")
    top = met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    parts = top.select("chunk_id", "rank", F.posexplode("path").alias("at", "id")).join(names.select("id", "name"), "id")
    return parts.groupBy("chunk_id", "rank").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " -> ").alias("explanation"))


def path_text(path: DataFrame, names: DataFrame) -> DataFrame:
    """One row: ``a -> (uses) -> b`` for a path (step, node, type)."""
    rows = path.join(names.select(F.col("id").alias("node"), "name"), "node", "left")
    part = F.when(F.col("type").isNull(), F.col("name")).otherwise(F.concat(F.lit("-> ("), F.lower(F.replace("type", F.lit("_"), F.lit(" "))), F.lit(") -> "), F.col("name")))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", part.alias("text")))), lambda x: x["text"]), " ").alias("explanation"))


def resolve(concepts: DataFrame, text: str) -> DataFrame:
    """The concept meant by a name or id: canonical name in lower case, exact canonical name, id, then a name that holds it."""
    t = F.lit(text)
    kind = F.when(F.col("canonical_name") == F.lower(t), 0).when(F.col("canonical_name") == t, 1).when(F.col("id").cast("string") == t, 2).when(F.contains(F.lower("name"), F.lower(t)), 3)
    return concepts.withColumn("__k", kind).where("__k IS NOT NULL").orderBy("__k", F.length("name"), "id").limit(1).drop("__k")


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree, edges in and out."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def edge_lists(edges: DataFrame, node: str, direction: str = "both", limit: int = 100) -> DataFrame:
    """Edges out of, into, or at a node, the strongest first; against the arrow only where undirected, if edges tell."""
    kind = dict(edges.dtypes)["src"]
    x = F.lit(node).cast(kind)
    free = ~F.col("is_directed") if "is_directed" in edges.columns else F.lit(True)
    keep = {"out": F.col("src") == x, "in": F.col("dst") == x, "both": (F.col("src") == x) | ((F.col("dst") == x) & free)}[direction]
    return edges.where(keep).orderBy(F.desc("strength"), "src", "dst", "type").limit(limit)


def path_evidence(path: DataFrame, edges: DataFrame, chunk_concepts: DataFrame, most: int = 2) -> DataFrame:
    """step, chunk_id and rank of evidence for each step: chunks of the edge itself, then one that defines the node, then any other that names it.

    ``edges`` may have evidence_chunk_ids; ``path`` is (step, node, type).
    """
    w = Window.orderBy("step")
    steps = path.withColumn("__from", F.lag("node").over(w))
    given = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.explode("evidence_chunk_ids").alias("chunk_id"))
    at_edge = steps.join(given, ((F.col("__from") == F.col("a")) & (F.col("node") == F.col("b"))) | ((F.col("__from") == F.col("b")) & (F.col("node") == F.col("a")))).select("step", F.col("chunk_id").cast("string"), F.lit(0).alias("kind"), F.lit(0.0).alias("relevance"))
    named = steps.join(chunk_concepts.select(F.col("concept_id").cast("string").alias("node"), F.col("chunk_id").cast("string").alias("chunk_id"), "mention_type", F.coalesce("relevance_score", F.lit(0.0)).alias("relevance")), "node")
    named = named.select("step", "chunk_id", F.when(F.col("mention_type") == "defines", 1).otherwise(2).alias("kind"), "relevance")
    best = at_edge.unionByName(named).groupBy("step", "chunk_id").agg(F.min(F.struct("kind", -F.col("relevance"))).alias("best"))
    by = Window.partitionBy("step").orderBy("best", "chunk_id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("step", "chunk_id", F.col("best.kind").alias("kind"), "rank")
