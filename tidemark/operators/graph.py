"""Bounded traversal, level by level."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import stored
from tidemark.operators.events import visible_events, visible_relations
from tidemark.operators.evidence import active_provenance, visible_provenance
from tidemark.operators.scan import as_of
from tidemark.plans.context import Context, QueryError


@dataclass(frozen=True)
class GraphSpec:
    roots: tuple[int, ...] | DataFrame  # a DataFrame: its ids in column ``node``, in ascending order
    kinds: tuple[str, ...]
    direction: str = "outgoing"  # incoming, both
    max_depth: int = 3
    max_nodes: int | None = None  # None: as many as there are
    max_edges: int | None = None
    emit_repeated: bool = True  # else edges to nodes that were reached before are left out

    def __post_init__(self):
        listed = not isinstance(self.roots, DataFrame)
        if listed and (not self.roots or len(set(self.roots)) < len(self.roots)) or not self.kinds or len(set(self.kinds)) < len(self.kinds):
            raise QueryError("roots and kinds: at least one, each once")
        if any(cap is not None and cap <= 0 for cap in (self.max_nodes, self.max_edges)) or self.max_depth < 0 or self.direction not in ("outgoing", "incoming", "both"):
            raise QueryError("caps are positive, depth isn't negative")


def adjacency(edges: DataFrame, spec: GraphSpec) -> DataFrame:
    """(node, neighbour, edge_id, kind, reverse): same_time goes both ways whatever the direction, a self loop once."""
    rows = edges.filter(F.col("kind").isin(*spec.kinds))
    ahead = rows.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour"), F.col("relation_id").alias("edge_id"), "kind", F.lit(False).alias("reverse"))
    back = rows.select(F.col("to_id").alias("node"), F.col("from_id").alias("neighbour"), F.col("relation_id").alias("edge_id"), "kind", F.lit(True).alias("reverse"))
    same = F.col("kind") == "same_time"
    loop = F.col("node") == F.col("neighbour")
    if spec.direction == "outgoing":
        return ahead.unionByName(back.filter(same & ~loop))
    if spec.direction == "incoming":
        return back.filter(~same).unionByName(ahead.filter(same)).unionByName(back.filter(same & ~loop))
    return ahead.unionByName(back.filter(~loop))


def traverse(nodes: DataFrame, edges: DataFrame, spec: GraphSpec) -> tuple[DataFrame, DataFrame]:
    """(node, depth) and (edge_id, kind, from_id, to_id, depth) reached from the roots.

    ``nodes`` has event_id, or node of any orderable type; ends of edges are of the same type.  Only
    visible nodes and edges between them take part.  A frontier is joined to the adjacency per level;
    levels are written, so lineage stays short.  An edge walked backwards is turned around and each is
    emitted once, at its first use.  Caps that are exceeded, by the roots or by any level, fail the query.
    """
    spark = nodes.sparkSession
    most_nodes, most_edges = (math.inf if cap is None else cap for cap in (spec.max_nodes, spec.max_edges))
    ids = nodes.select(F.col("event_id" if "event_id" in nodes.columns else "node").alias("node"))
    links = adjacency(edges, spec).join(ids, "node", "left_semi").join(ids.withColumnRenamed("node", "neighbour"), "neighbour", "left_semi")
    links = stored(links)
    first: Column
    if isinstance(spec.roots, DataFrame):  # an id is its own place
        roots = spec.roots.select("node").distinct()
        first = F.struct(F.lit(0).cast("long").alias("turn"), "node")
    else:
        roots = spark.createDataFrame([(r, k) for k, r in enumerate(spec.roots)], "node long, turn long")
        first = F.struct("turn", "node")
    # the place of a node in its level: what found it, what found that, and so on from the root
    roots = roots.join(ids, "node", "left_semi")
    reached = frontier = stored(roots.select("node", F.lit(0).alias("depth"), F.array(first).alias("place")))
    n_reached, n_walked = frontier.count(), 0
    if n_reached > most_nodes:
        raise QueryError("the traversal exceeds its caps")
    walked = None
    for depth in range(1, spec.max_depth + 1):
        steps = frontier.select("node", "place").join(links, "node")
        if spec.emit_repeated:
            if walked is not None:
                steps = steps.join(walked.select("edge_id"), "edge_id", "left_anti")
        else:
            steps = steps.join(reached.select(F.col("node").alias("neighbour")), "neighbour", "left_anti")
        # queue order: the parent's place, then the neighbour, then the edge
        line = Window.partitionBy("edge_id").orderBy("place", "neighbour")
        used = steps.withColumn("n", F.row_number().over(line)).filter(F.col("n") == 1)
        if not spec.emit_repeated:  # the first edge that comes to a node is the one that finds it
            found = Window.partitionBy("neighbour").orderBy("place", "edge_id")
            used = steps.withColumn("n", F.row_number().over(found)).filter(F.col("n") == 1)
        level = stored(used.select("edge_id", "kind", F.col("node").alias("from_id"), F.col("neighbour").alias("to_id"), "reverse", F.lit(depth).alias("depth"), "place"))
        walked = level if walked is None else walked.unionByName(level)
        fresh = level.select(F.col("to_id").alias("node"), "place").join(reached.select("node"), "node", "left_anti")
        fresh = fresh.groupBy("node").agg(F.min("place").alias("parent"))
        turn = F.struct(F.lit(0).cast("long").alias("turn"), F.col("node"))
        frontier = stored(fresh.select("node", F.lit(depth).alias("depth"), F.concat("parent", F.array(turn)).alias("place")))
        reached = reached.unionByName(frontier)
        fresh_count = frontier.count()
        n_reached, n_walked = n_reached + fresh_count, n_walked + (0 if spec.max_edges is None else level.count())
        if n_reached > most_nodes or n_walked > most_edges:
            raise QueryError("the traversal exceeds its caps")
        if not fresh_count:
            break
    if walked is None:
        walked = links.select("edge_id", "kind", F.col("node").alias("from_id"), F.col("neighbour").alias("to_id"), F.lit(0).alias("depth")).limit(0)
    return reached.select("node", "depth"), walked.select("edge_id", "kind", "from_id", "to_id", "depth")


def typed(family: str, key: str) -> Column:
    """A node of a graph over several families."""
    return F.struct(F.lit(family).alias("family"), F.col(key).cast("long").alias("id"))


def record_graph(store, ctx: Context, rights=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges over facts: visible events and assertions of the branch, tied by event relations and by provenance."""
    if rights is not None:
        rights.demand("query_graph_traverse")
    assertions = as_of(store.assertions if rights is None else store.assertions.filter(rights.endpoints("assertion", "assertion_id")), ctx)
    events = visible_events(store, ctx, rights=rights)
    nodes = events.select(typed("event", "event_id").alias("node")).unionByName(assertions.select(typed("assertion", "assertion_id").alias("node")))
    relations = visible_relations(store, ctx, rights).select(F.concat(F.lit("event/"), F.col("relation_id").cast("string")).alias("relation_id"), "kind", typed("event", "from_id").alias("from_id"), typed("event", "to_id").alias("to_id"))
    provenance = active_provenance(store, ctx.as_of) if rights is None else visible_provenance(store, ctx, rights)
    provenance = provenance.select(F.concat(F.lit("provenance/"), F.col("edge_id").cast("string")).alias("relation_id"), F.col("relation").alias("kind"), typed("assertion", "from_id").alias("from_id"), typed("assertion", "to_id").alias("to_id"))
    return nodes, relations.unionByName(provenance)
