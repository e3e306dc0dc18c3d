"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_folder(spark) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where it is unset a temporary one, if all run in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a table written once in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: With up to so many edges the least neighbours travel as a broadcast; with more they are written, so that the engine can split a hot node's join.
BROADCAST_EDGES = 100_000


def _star(pairs: DataFrame, large: bool, few: bool) -> DataFrame:
    """pairs (u, v) -> every kept v tied to the least neighbour of u, itself included.

    The least neighbour is a partial aggregate, so a node with many neighbours isn't gathered in one task.
    """
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("low"))
    least = F.broadcast(least) if few else stored(least)
    tied = pairs.join(least, F.col("u") == F.col("w")).withColumn("root", F.least("low", "u"))
    if large:
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("root").alias("v"))
    ends = F.explode(F.array(F.col("u"), F.col("v")))
    return tied.select(ends.alias("u"), F.col("root").alias("v")).filter(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of one orderable type -> (node, root): root is the least node that node can reach.

    Nodes without an edge to another node don't appear; self loops, nulls and repeated edges are
    ignored.  A round takes two aggregates; a path of n nodes needs about log2(n) rounds.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, last = stored(e), None
    count = e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the large star has at most two pairs an edge
        large = _star(both, True, count <= BROADCAST_EDGES)
        e = stored(_star(large, False, count <= BROADCAST_EDGES).distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        count = state[0]
        if state == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
