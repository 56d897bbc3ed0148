"""Parent-child links to full hierarchies by pointer doubling.

Each round joins what is known with itself, so reach doubles: a hierarchy of depth d is closed after log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.session import cut

MAX_ROUNDS = 40
TRIMS = 6


def links(nodes: DataFrame, node: str = "node_id", parents: str = "instanceof") -> DataFrame:
    """Distinct ``child``, ``parent``: ids trimmed; NULL or blank ids and parents that are no node are left out; a node
    delivered twice counts once.  A table without links gives no rows."""
    ids = nodes.select(F.trim(F.col(node)).alias("parent")).filter("parent <> ''").distinct()
    raw = nodes.select(F.trim(F.col(node)).alias("child"), F.explode(F.col(parents)).alias("parent"))
    raw = raw.select("child", F.trim("parent").alias("parent")).filter("child <> '' and parent <> ''").distinct()
    return raw.join(ids, "parent", "left_semi").select("child", "parent")


def ancestors(edges: DataFrame) -> DataFrame:
    """All ``node_id``, ``ancestor``, ``distance`` (the shortest); a node on a loop is its own ancestor.

    Nodes without children cannot be passed through, so only inner nodes take part in the doubling; the rest is attached
    by one join in the end.
    """
    inner = edges.select(F.col("parent").alias("child")).distinct()
    core = edges.join(inner, "child", "left_semi")
    rest = edges.join(inner, "child", "left_anti")
    reach = inner_closure(core)
    above = rest.join(reach.withColumnRenamed("node_id", "parent"), "parent").select(F.col("child").alias("node_id"), "ancestor", (F.col("distance") + 1).alias("distance"))
    direct = rest.select(F.col("child").alias("node_id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    return reach.unionByName(above.unionByName(direct).groupBy("node_id", "ancestor").agg(F.min("distance").alias("distance")))


def inner_closure(core: DataFrame) -> DataFrame:
    """The closure of ``child``, ``parent`` by doubling: ends with the round that finds nothing new, at the latest when jumps
    exceed any possible path; loops are closed within those rounds and cannot prolong them."""
    reach = cut(core.select(F.col("child").alias("node_id"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    known = reach.count()
    for _ in range(MAX_ROUNDS):
        onward = reach.select(F.col("node_id").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more"))
        jumped = reach.join(onward, "ancestor").select("node_id", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = cut(reach.unionByName(jumped).groupBy("node_id", "ancestor").agg(F.min("distance").alias("distance")))
        before, known = known, reach.count()
        if known == before:
            return reach
    raise RuntimeError("the hierarchy is deeper than any table can hold")


def trimmed(edges: DataFrame) -> DataFrame:
    """``child``, ``parent`` without links that cannot be part of a loop: nodes without parents or without children go, round by
    round, until none is left to go or ``TRIMS`` rounds are over.  What is left holds every loop; of shallow hierarchies
    nothing else is left."""
    known = None
    for _ in range(TRIMS):
        having = edges.select(F.col("child").alias("parent")).distinct()
        edges = edges.join(having, "parent", "left_semi").select("child", "parent")
        having = edges.select(F.col("parent").alias("child")).distinct()
        edges = cut(edges.join(having, "child", "left_semi").select("child", "parent"))
        before, known = known, edges.count()
        if known in (0, before):
            break
    return edges


def on_loops(edges: DataFrame) -> DataFrame:
    """``node_id`` of nodes on a closed loop, self links included; nodes that only lead into one are not.

    What trimming leaves is closed by pointer doubling; paths between loops are told from loops by nodes that reach
    themselves.
    """
    left = trimmed(edges)
    if left.isEmpty():
        return left.select(F.col("child").alias("node_id"))
    return inner_closure(left).filter(F.col("node_id") == F.col("ancestor")).select("node_id").distinct()


def paths(nodes: DataFrame, edges: DataFrame, node: str = "node_id") -> DataFrame:
    """One row per path from a node up: ``node_id``, ``root``, ``depth`` (links on the path), ``path`` (from the root, ids
    joined by " > "), ``looped``.

    A node without parents is its own root at depth 0.  A path that meets a loop ends at the first node on it: ``root`` is
    NULL and ``looped`` true; nodes on a loop have only that path of themselves.  Path segments are concatenated by doubling:
    a path that has not ended joins all paths known to start where it stands.
    """
    loop = on_loops(edges).withColumn("looped", F.lit(True))
    ids = nodes.select(F.trim(F.col(node)).alias("node_id")).filter("node_id <> ''").distinct()
    parents = edges.withColumnRenamed("child", "node_id").join(loop, "node_id", "left_anti")
    ends = ids.join(parents.select("node_id").distinct(), "node_id", "left_anti").join(loop, "node_id", "left")
    ended = ends.select("node_id", F.col("node_id").alias("tip"), F.array("node_id").alias("path"), F.coalesce("looped", F.lit(False)).alias("looped"), F.lit(True).alias("ended"))
    begun = parents.select("node_id", F.col("parent").alias("tip"), F.array("node_id").alias("path"), F.lit(False).alias("looped"), F.lit(False).alias("ended"))
    known = cut(begun.unionByName(ended))
    for _ in range(MAX_ROUNDS):
        open_ = known.filter(~F.col("ended"))
        if open_.isEmpty():
            break
        onward = known.select(F.col("node_id").alias("tip"), F.col("tip").alias("_tip"), F.col("path").alias("_path"), F.col("looped").alias("_looped"), F.col("ended").alias("_ended"))
        grown = open_.join(onward, "tip").select("node_id", F.col("_tip").alias("tip"), F.concat("path", "_path").alias("path"), F.col("_looped").alias("looped"), F.col("_ended").alias("ended"))
        known = cut(known.filter("ended").unionByName(grown))
    return known.select(
        "node_id",
        F.when(~F.col("looped"), F.col("tip")).alias("root"),
        (F.size("path") - 1).cast("long").alias("depth"),
        F.array_join(F.reverse("path"), " > ").alias("path"),
        "looped",
    )
