"""Walks over edge tables ``(src, dst)``.

A walk is a loop of joins. After each step the frontier is checkpointed to the
shared folder, so the plan stays short and a lost executor costs one step. The
loops end when a step finds nothing new, however deep the graph; where a cycle
would go on for ever, it is an error once a walk is longer than there are nodes.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.hot import numbered


def _compact(union: DataFrame, depth: int) -> DataFrame:
    """One checkpoint in place of the pieces of many steps."""
    return union.checkpoint() if depth % 25 == 0 else union


def breadth_first(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Reach order from the start nodes: ``(node, parent, depth, position)``.

    Nodes are taken level by level, in the order of their parents and then of
    their own ids; each node once.
    """
    level = numbered(start.select("node"), [], ["node"], "position").select(
        "node", F.lit(None).cast(start.schema["node"].dataType).alias("parent"), F.lit(0).alias("depth"),
        (F.col("position") - 1).alias("position")).checkpoint()
    seen, reached = level, level.count()
    for depth in itertools.count(1):
        step = (level.select(F.col("node").alias("src"), F.col("position").alias("__p")).join(edges, "src")
                .groupBy(F.col("dst").alias("node"))
                .agg(F.min(F.struct("__p", F.col("src").alias("parent"))).alias("__from"))
                .join(seen.select("node"), "node", "left_anti")
                .select("node", "__from.__p", "__from.parent").checkpoint())
        if step.isEmpty():
            return seen
        level = numbered(step, [], ["__p", "node"], "position").select(
            "node", "parent", F.lit(depth).alias("depth"), (F.col("position") + (reached - 1)).alias("position")).checkpoint()
        reached += level.count()
        seen = _compact(seen.unionByName(level), depth)


def walk_tree(edges: DataFrame, roots: DataFrame, check_every: int = 100) -> DataFrame:
    """Every node below the roots with its depth and path: ``(node, parent, depth, path)``.

    Sorted by ``path``, parents come before children and siblings in order of
    ``label``, the text that each edge (and root) gives its node.
    """
    level = roots.select("node", F.lit(None).cast(roots.schema["node"].dataType).alias("parent"),
                         F.lit(0).alias("depth"), F.col("label").alias("path")).checkpoint()
    out, nodes = level, None
    for depth in itertools.count(1):
        if depth % check_every == 0:
            nodes = edges.select("dst").distinct().count() if nodes is None else nodes
            if depth > nodes + 1:
                raise RuntimeError("the edges have a cycle")
        level = (level.select(F.col("node").alias("src"), F.col("path").alias("__path")).join(edges, "src")
                 .select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(depth).alias("depth"),
                         F.concat_ws("/", "__path", "label").alias("path")).checkpoint())
        if level.isEmpty():
            return out
        out = _compact(out.unionByName(level), depth)


def chain_ends(links: DataFrame) -> DataFrame:
    """For every node of ``(node, parent)`` the end of its parent chain: ``(node, root, depth)``.

    Each round joins every open chain with itself and doubles its reach, so a
    chain of n links takes log2(n) rounds. A root has parent null.
    """
    jump = links.select("node", F.coalesce("parent", "node").alias("up"),
                        F.when(F.col("parent").isNull(), 0).otherwise(1).alias("steps"),
                        F.col("parent").isNull().alias("done")).checkpoint()
    finished = jump.where("done")
    moving = jump.where("not done")
    # the reach doubles, so a chain without a cycle has ended when it exceeds the number of links
    for _ in range(links.count().bit_length() + 2):
        if moving.isEmpty():
            return finished.select("node", F.col("up").alias("root"), F.col("steps").alias("depth"))
        onward = jump.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("steps").alias("__s"),
                             F.col("done").alias("__d"))
        after = (moving.join(onward, moving["up"] == onward["__n"])
                 .select("node", F.col("__up").alias("up"), (F.col("steps") + F.col("__s")).alias("steps"),
                         F.col("__d").alias("done")).checkpoint())
        finished = finished.unionByName(after.where("done"))
        moving = after.where("not done")
        jump = finished.unionByName(moving)
    raise RuntimeError("the parent links have a cycle")
