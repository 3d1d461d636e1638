"""Connected components of a graph given as edges, by large-star and small-star steps.

Edges are pairs of longs. Each step is a minimum per node (combined before it is shuffled) and a join with salted keys, so a
node with a third of all edges needs no task of its own; each round is written to the shared folder. The driver sees
two numbers a round, never edges or labels.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm.common import cut, discard, salted


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per u the smallest of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of a node is linked to the node's smallest; small: every node's smaller
    neighbours, and it, are linked to the smallest."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        out = salted(both, _smallest(both), ["u"], ["v"]).where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = _smallest(down)
        out = salted(down, low, ["u"], ["v"]).select(F.col("v").alias("a"), F.col("least").alias("b")).union(low.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node with an edge to another. edges: columns a, b; null ends
    and self-loops are left out, repeated edges count once."""
    now = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        then = cut(_star(_star(now, True), False), "edges")
        discard(now)
        now, before = then, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_of(nodes: DataFrame, roots: DataFrame, value: str) -> DataFrame:
    """nodes (column node, one row each) with least: the smallest value in their component, their own where roots, as of components(), lack
    them. A component that holds a third of all nodes is combined before the shuffle and its answer dealt out by salted keys."""
    every = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = nodes.select("node", F.col(value).alias("least")).join(every, "node")
    found = linked.groupBy("root").agg(F.min("least").alias("least"))
    given = salted(linked.select("node", "root"), found, ["root"], ["node"]).select("node", "least")
    return nodes.join(given, "node", "left").withColumn("least", F.coalesce("least", F.col(value)))
