"""Recursive operators over type tables: chains, closures, sizes, flattened fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from debuglens.session import by_key, cut

#: Hops that following type names may take.
HOPS = 100


def roots(edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(node, root, hops): each node followed along (src, dst), at most one dst per src, to its end.

    Pointers double each round, so 100 hops take seven joins; a chain that is still going after
    hops, such as a cycle, has a null root.
    """
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    ends = nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").select(F.col("node").alias("at"), F.lit(True).alias("end"))
    jump = nodes.join(edges.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("dst", "node").alias("at"), F.col("dst").isNotNull().cast("long").alias("n"))
    # what has reached its end is done and doesn't meet at it again
    step, reach = cut(jump.join(ends, "at", "left").withColumn("end", F.coalesce("end", F.lit(False)))), 1
    while reach < hops:
        after = step.select(F.col("node").alias("at"), F.col("at").alias("next_"), F.col("n").alias("m_"), F.col("end").alias("end_"))
        further = step.filter("NOT end").join(after, "at").select("node", F.col("next_").alias("at"), (F.col("n") + F.col("m_")).alias("n"), F.col("end_").alias("end"))
        step = cut(step.filter("end").unionByName(further, allowMissingColumns=True))
        reach *= 2
    over = ~F.col("end") | (F.col("n") > hops)
    return step.select("node", F.when(~over, F.col("at")).alias("root"), F.when(~over, F.col("n")).alias("hops"))


def closure(edges: DataFrame, hops: int) -> DataFrame:
    """(node, target, hops) for each node on a chain and each target up to hops away, itself at 0 included."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    front = nodes.select("node", F.col("node").alias("target"), F.lit(0).cast("long").alias("hops"))
    out, n = front, 0
    while n < hops:
        n += 1
        front = cut(front.join(by_key(edges.withColumnRenamed("src", "target")), "target").select("node", F.col("dst").alias("target"), F.lit(n).cast("long").alias("hops")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def sizes(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """(node, size): a node's own size plus its children's, bottom-up; null above a child of unknown size and in a cycle.

    nodes: (node, own); edges: (parent, child). Rounds go up one level each.
    """
    degree = edges.groupBy("parent").agg(F.count("*").alias("need")).withColumnRenamed("parent", "node")
    zero = F.lit(0).cast("long")
    left = cut(nodes.join(degree, "node", "left").select("node", F.col("own").cast("long").alias("own"), F.coalesce("need", zero).alias("need"), zero.alias("got"), zero.alias("sum"), zero.alias("unknown")))
    size = F.when(F.col("unknown") == 0, F.col("own") + F.col("sum")).alias("size")
    front, rest = left.filter("got = need").select("node", size), left.filter("got < need")
    done = front
    for _ in range(most):
        # only what was found in the last round goes up, and only what is open is written again
        given = edges.join(front.withColumnRenamed("node", "child"), "child").groupBy("parent").agg(F.count("*").alias("n_"), F.sum("size").alias("s_"), F.count_if(F.col("size").isNull()).alias("u_")).withColumnRenamed("parent", "node")
        more = lambda a, b: (F.col(a) + F.coalesce(b, zero)).alias(a)
        left = cut(rest.join(given, "node", "left").select("node", "own", "need", more("got", "n_"), more("sum", "s_"), more("unknown", "u_")))
        front, rest = left.filter("got = need").select("node", size), left.filter("got < need")
        if front.isEmpty():
            break
        done = done.unionByName(front)
    return nodes.select("node").join(done, "node", "left")


def reach_counts(edges: DataFrame, labels: DataFrame, label: str, hops: int) -> DataFrame:
    """(node, label, n): how many nodes of each label reach a node along edges (src, dst) in 1 to hops hops.

    labels: (node, label). Counts go along the edges already summed by label, so a round has a
    row for each node and label rather than for each pair of nodes.
    """
    front = labels.select("node", label, F.lit(1).cast("long").alias("n"))
    out, step = None, edges.select(F.col("src").alias("node"), F.col("dst").alias("to_"))
    for _ in range(hops):
        front = cut(front.join(step, "node").groupBy(F.col("to_").alias("node"), label).agg(F.sum("n").alias("n")))
        if front.isEmpty():
            break
        out = front if out is None else out.unionByName(front)
    return front if out is None else out.groupBy("node", label).agg(F.sum("n").alias("n"))


def flat_fields(bases: DataFrame, fields: DataFrame, depth: int = 100) -> DataFrame:
    """(type, path, ord, offset): fields of a type and, before them, of its bases, with cumulated offsets.

    bases: (type, base, base_offset); fields: (type, ord, offset). path is the depth of the base
    that has the field.
    """
    front = fields.select("type").unionByName(bases.select("type")).unionByName(bases.select(F.col("base").alias("type"))).distinct().select("type", F.col("type").alias("at"), F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("level"))
    out, n = front, 0
    while n < depth:
        n += 1
        up = bases.select(F.col("type").alias("at"), "base", "base_offset")
        front = cut(front.join(by_key(up), "at").select("type", F.col("base").alias("at"), (F.col("shift") + F.col("base_offset")).alias("shift"), F.lit(n).cast("long").alias("level")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    own = fields.withColumnsRenamed({"type": "at"})
    return out.join(by_key(own), "at").select("type", "level", "ord", (F.col("shift") + F.col("offset")).alias("offset"))


def dependencies(nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) of reference nodes that aren't forward declarations."""
    return nodes.filter((F.col("kind") == "reference") & ~F.col("is_forward_declared")).select("src", "dst").distinct()
