"""Connected components of an edge list by repeated contraction.

In each round every node points to the smallest of itself and its neighbours, pointers are followed once more, and
the edges are renamed by them; loops and repeats go. Long paths shrink by a factor each round, so the rounds grow with
the logarithm of the longest path. Each round is written to the shared folder. Only counts reach the driver.

Edges with a null end are ignored. No edges give no rows: a node without an edge is its own component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); the component is its smallest node."""
    spark = edges.sparkSession
    open_edges = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = open_edges.select(F.col("a").alias("node")).union(open_edges.select(F.col("b").alias("node"))).distinct()
    steps = []
    while not open_edges.isEmpty():
        both = open_edges.union(open_edges.select("b", "a"))
        first = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).where("m < n")
        first = materialise(first, "pointers")
        second = first.alias("x").join(first.select(F.col("n").alias("k"), F.col("m").alias("mm")), F.col("m") == F.col("k"), "left")
        pointer = materialise(second.select("n", F.coalesce("mm", "m").alias("m")), "pointers")
        steps.append(pointer)
        renamed = open_edges
        for end in ("a", "b"):
            p = pointer.select(F.col("n").alias(end), F.col("m").alias("to"))
            renamed = renamed.join(p, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        open_edges = materialise(renamed.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = nodes.withColumn("component", F.col("node"))
    for pointer in steps:
        found = found.join(pointer.withColumnRenamed("n", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return found if steps else spark.createDataFrame([], "node long, component long")
