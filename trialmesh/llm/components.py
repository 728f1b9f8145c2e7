"""Connected components of an edge table by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trialmesh.llm.common import remove, store


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(id, component_id) of every node that has an edge (a, b), and the path of the table.

    Each round every node takes its smallest neighbour as parent, parents are replaced by their own parents, and the
    edges between parents go on to the next round; rounds grow with the logarithm of the longest chain.  Aggregates
    combine before they shuffle, joins are equi-joins that adaptive execution can split, so a hub costs no long task.
    Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.where("a <> b").select("a", "b")
    labels, path, old = None, None, []
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
                                              F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e")).select("e.*")
        parents, at = store(both.groupBy("id").agg(F.least("id", F.min("other")).alias("parent")), "parents")
        old.append(at)
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("_top"))
        jumped, at = store(parents.join(up, "parent").select("id", F.col("_top").alias("parent")), "parents")
        old.append(at)
        if labels is None:
            labels, path = jumped.select("id", F.col("parent").alias("component_id")), at
            old.remove(at)
        else:
            step = jumped.select(F.col("id").alias("component_id"), "parent")
            fresh = labels.join(step, "component_id", "left").select("id", F.coalesce("parent", "component_id").alias("component_id"))
            old.append(path)
            labels, path = store(fresh, "labels")
        ends = edges.join(jumped.select(F.col("id").alias("a"), F.col("parent").alias("_a")), "a")
        ends = ends.join(jumped.select(F.col("id").alias("b"), F.col("parent").alias("_b")), "b").where("_a <> _b")
        edges, at = store(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "contracted")
        old.append(at)
        if edges.isEmpty():
            break
    remove(spark, *old)
    return labels, path
