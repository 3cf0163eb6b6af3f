"""Connected components of a link table, without a node's links or a component ever meeting in one task.

Each round every node hooks onto its smallest smaller neighbour (an aggregate with partial sums), pointers are
doubled until they reach roots, and links are contracted to links between roots. All joins have freshly exchanged
sides, so that adaptive execution can split a hot node or component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that isn't the smallest of its component; component: the smallest node.

    Links with a null end or equal ends count for nothing; an empty table gives an empty result.
    """
    ends = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    edges = written(ends.distinct(), "links")
    label = None
    while True:
        parent = written(edges.groupBy("hi").agg(F.min("lo").alias("lo")), "parents")
        if parent.isEmpty():
            break
        while True:
            up = parent.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
            step = parent.join(up, parent.lo == up.mid, "left").select("hi", F.coalesce("top", "lo").alias("lo"), F.col("top").isNotNull().alias("moved"))
            step = written(step, "parents")
            parent = step.select("hi", "lo")
            if step.where("moved").isEmpty():
                break
        label = parent if label is None else written(_through(label, "lo", parent).unionByName(parent), "labels")
        edges = _through(_through(edges, "hi", parent), "lo", parent)
        edges = written(edges.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "links")
    if label is None:
        label = parent
    return label.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _through(table: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("hi").alias("mid"), F.col("lo").alias("top"))
    return table.join(up, table[column] == up.mid, "left").withColumn(column, F.coalesce("top", column)).drop("mid", "top")
