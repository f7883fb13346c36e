"""Connected components by hooking and pointer jumping, fully distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import remove, salted_join, stored

MAX_ROUNDS = 64


def _starred(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each ``dst`` goes to its smallest ``src``, as do its other ones.

    Nodes that share a few hubs leave one edge each, and one for two hubs that they share.
    """
    first = edges.groupBy("dst").agg(F.min("src").alias("m"))
    x = salted_join(edges.select("src", "dst"), first, "dst", "src")
    return x.select(F.col("m").alias("src"), "dst").union(x.select("m", F.col("src").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``src, dst`` (any orderable type) -> ``node, component`` for nodes with an edge.

    A component is named by its smallest node.  An edge leads from its larger node to its
    smaller one, and a node that is no edge's larger one to itself.  In each round a node
    goes on to where the smallest node that it leads to leads to at least; so does any other
    node that it led to, in its stead.  Rounds grow with the logarithm of the diameter,
    however nodes are named, edges never become more, and the loop ends when each node leads
    to one alone, which leads to itself.  Each round is stored.  Self loops and
    repeated edges do no harm.  A hub's edges and the nodes below one node are spread over
    tasks in the joins; minima and repeats are combined before they are shuffled.
    """
    low = F.least("src", "dst")
    ends = F.array(F.struct(F.greatest("src", "dst").alias("node"), low.alias("to")), F.struct(low.alias("node"), low.alias("to")))
    rows, path = stored(_starred(edges).select(F.explode(ends).alias("x")).select("x.*").distinct(), "components")
    for _ in range(MAX_ROUNDS):
        first = rows.groupBy("node").agg(F.min("to").alias("m"))
        jump = salted_join(first, first.select(F.col("node").alias("m"), F.col("m").alias("far")), "m", "node")
        x = salted_join(rows, jump, "node", "to").filter((F.col("to") == F.col("m")) | (F.col("to") != F.col("node")))
        goes = F.when(F.col("to") == F.col("m"), F.col("node")).otherwise(F.col("to"))
        moved = (F.col("to") != F.col("m")) | (F.col("far") != F.col("m"))
        last = path
        rows, path = stored(x.select(goes.alias("node"), F.col("far").alias("to"), moved.alias("moved")).distinct(), "components")
        remove(edges.sparkSession, last)
        if rows.filter("moved").isEmpty():
            return rows.select("node", F.col("to").alias("component"))
        rows = rows.select("node", "to")
    raise RuntimeError("components did not settle")
