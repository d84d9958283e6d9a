"""Connected components of a link table by hooking and contraction.

Every round each node hooks to its smallest neighbour, pointers are followed, and the links are
rewritten to what they now connect, once each; at least half of the nodes that still have links
vanish a round. All tables are written, so hub nodes are split by adaptive execution, no round
keeps the lineage of the one before, and only whether links are left reaches the driver.

Defined results: links with a null end or from a node to itself are none; links that repeat count
once; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.scratch import cut

#: Times that pointers are followed before links are rewritten.
JUMPS = 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of edges; root is the smallest node reachable. No edges: no rows."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    links = cut(pairs.select(F.inline(ways)).distinct(), "edges")
    total = None
    while not links.isEmpty():
        hooks = cut(links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "hooks")
        for _ in range(JUMPS):
            far = hooks.select(F.col("u").alias("to"), F.col("to").alias("far"))
            hooks = cut(hooks.join(far, "to").select("u", F.col("far").alias("to")), "hooks")
        if total is None:
            total = hooks.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            total = cut(total.join(hooks.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = links.join(hooks, "u").select(F.col("to").alias("a"), "v")
        right = hooks.select(F.col("u").alias("v"), F.col("to").alias("b"))
        links = cut(left.join(right, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")) if total is None else total
