"""Connected components of links by repeated contraction, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import materialize


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (u, v), a written table; the root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers twice and contracts the
    links along them; only links between different roots go on. Links of one node are combined before
    they are shuffled, and joins keep one side unique, so a hub can be split.
    """
    left = links.select("u", "v").where("u <> v")
    steps = []
    while not left.isEmpty():
        both = left.select(F.col("u").alias("node"), F.col("v").alias("near")).union(left.select("v", "u"))
        parent = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("to"))
        for _ in range(2):
            onward = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
            parent = parent.join(onward, "to").select("node", F.col("next").alias("to"))
        parent = materialize(parent)
        steps.append(parent)
        at_u, at_v = (parent.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "uv")
        moved = left.join(at_u, "u").join(at_v, "v").where("to_u <> to_v")
        left = materialize(moved.select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct())
    if not steps:
        return links.select(F.col("u").alias("node"), F.col("u").alias("root")).limit(0)
    out = steps[0].select("node", F.col("to").alias("root"))
    for parent in steps[1:]:
        onward = parent.select(F.col("node").alias("root"), F.col("to").alias("next"))
        out = out.join(onward, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
