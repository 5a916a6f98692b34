"""Connected components of a table of links, by hooking to the smallest neighbour and contraction.

Each round halves the number of components that still have links at least; pointers are followed
by doubling.  Every table is written, so no plan grows with the rounds, and nothing but counts
comes to the driver.  Joins with the pointers are broadcast while they are few, else shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, bounded


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """links: (a, b), any order, loops allowed.  (id, component) of each vertex that has a link; the component is its smallest id."""
    edges = links.where("a <> b").select("a", "b")
    whole = None
    step = 0
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
        both = edges.select(ends.alias("e")).groupBy("e.id").agg(F.min("e.other").alias("other"))
        parent = scratch.write(both.select("id", F.least("id", "other").alias("component")), f"{name}-p{step}")
        hop = 0
        while True:
            top = bounded(parent.select(F.col("id").alias("component"), F.col("component").alias("top")))
            jumped = scratch.write(parent.join(top, "component").select("id", F.col("top").alias("component"), (F.col("top") < F.col("component")).alias("moved")), f"{name}-p{step}-{hop}")
            parent = jumped.select("id", "component")
            if jumped.where("moved").isEmpty():
                break
            hop += 1
        if whole is None:
            whole = parent
        else:
            above = bounded(parent.select(F.col("id").alias("component"), F.col("component").alias("top")))
            whole = scratch.write(whole.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component")), f"{name}-w{step}")
        a, b = (bounded(parent.select(F.col("id").alias(c), F.col("component").alias(f"r{c}"))) for c in "ab")
        edges = scratch.write(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"{name}-edges{step}")
        if edges.isEmpty():
            return whole
        step += 1
