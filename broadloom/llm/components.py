"""Connected components of links by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.common import sorted_join
from broadloom.session import discard, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that each node of ``links`` reaches.

    Each round takes the smallest label among a node's neighbours, an aggregate that combines before its exchange,
    and then the label of that label, so long chains shorten by halves. Rounds are written to the shared folder, where
    a round replaces the one before; it ends when a round changes nothing. Links to null are left out.
    """
    both = links.where(f"{a} is not null and {b} is not null and {a} != {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = stage(both.union(both.select("v", "u")).distinct(), "links")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        labels_now = labels.select("node", "component")
        near = sorted_join(both, labels_now, both["v"] == labels_now["node"]).groupBy("u").agg(F.min("component").alias("m"))
        stepped = sorted_join(labels_now, near, labels_now["node"] == near["u"]).select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        stepped = stage(stepped, "labels-near")
        jump = stepped.select(F.col("node").alias("at"), F.col("c").alias("jumped"))
        new = sorted_join(stepped, jump, stepped["c"] == jump["at"]).select("node", "was", F.least("c", "jumped").alias("component"))
        new = stage(new, "labels")
        discard(labels, stepped)
        if new.where("component != was").isEmpty():
            discard(both)
            return new.select("node", "component")
        labels = new
