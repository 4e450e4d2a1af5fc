"""Connected components of a graph of links, by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textkiln.llm.common import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links (u, v) lead to; nodes without links have no row.

    Each round a node takes the smallest label around it, then its label's label, so a path shrinks by a factor each
    round. Labels are written each round; the links are not collected.
    """
    edges = materialise(links.select("u", "v").union(links.select("v", "u")).filter("u <> v").distinct(), "edges")
    labels = last = materialise(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("least"))
        new = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        to = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = new.join(to, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp"))
        new = materialise(new, "labels")
        discard(last)
        labels, last = new.select("node", "comp"), new
        if new.filter("comp <> old").isEmpty():
            discard(edges)
            return labels
