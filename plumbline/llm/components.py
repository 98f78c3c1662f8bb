"""Connected components of links between ids, by min-hooking and pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _jumped(parent: DataFrame) -> DataFrame:
    """Of parents at most as large as their children, the roots: (node, label)."""
    while True:
        up = parent.select(F.col("node").alias("label"), F.col("label").alias("next"))
        # a label that is no node is a root
        further = staged(parent.join(up, "label", "left").select("node", F.coalesce("next", "label").alias("label"), (F.col("next") < F.col("label")).alias("moved")), "jump")
        parent = further.select("node", "label")
        if further.filter("moved").isEmpty():
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every id in links (u, v): the smallest id of its component.

    Each round hooks an id to its smallest neighbour and jumps to the root, which at least
    halves the ids that still have links between different labels.
    """
    edges = staged(links.select("u", "v").filter("u <> v").distinct(), "edges")
    labels: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label"))
        roots = _jumped(staged(hooks, "hooks"))
        if labels is None:
            labels = roots
        else:
            labels = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = staged(labels, "labels")
        to = lambda side: roots.select(F.col("node").alias(side), F.col("label").alias(f"{side}_root"))
        edges = staged(edges.join(to("u"), "u").join(to("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).filter("u <> v").distinct(), "edges")
        if edges.isEmpty():
            return labels
