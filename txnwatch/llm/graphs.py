"""Connected components by smallest label, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node reachable, for every node of an edge.

    Each round takes the smallest of a node's label, its neighbours' labels and
    the label of its label, so long chains halve. Labels are written to the
    checkpoint folder each round; only whether any changed reaches the driver.
    Messages to a hub are combined before the shuffle, and a hub's edges are
    spread by skew joins.
    """
    one = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("label"), F.lit(True).alias("moved")).checkpoint()
    while labels.where("moved").limit(1).count():
        labels = labels.select("node", "label")
        heard = both.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "label")
        jumps = labels.withColumnsRenamed({"node": "own", "label": "node"}).join(labels, "node").select(F.col("own").alias("node"), "label")
        own = labels.withColumn("old", F.col("label"))
        news = own.unionByName(heard, allowMissingColumns=True).unionByName(jumps, allowMissingColumns=True)
        news = news.groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        labels = news.select("node", "label", (F.col("label") < F.col("old")).alias("moved")).checkpoint()
        del heard, jumps, own, news
        release(edges.sparkSession)
    return labels.select("node", "label")


def merged(labels: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """Labels after more links (a, b): only the labels that the links connect are looked at."""
    one, other = (labels.toDF(c, f"label_{c}") for c in "ab")
    between = (
        links.join(one, "a", "left")
        .join(other, "b", "left")
        .select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    )
    moved = components(between).toDF("label", "further")
    known = labels.join(moved, "label", "left").select(node, F.coalesce("further", "label").alias("label"))
    new = links.select(F.col("a").alias(node)).union(links.select("b")).distinct().join(labels, node, "left_anti")
    new = new.join(moved.toDF(node, "label"), node)
    return known.unionByName(new).checkpoint()
