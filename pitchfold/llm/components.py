"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b); label is the smallest id of its component.

    Each round takes the smallest label of a node's neighbours and then that
    label's own label (pointer jumping), so chains shorten geometrically. Each
    round is a written table; only whether anything changed reaches the driver.
    Ids are not null; links may repeat, and one of an id with itself adds the id
    alone. No links give no rows.
    """
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    while True:
        seen = both.join(labels, both["b"] == labels["id"]).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        near = labels.join(seen, "id").select("id", "label", F.least("label", "near").alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        labels_next = materialise(near.join(jump, "near").select("id", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")), "labels")
        labels = labels_next.select("id", "label")
        if labels_next.where("moved").isEmpty():
            return labels
