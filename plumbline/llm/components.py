"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, split_join


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b); component is the least id reachable.

    Each round takes the least label of the neighbours and then the label of that label, so
    the rounds grow with the logarithm of a chain's length.  Labels are written to the
    shared folder each round; nothing but a count reaches the driver.  The links of a hub are
    split among tasks.  A null id is in no link.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = cut(both.filter("u <> v").distinct(), "edges")
    hubs = hot_keys(edges.groupBy("v").agg(F.count("*").alias("n")), ["v"])
    labels = cut(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("c")).select(F.col("u").alias("id"), "c"), "labels")
    for _ in range(rounds):
        near = split_join(edges, labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), ["v"], hubs, "u").groupBy("u").agg(F.min("cv").alias("m"))
        step = labels.join(near, labels["id"] == near["u"]).select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        made = cut(step.join(up, "c", "left").select("id", "old", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        labels = made.select("id", "c")
        if made.filter("old <> c").isEmpty():
            return labels.withColumnRenamed("c", "component")
    raise RuntimeError("components did not settle")
