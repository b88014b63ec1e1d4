"""Connected components of a table of edges, on the executors alone."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Each round takes the least label among neighbours and then the label's own
    label, so long chains shrink by jumps.  Both joins read written tables, on
    which Spark splits the rows of a key that many share.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = saved(labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("old")))
        of = step.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        step = saved(step.join(of, "component", "left").select("id", F.least("component", F.coalesce("jump", "component")).alias("component"), "old"))
        labels = step.select("id", "component")
        if step.where("component <> old").isEmpty():
            return labels
