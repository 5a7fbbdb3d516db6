"""Connected components of a link table by label propagation with pointer jumping.

Each round is a few joins and partial aggregations; labels are written to the shared folder
after each round, so neither lineage nor driver memory grows with the number of links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.llm.shared import saved


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of links(a, b); label is the smallest id that can be reached."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        one = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = saved(one.join(jump, "label").select("id", "old", F.least("label", "far").alias("label")), "labels")
        if new.where("label != old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")
