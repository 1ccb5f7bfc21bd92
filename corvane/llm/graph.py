"""Connected components of a link table by repeated contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of `links` (a, b).

    Each round every node points to its smallest neighbour (or itself), pointers are followed to the roots, and links
    between roots go on to the next round; the number of roots with links at least halves each round. A round's tables are
    deleted when the next one has been written.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = materialise(both.distinct(), "links")
    found = None
    while found is None or not edges.isEmpty():
        roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"))
        before = None
        while True:
            roots = materialise(roots, "roots")
            if before is not None:
                discard(before)
            before = roots
            up = roots.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            further = roots.join(up, "comp").select("node", "comp", "next")
            if further.where("next <> comp").isEmpty():
                break
            roots = further.select("node", F.col("next").alias("comp"))
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            further = materialise(found.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "components")
            discard(found)
            found = further
        to_a, to_b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
        further = materialise(edges.join(to_a, "a").join(to_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b").distinct(), "links")
        discard(edges, *([roots] if roots is not found else []))
        edges = further
    return found
