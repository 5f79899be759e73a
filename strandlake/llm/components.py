"""Connected components of a link table by repeated contraction; only DataFrames, nothing comes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every end of ``links`` (a, b); root is the least id that links lead to.

    Each round hooks every vertex onto its least neighbour, jumps one step, and contracts the links; a vertex with links
    never stays alone, so the vertices that are left at least halve. Self links and repeated links do no harm.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while True:
        both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("p"))
        up = hook.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        hook = materialize(hook.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "hooks")
        if hook.isEmpty():
            break
        if roots is None:
            roots = hook.select("id", F.col("p").alias("root"))
        else:
            roots = roots.join(hook.select(F.col("id").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        roots = materialize(roots, "roots")
        to_a, to_b = hook.select(F.col("id").alias("a"), F.col("p").alias("pa")), hook.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        edges = edges.where("a <> b").join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = materialize(edges.where("a <> b").distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).where(F.lit(False))
    return roots
