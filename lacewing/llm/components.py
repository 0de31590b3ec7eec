"""Connected components by alternating large and small stars; everything stays in tables of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.llm.common import checked_join, cut


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest of its neighbours and itself."""
    both = edges.selectExpr("lo as u", "hi as v").unionByName(edges.selectExpr("hi as u", "lo as v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return checked_join(both.where("v > u"), least, ["u"], "inner").selectExpr("m as lo", "v as hi").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = checked_join(edges, least, ["hi"], "inner")
    return joined.selectExpr("m as lo", "lo as hi").where("lo < hi").unionByName(joined.selectExpr("m as lo", "hi")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of the edges (a, b), root being the smallest node that it reaches.

    Loops, null ends, repeated edges and an empty table are allowed; a node whose only edges are loops has no row. The number of rounds
    grows with the logarithm of the longest path. A node's neighbours are never brought together: only minima are aggregated, and a
    node with very many neighbours is joined by broadcast or split by adaptive execution.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(lo, hi).where("lo < hi").distinct())
    sign = _sign(now)
    while sign[0]:
        now = cut(_small(cut(_large(now))))
        before, sign = sign, _sign(now)
        if sign == before:
            break
    return now.selectExpr("hi as node", "lo as root").unionByName(now.selectExpr("lo as node", "lo as root").distinct())


def joined(roots: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) as of components() when edges (a, b) are added to those that gave roots: only the roots that they link are gone through again."""
    own = lambda c, to: edges_now.join(roots.withColumnRenamed("node", c).withColumnRenamed("root", to), c, "left").withColumn(to, F.coalesce(to, c))
    edges_now = edges.select(a, b)
    edges_now = own(a, "_ra")
    edges_now = own(b, "_rb")
    apart = cut(edges_now.where("_ra <> _rb").select("_ra", "_rb").distinct())
    merged = cut(components(apart, "_ra", "_rb").selectExpr("node as root", "root as _top"))
    moved = roots.join(merged, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return cut(moved.unionByName(merged.selectExpr("root as node", "_top as root").join(roots, "node", "left_anti")))
