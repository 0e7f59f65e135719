"""Connected components of an undirected edge table, by alternating star rounds.

Each round groups edges by one end, takes the smallest neighbour and hangs the others on
it (first the larger neighbours, then the smaller ones).  Both are a map-side combined
``min`` and a join that splits the edges of a hot end over tasks (``even_join``); no
neighbour list is ever gathered.  The rounds end when the edge table repeats itself, about
log(n) of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm.common import even_join, staged


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum((h % 1000003).cast("bigint")), F.bit_xor(h)).first())


def _hung_on_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """The edges (a, b) with ``m``, the smallest b of their a, and the table (a, m) itself."""
    low = staged(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    return even_join(edges, low.drop("n"), "a", "b", low.select("a", "n"), total), low.drop("n")


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (id, component): every id of an edge with the smallest id it reaches."""
    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
               .filter("a <> b").distinct(), "edges")
    seen = _mark(e)
    while seen[0]:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (_hung_on_least(both, 2 * seen[0])[0].filter("b > a")
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        large = staged(large.filter("a <> b").distinct(), "large-star")
        hung, low = _hung_on_least(large, large.count())
        hung = hung.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = staged(hung.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = _mark(e)
        if now == seen:
            break
        seen = now
    return (e.select(F.col("a").alias("id"), F.col("b").alias("component"))
            .unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct())
