"""Connected components of a graph given as a table of links, by alternating star operations.

Each pass links every node's larger neighbours to its smallest one, then does the same among smaller neighbours; the number
of passes grows with the logarithm of the longest path. A pass is two aggregates and two joins, and is written to the
shared folder, so nothing is collected and a lost executor costs one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.tables import stored


def _is_star(links: DataFrame) -> bool:
    """Whether every node has one root and no root is itself below another."""
    row = links.groupBy("u").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
    if row["most"] is None:
        return True
    return row["most"] == 1 and links.join(links.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _star_pass(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    roots = large.groupBy("u").agg(F.min("v").alias("m"))
    rest = large.join(roots, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(roots.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """From columns a and b: columns node and root, for every node that is not the smallest of its component.

    Self-links and repeated links change nothing; without links the result is empty; null ends are ignored.
    """
    links = links.filter("a is not null and b is not null and a != b")
    links = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_star(links):
        links = stored(_star_pass(links), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
