"""A Merkle tree over the rows of a dataset: one subtree a group, one root, and a proof for every row.

Rows are leaves, numbered within their group in a given order. A level is built by a slot pivot: grouped by the parent's number,
conditional aggregates spread the children over `fanout` columns, and the parent is the hash of these columns joined. The
same columns give the siblings: leave out the own slot. Groups' roots are the leaves of one more tree, in order of the group.
Levels are written once (each a third of the one below) and then read from the root downwards: a parent's path, extended by
the siblings of a slot, becomes the path of the child in that slot, so a row never meets more than one parent.

Numbers come from a range sort and counts of ranges, and a row finds its group's size by group and block of numbers, so a group
with a third of all rows is spread over many tasks everywhere. Nothing but the counts of ranges and one maximum reaches the driver.

Cases: a null field is `-` in a leaf and a null group comes first; rows with equal order keys are ordered by leaf, and those with
equal leaves are interchangeable; a group of one row has its leaf as subroot and no siblings; a single group's subroot is the
root; the last run of a level may hold fewer nodes, even one, and is hashed all the same; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.sharding import numbered
from parlance.llm.tables import stored

FANOUT = 3
_BLOCK_ROWS = 10_000


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(*fields: Column) -> Column:
    """Fields joined so that no two different rows give one text: byte count, colon, value; `-` for null."""
    def one(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*(one(field) for field in fields))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def path_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def _levels(count: int, fanout: int) -> int:
    levels = 0
    while count > 1:
        count, levels = -(-count // fanout), levels + 1
    return levels


def _grow(nodes: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """Levels of parents over nodes (tree, place, size, node, carried): the pivoted children of each, with its own hash."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    grown: list[DataFrame] = []
    for level in range(_levels(most, fanout)):
        slots = [F.when(F.col("place") % fanout == slot, F.col("node")) for slot in range(fanout)]
        kept = [F.when(slot.isNotNull(), F.col("carried")) for slot in slots] if level == 0 else []
        children = [f"node_{slot}" for slot in range(fanout)]
        parents = nodes.filter("size > 1").groupBy("tree", F.expr(f"place div {fanout}").alias("place")).agg(
            F.ceil(F.max("size") / fanout).alias("size"),
            *(F.max(slot).alias(child) for slot, child in zip(slots, children, strict=True)),
            *(F.first(held, ignorenulls=True).alias(f"carried_{slot}") for slot, held in enumerate(kept)),
        )
        grown.append(stored(parents.withColumn("node", digest(F.concat_ws("", *children))), f"{name}-{level}"))
        nodes = grown[-1].select("tree", "place", "size", "node")
    return grown


def _roots(nodes: DataFrame, grown: list[DataFrame]) -> DataFrame:
    """The one node that remains of every tree, and the number of levels below it."""
    parts = [
        level.filter("size = 1").select("tree", "node", F.lit(height).alias("height"))
        for height, level in enumerate([nodes, *grown])
    ]
    return reduce(DataFrame.union, parts)


def _descend(nodes: DataFrame, grown: list[DataFrame], tops: DataFrame, fanout: int, facts: tuple[str, ...]) -> DataFrame:
    """From the paths and facts of the roots (tree, height, path, ...) to those of the leaves, with what they carry."""
    known = ("tree", "place", "path", *facts)
    above = None
    for level in reversed(range(len(grown))):
        here = tops.filter(F.col("height") == level + 1).withColumn("place", F.lit(0).cast("bigint")).select(*known)
        above = here if above is None else above.select(*known).union(here)
        children = [F.col(f"node_{slot}") for slot in range(fanout)]
        options = []
        for slot, child in enumerate(children):
            siblings = F.struct(
                F.concat_ws("", *children[:slot]).alias("left"), F.concat_ws("", *children[slot + 1 :]).alias("right"))
            held = [F.col(f"carried_{slot}").alias("carried")] if level == 0 else []
            options.append(F.struct(
                (F.col("place") * fanout + slot).alias("place"), child.alias("node"),
                F.concat(F.array(siblings), F.col("path")).alias("path"), *held))
        met = grown[level].join(above, ["tree", "place"])
        below = met.select("tree", *facts, F.explode(F.array(*options)).alias("child")).filter("child.node is not null")
        above = below.select("tree", "child.*", *facts)
    lone = nodes.filter("size = 1").join(tops.filter("height = 0").select("tree", "path", *facts), "tree")
    columns = ("carried", "node", "path", *facts)
    return lone.select(*columns) if above is None else above.select(*columns).union(lone.select(*columns))


def _placed(slim: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place in their tree and its size."""
    rows = numbered(slim, [F.col("tree"), *(F.col(name).asc_nulls_first() for name in order)])
    rows = rows.withColumn("block", F.expr(f"row_number div {_BLOCK_ROWS}"))
    counts = rows.groupBy("tree", "block").agg(F.count("*").alias("n"), F.min("row_number").alias("first"))
    trees = counts.groupBy("tree").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    sizes = counts.select("tree", "block").join(trees, "tree")
    return rows.join(sizes, ["tree", "block"]).withColumn("place", F.col("row_number") - F.col("first"))


def manifest(
    df: DataFrame, leaf: Column, group: Column, order: Column, carried: dict[str, Column], fanout: int = FANOUT
) -> DataFrame:
    """One row per row: the carried columns, leaf, subroot, root and path, an array of the siblings left and right of each node."""
    # A text that sorts as the group does, with a null group before all others.
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    slim = stored(
        df.select(
            tree.alias("tree"), order.alias("key"), leaf.alias("node"),
            F.struct(*(column.alias(name) for name, column in carried.items())).alias("carried"),
            F.monotonically_increasing_id().alias("copy"),
        ),
        "leaves",
    )
    nodes = _placed(slim, ["key", "node", "copy"]).select("tree", "place", "size", "node", "carried")
    grown = _grow(nodes, fanout, "tree-level")
    subroots = stored(_roots(nodes, grown), "subroots")
    heads = numbered(subroots, [F.col("tree")]).select(
        F.lit("").alias("tree"), F.col("row_number").alias("place"), F.lit(subroots.count()).alias("size"), "node",
        F.struct("tree", "height").alias("carried"),
    )
    crown = _grow(heads, fanout, "crown-level")
    root = _roots(heads, crown).select(
        "tree", "height", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("node").alias("root"))
    tops = _descend(heads, crown, root, fanout, ("root",)).select("carried.*", "path", F.col("node").alias("subroot"), "root")
    tops = stored(tops, "paths-of-subroots")
    found = _descend(nodes, grown, tops, fanout, ("subroot", "root"))
    return found.select("carried.*", F.col("node").alias("leaf"), "subroot", "root", "path")
