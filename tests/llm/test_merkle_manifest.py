"""Merkle trees against a plain construction."""

import hashlib

import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle_manifest as merkle

SCHEMA = "doc_id bigint, source string, text string, node string, path string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes, fanout):
    """The root, and the siblings of every leaf, level by level."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for start in range(0, len(nodes), fanout):
            run = nodes[start : start + fanout]
            for slot in range(len(run)):
                for leaf in under[start + slot]:
                    paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            above.append(digest("".join(run)))
            held.append(sum(under[start : start + fanout], []))
        nodes, under = above, held
    return nodes[0], paths


def plain(rows, fanout):
    groups = {}
    for doc_id, source, text in rows:
        leaf = digest(field(doc_id) + field(source) + field(text))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {source: tree([leaf for *_, leaf in sorted(groups[source])], fanout) for source in order}
    root, tops = tree([built[source][0] for source in order], fanout)
    found = []
    for source, top in zip(order, tops, strict=True):
        subroot, paths = built[source]
        for (known, doc_id, leaf), path in zip(sorted(groups[source]), paths, strict=True):
            found.append((doc_id if known else None, leaf, subroot, root, [*path, *top]))
    return sorted(found, key=repr)


def found(spark, rows, fanout):
    df = spark.createDataFrame([(*row, "x", "y") for row in rows], SCHEMA)
    leaf = merkle.digest(merkle.encoded(F.col("doc_id"), F.col("source"), F.col("text")))
    result = merkle.manifest(df, leaf, F.col("source"), F.col("doc_id"), {"doc_id": F.col("doc_id")}, fanout)
    checked = result.withColumn("folded", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert all(row["folded"] == row["root"] for row in checked)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]]) for r in checked), key=repr)


@pytest.mark.parametrize("fanout", [3, 2])
def test_against_plain_trees(spark, fanout):
    rows = [(i * 7 % 101, "hot", f"text {i}") for i in range(101)]
    rows += [(i, f"s{i % 4}", None if i % 5 == 0 else "é" * i) for i in range(20)]
    rows += [(None, None, "a"), (None, None, "a"), (None, "", None), (3, "", ""), (3, "", ""), (5, "lone", "t"), (6, "=", "t")]
    assert found(spark, rows, fanout) == plain(rows, fanout)


def test_one_row_one_group_and_none(spark):
    assert found(spark, [(1, None, None)], 3) == plain([(1, None, None)], 3)
    rows = [(i, "only", "t") for i in range(4)]
    assert found(spark, rows, 3) == plain(rows, 3)
    assert found(spark, [], 3) == []


def test_altered_rows_do_not_verify(spark):
    df = spark.createDataFrame([(i, "s", f"a\n{i}") for i in range(5)], "doc_id bigint, source string, text string")

    def leaf(text):
        return merkle.digest(merkle.encoded(F.col("doc_id"), text))

    kept = {"doc_id": F.col("doc_id"), "offered": leaf(F.when(F.col("doc_id") > 2, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))}
    result = merkle.manifest(df, leaf(F.col("text")), F.col("source"), F.col("doc_id"), kept)
    same = result.select("doc_id", (merkle.folded(F.col("offered"), F.col("path")) == F.col("root")).alias("same")).collect()
    assert {row["doc_id"]: row["same"] for row in same} == {0: True, 1: True, 2: True, 3: False, 4: False}
