"""Exact nearest neighbours of stated query rows, as a block matrix join with int8 product tiles.

Queries and candidates are dealt over the cells of a grid: groups of queries along one side, slices of candidates along the
other. A query goes to every slice of its group and a candidate to every group, so each pair meets in one cell. Groups hold
a bounded number of bytes, since a task keeps a whole group in memory while the candidates of the cell stream past it in tiles.

In a tile each vector is given as int8 codes times a scale, with the length of what the codes leave out. The product of the
code matrices (whole numbers below 2**24 in float32, so exact) gives the distance of the coded vectors, and by the triangle inequality
the true distance differs from it by at most the two lengths left out. Pairs whose lower bound exceeds the k-th distance a
query has seen, or the k-th upper bound in the tile, are passed over; those that survive are recomputed from the original
vectors in double precision, component after component, and merged into the query's heap of k nearest. Cells then send k rows
a query, and a ranking over these gives the result. Nothing is approximate: the bounds only save work.

Cases: vectors that are null, empty, all zero or hold a null or non-finite component take no part, neither as queries nor as
candidates; vectors of different lengths are never compared; ties go to the smaller id, a null id last; a row is never its own
neighbour, but a repeated row or a row of the same id is; each of several query rows of one id has its own list; of equal vectors in
a tile only the k + 1 with the least ids are compared, as no other can be among the k nearest; a distance too large for a double
is infinite and ranks last; without queries or candidates the result is empty; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.tables import arrow_map, stored

GROUP_BYTES = 64 << 20
SLICE_BYTES = 256 << 20
TILE = 4096
_QUERIES_AT_ONCE = 512
_PAIRS_AT_ONCE = 1 << 15
# Sums of this many products of two int8 codes stay below 2**24.
_EXACT_PRODUCTS = 1024


def _coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, squared lengths of the coded vectors, and lengths of what the codes leave out."""
    exact = vectors.astype(np.float64)
    scales = np.abs(exact).max(axis=1) / 127
    with np.errstate(all="ignore"):
        codes = np.nan_to_num(np.clip(np.rint(exact / scales[:, None]), -127, 127))
        squares = (codes * codes).sum(axis=1) * scales * scales
        left_out = np.sqrt(((exact - codes * scales[:, None]) ** 2).sum(axis=1))
        left_out = left_out * (1 + 1e-9) + 1e-12 * np.sqrt(squares)
    return codes.astype(np.int8), scales, squares, left_out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    total = np.zeros((len(left), len(right)))
    for start in range(0, left.shape[1], _EXACT_PRODUCTS):
        part = slice(start, start + _EXACT_PRODUCTS)
        total += left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T
    return total


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, summed from the first component to the last."""
    gaps = left.astype(np.float64) - right.astype(np.float64)
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum(gaps * gaps, axis=1)[:, -1])


class _Rows:
    """Ids, row numbers and vectors of some rows; a missing id comes after all others."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, numbers: np.ndarray, vectors: np.ndarray):
        self.ids, self.missing, self.numbers, self.vectors = ids, missing, numbers, vectors

    def take(self, places) -> _Rows:
        return _Rows(self.ids[places], self.missing[places], self.numbers[places], self.vectors[places])

    @staticmethod
    def joined(parts: list[_Rows]) -> _Rows:
        return _Rows(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("ids", "missing", "numbers", "vectors")))

    def without_far_copies(self, most: int) -> _Rows:
        """Of rows with equal vectors, those with the `most` least ids."""
        keys = np.ascontiguousarray(self.vectors).view(np.dtype((np.void, self.vectors.dtype.itemsize * self.vectors.shape[1])))
        _, groups, sizes = np.unique(keys.ravel(), return_inverse=True, return_counts=True)
        if not len(sizes) or sizes.max() <= most:
            return self
        order = np.lexsort((self.numbers, self.ids, self.missing, groups))
        firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return self.take(order[np.arange(len(order)) - firsts[groups[order]] < most])


class _Heaps:
    """The k nearest candidates that each query has seen."""

    def __init__(self, queries: _Rows, k: int):
        self.queries, self.k = queries, k
        self.codes, self.scales, self.squares, self.left_out = _coded(queries.vectors)
        shape = (len(queries.ids), k)
        self.distances, self.ids = np.full(shape, np.inf), np.zeros(shape, dtype=np.int64)
        self.missing, self.numbers = np.zeros(shape, dtype=bool), np.full(shape, -1, dtype=np.int64)

    def meet(self, candidates: _Rows) -> None:
        candidates = candidates.without_far_copies(self.k + 1)
        coded = _coded(candidates.vectors)
        for start in range(0, len(self.queries.ids), _QUERIES_AT_ONCE):
            self._tile(slice(start, start + _QUERIES_AT_ONCE), candidates, coded)

    def _tile(self, part: slice, candidates: _Rows, coded) -> None:
        codes, scales, squares, left_out = coded
        with np.errstate(all="ignore"):
            sums = self.squares[part][:, None] + squares
            near = sums - 2 * (self.scales[part][:, None] * scales) * _products(self.codes[part], codes)
            slack, reach = 1e-12 * sums, self.left_out[part][:, None] + left_out
            lower = np.sqrt(np.maximum(near - slack, 0)) - reach
            _, own, same = np.intersect1d(self.queries.numbers[part], candidates.numbers, return_indices=True)
            limits = self.distances[part][:, -1].copy()
            if np.isinf(limits).any() and len(candidates.ids) > self.k:
                upper = np.sqrt(np.maximum(near, 0) + slack) + reach
                upper[own, same] = np.inf
                limits = np.fmin(limits, np.partition(upper, self.k - 1, axis=1)[:, self.k - 1])
            # Written so that a bound that is not a number never drops a pair.
            survives = ~(lower > limits[:, None])
        survives[own, same] = False
        queries, others = np.nonzero(survives)
        for start in range(0, len(queries), _PAIRS_AT_ONCE):
            at, other = queries[start : start + _PAIRS_AT_ONCE] + part.start, others[start : start + _PAIRS_AT_ONCE]
            distances = _distances(self.queries.vectors[at], candidates.vectors[other])
            close = (distances <= self.distances[at, -1]) | (self.numbers[at, -1] < 0)
            self._merge(at[close], distances[close], candidates.take(other[close]))

    def _merge(self, at: np.ndarray, distances: np.ndarray, found: _Rows) -> None:
        if not len(at):
            return
        touched = np.unique(at)
        owner = np.concatenate([np.repeat(touched, self.k), at])
        held = [np.concatenate([own[touched].ravel(), new]) for own, new in (
            (self.distances, distances), (self.missing, found.missing), (self.ids, found.ids), (self.numbers, found.numbers))]
        far, missing, ids, numbers = held
        order = np.lexsort((numbers, ids, missing, far, numbers < 0, owner))
        first = np.searchsorted(owner[order], touched)
        chosen = order[(first[:, None] + np.arange(self.k)).ravel()]
        shape = (len(touched), self.k)
        self.distances[touched], self.missing[touched] = far[chosen].reshape(shape), missing[chosen].reshape(shape)
        self.ids[touched], self.numbers[touched] = ids[chosen].reshape(shape), numbers[chosen].reshape(shape)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        at, place = np.nonzero(self.numbers >= 0)
        columns = [
            pa.array(self.queries.numbers[at]), pa.array(self.queries.ids[at], mask=self.queries.missing[at]),
            pa.array(self.ids[at, place], mask=self.missing[at, place]), pa.array(self.numbers[at, place]),
            pa.array(self.distances[at, place]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


_FOUND = "query_number bigint, query_id bigint, vec_id bigint, vec_number bigint, score double"


def _read(batch: pa.RecordBatch, dims: int) -> _Rows:
    ids = batch.column("id")
    vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
    return _Rows(
        ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("number").to_numpy(), vectors)


def _nearest_in_cells(batches, k: int, tile: int):
    """Read cell after cell, the queries of each before its candidates, and emit the k nearest of every query."""
    schema = pa.schema([("query_number", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()),
                        ("vec_number", pa.int64()), ("score", pa.float64())])
    cell, waiting, heaps = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(name).to_numpy() for name in ("dims", "part", "slice", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            *key, side = keys[start].tolist()
            if key != cell:
                if heaps is not None:
                    yield heaps.rows(schema)
                cell, waiting, heaps = key, [], None
            rows = _read(batch.slice(start, stop - start), key[0])
            if side == 0:
                waiting.append(rows)
            elif heaps is None and waiting:
                heaps = _Heaps(_Rows.joined(waiting), k)
            if side == 1 and heaps is not None:
                for first in range(0, len(rows.ids), tile):
                    heaps.meet(rows.take(slice(first, first + tile)))
    if heaps is not None:
        yield heaps.rows(schema)


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding",
    group_bytes: int = GROUP_BYTES, slice_bytes: int = SLICE_BYTES, tile: int = TILE,
) -> DataFrame:
    """The k nearest rows of every query row: query_id, rank from 1, vec_id, score (the Euclidean distance)."""
    spark = df.sparkSession
    rows = stored(
        df.filter(usable(df[vector_column])).select(
            df[id_column].cast("bigint").alias("id"), df[vector_column].alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("number"),
        ),
        "vectors",
    ).withColumn("dims", F.size("vector"))
    size = F.col("dims").cast("bigint") * 8
    asked, held, count = rows.agg(
        F.coalesce(F.sum(F.when(F.col("asks"), size)), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    groups = max(1, math.ceil(asked / group_bytes))
    # Every cell sends k rows a query, so slices of less than a tile would add rows and save nothing.
    busy = min(math.ceil(2 * int(spark.conf.get("spark.sql.shuffle.partitions")) / groups), math.ceil(count / tile))
    slices = max(1, busy, math.ceil(held / slice_bytes))

    def dealt(count: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    columns = ("dims", "part", "slice", "side", "id", "number", "vector")
    queries = rows.filter("asks").withColumns({"part": dealt(groups, 1), "side": F.lit(0)}).withColumn("slice", every(slices))
    others = rows.withColumns({"slice": dealt(slices, 2), "side": F.lit(1)}).withColumn("part", every(groups))
    cells = queries.select(*columns).union(others.select(*columns)).repartition("dims", "part", "slice")
    found = arrow_map(cells.sortWithinPartitions("dims", "part", "slice", "side"), _nearest_in_cells, _FOUND, k=k, tile=tile)
    order = Window.partitionBy("query_number").orderBy("score", F.col("vec_id").asc_nulls_last(), "vec_number")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
