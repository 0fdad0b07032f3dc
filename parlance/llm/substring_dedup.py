"""Removal of word runs that also occur elsewhere, by suffix automata of reference shards.

A run of `min_words` words is removed wherever its sequence also starts at another place, in the same text or another one.
Comparing every text with an automaton of the whole corpus would cost texts times shards, so the reference is cut by content:

1. Winnowing picks an anchor in every window of `min_words` words, the rightmost least hash of its k-grams. Windows with
   the same anchor are a region; each window lies in exactly one region, and equal windows have equal anchors.
2. An anchor that occurs once holds no repeated window. One whose regions are all equal holds only repeated windows.
3. The distinct regions of any other anchor form a reference shard. Tasks build a suffix automaton of each shard, with the
   number of places every state occurs at, and stream the shard's regions through it: where the longest suffix that
   occurs twice or more reaches `min_words`, the window that ends there is repeated.
4. A shard of more than `shard_regions` distinct regions is cut further, into a shard for each distinct window, whose
   automaton has one path; counting its places before the shuffle is then all it takes. So no group grows with the corpus.
5. Marks go back to the texts, and every word under a marked window is removed.

Cases: a null text has no words; a text shorter than a window keeps all; identical rows repeat each other's windows; rows
that share an id but not the text are told apart by a checksum; null ids form ids of their own kind; an empty table gives an
empty result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels
from parlance.llm.tables import arrow_map, filtered_scans, stored

ANCHOR_WORDS = 8
SHARD_REGIONS = 512
_LOW = np.uint64(0xFFFFFFFF)


class Anchors:
    """Anchors of a block of texts: for each, its position and the windows that chose it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int, anchor_words: int):
        self.words = kernels.find_words(data, offsets)
        bounds = self.words.offsets
        self.spans = kernels.Spans(kernels.word_hashes(data, self.words), kernels.WORD_BASE)
        grams = kernels.window_starts(bounds, anchor_words)
        hashes = np.zeros(int(bounds[-1]), dtype=np.uint64)
        hashes[grams] = self.spans.of(grams, grams + anchor_words)
        ranked = np.full(len(hashes), ~np.uint64(0))
        ranked[grams] = (hashes[grams] & ~_LOW) | (_LOW - grams.astype(np.uint64))
        windows = kernels.window_starts(bounds, min_words)
        least = kernels.sliding_minimum(ranked, min_words - anchor_words + 1)
        chosen = (_LOW - (least[windows] & _LOW)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])) if len(chosen) else chosen
        self.first = windows[begins]
        self.count = np.diff(np.append(begins, len(chosen)))
        self.anchor = hashes[chosen[begins]]
        self.region = self.spans.of(self.first, self.first + self.count - 1 + min_words)
        self.row = np.searchsorted(bounds, self.first, side="right") - 1


def _occurrences(batches, min_words: int, anchor_words: int):
    for batch in batches:
        for block in kernels.blocks(batch.column(2)):
            found = Anchors(block.data, block.offsets, min_words, anchor_words)
            rows = pa.array(found.row + block.first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array((found.first - found.words.offsets[found.row]).astype(np.int32)),
                    pa.array(found.count.astype(np.int16)), pa.array(found.anchor.view(np.int64)),
                    pa.array(found.region.view(np.int64)),
                ],
                ["id", "version", "first", "count", "anchor", "region"],
            )


def _contents(batches, min_words: int):
    """Word hashes of sampled regions; a hot region is cut into its windows."""
    names = ["shard", "anchor", "region", "window", "copies", "words"]
    for batch in batches:
        for block in kernels.blocks(batch.column(0)):
            words = kernels.find_words(block.data, block.offsets)
            hashes = kernels.word_hashes(block.data, words)
            spans = kernels.Spans(hashes, kernels.WORD_BASE)
            out: list[list] = [[] for _ in names]
            for row in range(block.rows):
                base = int(words.offsets[row])
                for item in batch.column(1)[block.first + row].as_py():
                    first, count = base + item["first"], item["count"]
                    pieces = [(item["anchor"], first, count, -1)]
                    if item["hot"]:
                        starts = np.arange(first, first + count)
                        keys = spans.of(starts, starts + min_words).view(np.int64).tolist()
                        pieces = [(key, first + j, 1, j) for j, key in enumerate(keys)]
                    for shard, start, windows, window in pieces:
                        values = (shard, item["anchor"], item["region"], window, item["copies"],
                                  hashes[start : start + windows - 1 + min_words].tobytes())
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


class SuffixAutomaton:
    """Suffix automaton of several sequences; `places` counts the positions at which a state's strings end."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.places.append(0)
        return len(self.next) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of the target for the shorter strings that end with this symbol after this state."""
        follow, link, length = self.next, self.link, self.length
        copy = self._state(length[state] + 1, dict(follow[target]), link[target])
        link[target] = copy
        while state >= 0 and follow[state].get(symbol) == target:
            follow[state][symbol] = copy
            state = link[state]
        return copy

    def add(self, sequence: list[int], copies: int) -> None:
        """Add a sequence that occurs at so many places."""
        follow, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            known = follow[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, symbol, known)
            else:
                made, state = self._state(length[last] + 1, {}, 0), last
                while state >= 0 and symbol not in follow[state]:
                    follow[state][symbol] = made
                    state = link[state]
                if state >= 0:
                    target = follow[state][symbol]
                    link[made] = target if length[target] == length[state] + 1 else self._split(state, symbol, target)
                last = made
            self.places[last] += copies

    def finish(self, least_places: int) -> None:
        """Sum places up the links, and find for each state its longest suffix that occurs often enough."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0:
                self.places[self.link[state]] += self.places[state]
        self.frequent = [0] * len(self.next)
        for state in order:
            enough = self.places[state] >= least_places
            self.frequent[state] = self.length[state] if enough else self.frequent[self.link[state]]

    def statistics(self, sequence: list[int]) -> list[int]:
        """For each position of an added sequence, the length of the longest frequent string that ends there."""
        state, found = 0, []
        for symbol in sequence:
            state = self.next[state][symbol]
            found.append(self.frequent[state])
        return found


def repeated_windows(regions: list[tuple[list[int], int]], min_words: int) -> list[int]:
    """Bit masks: which windows of each region occur at two places or more, given each region and its copies."""
    automaton = SuffixAutomaton()
    for words, copies in regions:
        automaton.add(words, copies)
    automaton.finish(2)
    masks = []
    for words, _ in regions:
        reached = automaton.statistics(words)[min_words - 1 :]
        masks.append(sum(1 << j for j, length in enumerate(reached) if length >= min_words))
    return masks


def _match_shards(batches, min_words: int):
    """Rows come sorted by shard; a shard holds a bounded number of regions."""
    held: list[tuple[int, int, list[int], int]] = []
    current = None

    def flush():
        masks = repeated_windows([(words, copies) for _, _, words, copies in held], min_words)
        return [(anchor, region, mask) for (anchor, region, _, _), mask in zip(held, masks, strict=True) if mask]

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "region", "mask"])

    out: list[tuple[int, int, int]] = []
    for batch in batches:
        shards, anchors, regions, copies = (batch.column(i).to_pylist() for i in range(4))
        words = batch.column(4)
        for row, shard in enumerate(shards):
            if shard != current and held:
                out += flush()
                held = []
            current = shard
            symbols = np.frombuffer(words[row].as_buffer(), dtype=np.uint64).tolist()
            held.append((anchors[row], regions[row], symbols, copies[row]))
        if len(out) >= 10_000:
            yield batch_of(out)
            out = []
    if held:
        out += flush()
    yield batch_of(out)


def repeated_regions(occurrences: DataFrame, texts: DataFrame, min_words: int, shard_regions: int) -> DataFrame:
    """Rows id, version, first and mask: the windows of each region that are repeated."""
    keys = ["anchor", "region"]
    often = stored(occurrences.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "anchors").filter("n > 1").select("anchor")
    held = stored(occurrences.join(often, "anchor"), "repeated-anchors")
    regions = held.groupBy(*keys).agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "version", "first", "count")).alias("at"))
    regions = stored(regions, "regions")
    kinds = regions.groupBy("anchor").agg(F.count("*").alias("kinds"))
    mixed = regions.join(kinds.filter("kinds > 1"), "anchor").withColumn("hot", F.col("kinds") > shard_regions)
    asked = stored(mixed.groupBy("at.id", "at.version").agg(F.collect_list(F.struct(
        "anchor", "region", "copies", F.col("at.first").alias("first"), F.col("at.count").alias("count"), "hot",
    )).alias("asked")), "asked-regions").filter(F.size("asked") > 0)
    filled = asked.join(
        texts.withColumnRenamed("id", "text_id").withColumnRenamed("version", "text_version"),
        F.col("id").eqNullSafe(F.col("text_id")) & (F.col("version") == F.col("text_version")),
    ).select("text", "asked")
    with filtered_scans(texts.sparkSession):
        pieces = stored(
            arrow_map(filled, _contents, "shard bigint, anchor bigint, region bigint, window int, copies bigint, words binary",
                      min_words=min_words).dropDuplicates(["anchor", "region", "window"]),
            "regions",
        )
    shards = pieces.filter("window < 0").select("shard", "anchor", "region", "copies", "words")
    masks = arrow_map(
        shards.repartition("shard").sortWithinPartitions("shard"), _match_shards,
        "anchor bigint, region bigint, mask bigint", min_words=min_words,
    )
    cut = pieces.filter("window >= 0").select("shard", "anchor", "region", "window", "copies")
    counted = cut.groupBy("shard").agg(F.sum("copies").alias("places")).filter("places > 1").select("shard")
    cut_masks = cut.join(counted, "shard").groupBy(*keys).agg(
        F.expr("sum(shiftleft(1L, window))").alias("mask"))
    whole = F.expr("shiftleft(1L, cast(at.count as int)) - 1")
    alike = regions.join(kinds.filter("kinds = 1"), "anchor").select(*keys, whole.alias("mask"))
    marks = stored(alike.union(masks).union(cut_masks), "marks")
    return held.join(marks, keys).select("id", "version", "first", "mask")


def _cut(batches, min_words: int, rejoin: bool):
    for batch in batches:
        marks = batch.column(2)
        for block in kernels.blocks(batch.column(1)):
            words = kernels.find_words(block.data, block.offsets)
            total = len(words.starts)
            edges = np.zeros(total + 1, dtype=np.int64)
            for row in range(block.rows):
                mark = marks[block.first + row]
                if not mark.is_valid:
                    continue
                fields = mark.values
                firsts = fields.field(0).to_numpy() + words.offsets[row]
                masks = fields.field(1).to_numpy()
                for bit in range(int(masks.max()).bit_length()):
                    starts = firsts[(masks >> bit) & 1 == 1] + bit
                    np.add.at(edges, starts, 1)
                    np.subtract.at(edges, starts + min_words, 1)
            gone = np.cumsum(edges[:-1]) > 0
            raw = block.data.tobytes()
            kept_texts = []
            for row in range(block.rows):
                low, high = int(words.offsets[row]), int(words.offsets[row + 1])
                begin, end = int(block.offsets[row]), int(block.offsets[row + 1])
                if rejoin:
                    kept = np.flatnonzero(~gone[low:high]) + low
                    parts = zip(words.starts[kept].tolist(), words.ends[kept].tolist(), strict=True)
                    kept_texts.append(b" ".join([raw[a:b] for a, b in parts]))
                    continue
                dropped = gone[low:high]
                if not dropped.any():
                    kept_texts.append(raw[begin:end])
                    continue
                turns = np.flatnonzero(np.diff(np.concatenate([[False], dropped, [False]]).astype(np.int8)))
                parts, at = [], begin
                for a, b in turns.reshape(-1, 2).tolist():
                    parts.append(raw[at : int(words.starts[low + a])])
                    at = int(words.starts[low + b]) if low + b < high else int(words.ends[low + b - 1])
                kept_texts.append(b"".join([*parts, raw[at:end]]))
            kept = pa.array(kept_texts, pa.binary()).cast(pa.string())
            rest = [batch.column(i).slice(block.first, block.rows) for i in range(3, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.rows), pa.array(words.counts.astype(np.int64)),
                    pa.array(kernels.sums_by_row(gone, words.offsets)), kept, *rest,
                ],
                ["id", "n_words", "n_removed", "kept_text", *(f"rest_{i}" for i in range(len(rest)))],
            )


def remove_repeated(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 35,
    anchor_words: int = ANCHOR_WORDS, shard_regions: int = SHARD_REGIONS, rejoin: bool = True,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: id, n_words, n_removed, kept_text, and the carried columns.

    The kept text is the kept words joined by one space, or with `rejoin=False` the text as it was, without the removed spans.
    """
    if not 1 <= min_words - anchor_words + 1 <= 62:
        raise ValueError("a region's windows must fit a mask of 62 bits")
    kind = df.schema[id_column].dataType.simpleString()
    text = df[text_column].cast("string")
    texts = df.select(
        df[id_column].alias("id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("version"), text.alias("text"),
        *(df[name].alias(f"rest_{i}") for i, name in enumerate(carried)),
    )
    occurrences = stored(
        arrow_map(
            texts.select("id", "version", "text"), _occurrences, f"id {kind}, version bigint, first int, count smallint, anchor bigint, region bigint",
            min_words=min_words, anchor_words=anchor_words,
        ),
        "anchors",
    )
    marks = repeated_regions(occurrences, texts.select("id", "version", "text"), min_words, shard_regions)
    marks = marks.groupBy("id", "version").agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    marks = stored(marks, "marks").toDF("mark_id", "mark_version", "marks")
    marked = texts.join(
        marks, texts["id"].eqNullSafe(marks["mark_id"]) & (texts["version"] == marks["mark_version"]), "left"
    ).select("id", "text", "marks", *(f"rest_{i}" for i in range(len(carried))))
    schema = f"id {kind}, n_words bigint, n_removed bigint, kept_text string" + "".join(
        f", rest_{i} {df.schema[name].dataType.simpleString()}" for i, name in enumerate(carried))
    cut = arrow_map(marked, _cut, schema, min_words=min_words, rejoin=rejoin)
    return cut.toDF(id_column, "n_words", "n_removed", "kept_text", *carried)
