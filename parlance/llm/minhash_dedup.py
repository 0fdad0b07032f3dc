"""Near-duplicates by MinHash: bands propose pairs, odd sketches screen them, full shingle sets confirm them.

1. One pass over the texts gives each document the size and a 128-bit key of its shingle set, the band keys of its MinHash
   samples and an odd sketch: a bitmap in which every sample flips one bit, so that the population count of two sketches'
   XOR estimates how many samples differ, most precisely where few do.
2. Documents with equal sets form a class; only its smallest id goes on, however many copies there are.
3. Classes that share a band key share a bucket. First every member is compared with the least id of its bucket: that joins
   large groups of mutual copies at a cost that follows their size.
4. Buckets that then hold several groups are compared within, in blocks: members of the largest group with all others,
   and the others with each other. A block holds a bounded number of members and bytes. A task compares their sketches and
   passes on the members that have a candidate; another fetches their full sets, compares those of pairs that are not yet
   joined and meet in no earlier band, and reports only links that join groups.
   So every pair that shares a bucket is compared or already joined by confirmed links; nothing is capped or dropped.
5. `components` joins the confirmed links.

A pair at the threshold of 0.8 shares none of 24 bands of 4 with probability 3e-6, and is screened out with less than that.

Cases: a null or empty text has no shingles and is linked with nothing; a text with fewer words than a shingle is one
shingle; ties go to the smallest id; rows that repeat an id count as one document, represented by its smallest set key, and
rows without an id are left out; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import kernels
from parlance.llm.components import components
from parlance.llm.tables import arrow_map, filtered_scans, stored

SAMPLES = 128
BANDS = 24
BAND_ROWS = 4
SKETCH_BITS = 512
# How far below the threshold a sketch may estimate a pair that is still confirmed on full sets.
SLACK = 0.22
BLOCK_MEMBERS = 1024
BLOCK_BYTES = 1 << 24
_CHUNK = 512

_random = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def shingle_sets(block: kernels.Block, length: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    words = kernels.find_words(block.data, block.offsets)
    spans = kernels.Spans(kernels.word_hashes(block.data, words, lower=True), kernels.WORD_BASE)
    sets = []
    for begin, end in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        starts = np.arange(begin, max(end - length + 1, begin + (end > begin)))
        sets.append(np.unique(spans.of(starts, np.minimum(starts + length, end))))
    return sets


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set that is not empty."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, len(values), _CHUNK):
        hashed = values[begin : begin + _CHUNK, None] * _FACTORS + _SHIFTS
        np.minimum(least, hashed.min(axis=0), out=least)
    return least


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per row of samples: the parity of the number of samples that fall on each bit."""
    salted = kernels.mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)))
    bits = (salted % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = np.bincount(bits.ravel(), minlength=len(samples) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(parity).view(np.int64).reshape(len(samples), SKETCH_BITS // 64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples[:, : BANDS * BAND_ROWS].reshape(len(samples), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(samples), BANDS))
    for place in range(BAND_ROWS):
        keys = kernels.mix(keys ^ (rows[:, :, place] + np.uint64(0x51ED270B)))
    return keys.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel())
    )


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(
        [(kernels.mix(x).sum(), kernels.mix(x + np.uint64(0xA5A5A5A5)).sum()) for x in sets], dtype=np.uint64
    ).reshape(len(sets), 2)
    return keys[:, 0].view(np.int64), np.ascontiguousarray(keys[:, 1]).view(np.int64)


def _sign(batches, length: int):
    names = ["id", "n_shingles", "set_a", "set_b", "bands", "sketch"]
    for batch in batches:
        for block in kernels.blocks(batch.column(1)):
            sets = shingle_sets(block, length)
            samples = np.zeros((len(sets), SAMPLES), dtype=np.uint32)
            for row, shingles in enumerate(sets):
                if len(shingles):
                    samples[row] = minhash(shingles)
            first, second = _set_keys(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.rows), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.ascontiguousarray(first)), pa.array(second), _lists(band_keys(samples)),
                    _lists(odd_sketches(samples)),
                ],
                names,
            )


def _full_sets(batches, length: int):
    for batch in batches:
        for block in kernels.blocks(batch.column(1)):
            sets = shingle_sets(block, length)
            first, second = _set_keys(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.rows), pa.array(np.ascontiguousarray(first)),
                    pa.array(second), pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                ["id", "set_a", "set_b", "shingles"],
            )


class _Members:
    """The rows of a block as arrays."""

    def __init__(self, rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        column = {name: table.column(name) for name in table.column_names}
        self.ids = column["rep"].to_pylist()
        self.groups = np.unique(np.array(column["label"].to_pylist()), return_inverse=True)[1]
        self.sizes = column["n_shingles"].to_numpy()
        self.core = column["core"].to_numpy()
        self.with_core = bool(column["with_core"][0].as_py())
        self.place = int(column["place"][0].as_py())
        self.sketches = np.array(column["sketch"].to_pylist(), dtype=np.int64).view(np.uint64)
        self.bands = np.array(column["bands"].to_pylist(), dtype=np.int64)
        if "shingles" in column:
            self.sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in column["shingles"].combine_chunks()]

    def candidates(self, i: int, groups: np.ndarray, percent: int, most_bits: int) -> np.ndarray:
        """Later members of other groups that may be similar, by size and sketch, and meet this one in no earlier band."""
        rest = slice(i + 1, None)
        open_pairs = groups[rest] != groups[i]
        if self.with_core:
            open_pairs &= self.core[rest] != self.core[i]
        sizes = self.sizes[rest]
        open_pairs &= 100 * np.minimum(sizes, self.sizes[i]) >= percent * np.maximum(sizes, self.sizes[i])
        near = np.flatnonzero(open_pairs) + i + 1
        differing = np.bitwise_count(self.sketches[near] ^ self.sketches[i]).sum(axis=1, dtype=np.int64)
        near = near[differing <= most_bits]
        return near[~(self.bands[near, : self.place] == self.bands[i, : self.place]).any(axis=1)]


def joining_links(members: _Members, percent: int, most_bits: int) -> list[tuple[object, object]]:
    """Links between similar members of different groups, one for each time that groups are joined."""
    found = []
    groups = members.groups.copy()
    for i in range(len(groups) - 1):
        near = members.candidates(i, groups, percent, most_bits)
        if not len(near):
            continue
        own = members.sets[i]
        flat = np.concatenate([members.sets[j] for j in near])
        bounds = np.concatenate([[0], np.cumsum(members.sizes[near])[:-1]])
        hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        shared = np.add.reduceat(hits.astype(np.int64), bounds)
        linked = near[100 * shared >= percent * (members.sizes[near] + members.sizes[i] - shared)]
        for j in linked:
            if groups[j] != groups[i]:
                found.append((members.ids[i], members.ids[j]))
                groups[groups == groups[j]] = groups[i]
    return found


def _by_block(batches):
    """The rows of each block; they come sorted by block."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if keys[begin] != current and held:
                yield held
                held = []
            current = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield held


def _screen_blocks(batches, percent: int, most_bits: int):
    """Of each block, the members that have a candidate."""
    for rows in _by_block(batches):
        members = _Members(rows)
        wanted = np.zeros(len(members.ids), dtype=bool)
        for i in range(len(wanted) - 1):
            near = members.candidates(i, members.groups, percent, most_bits)
            wanted[near] = True
            wanted[i] |= len(near) > 0
        if wanted.any():
            yield from pa.Table.from_batches(rows).filter(pa.array(wanted)).combine_chunks().to_batches()


def _compare_blocks(batches, percent: int, most_bits: int):
    for rows in _by_block(batches):
        links = joining_links(_Members(rows), percent, most_bits)
        if links:
            kind = rows[0].schema.field("rep").type
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in zip(*links, strict=True)], ["a", "b"])


def _shared(batches):
    for batch in batches:
        left, right = batch.column("left_set"), batch.column("right_set")
        counts = np.empty(batch.num_rows, dtype=np.int64)
        sizes = np.empty(batch.num_rows, dtype=np.int64)
        for row in range(batch.num_rows):
            a = np.frombuffer(left[row].as_buffer(), dtype=np.uint64)
            b = np.frombuffer(right[row].as_buffer(), dtype=np.uint64)
            both = np.concatenate([a, b])
            both.sort(kind="stable")
            counts[row] = np.count_nonzero(both[1:] == both[:-1])
            sizes[row] = len(both)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(counts), pa.array(sizes - counts)], ["a", "b", "shared", "united"]
        )


def _differing_bits(left: str, right: str):
    words = [F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(SKETCH_BITS // 64)]
    total = words[0]
    for word in words[1:]:
        total = total + word
    return total


def _most_bits(similarity: float) -> int:
    """Bits in which the sketches of two sets of this similarity are expected to differ."""
    return int(SKETCH_BITS / 2 * (1 - exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs, those whose full sets are similar enough."""
    slim = classes.select("rep", "n_shingles", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(slim.toDF(side, f"{side}_size", f"{side}_sketch"), side)
    screened = pairs.filter(
        (100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size"))
        & (_differing_bits("a_sketch", "b_sketch") <= _most_bits(percent / 100 - SLACK))
    ).select("a", "b")
    screened = stored(screened, "screened-pairs")
    filled = screened.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")
    kind = classes.schema["rep"].dataType.simpleString()
    counted = arrow_map(filled, _shared, f"a {kind}, b {kind}, shared bigint, united bigint")
    return counted.filter(100 * F.col("shared") >= percent * F.col("united")).select("a", "b")


def _links_within_buckets(todo: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join groups inside buckets that hold several, after members were linked with their buckets' centres."""
    nearest = links.groupBy("a").agg(F.min("b").alias("b"))
    onward = nearest.select(F.col("a").alias("b"), F.col("b").alias("further"))
    groups = nearest.join(onward, "b", "left").select(F.col("a").alias("rep"), F.coalesce("further", "b").alias("label"))
    placed = todo.join(groups, "rep", "left").select("band", "place", "rep", F.coalesce("label", "rep").alias("label"))
    sizes = placed.join(classes.select("rep", "n_shingles"), "rep").groupBy("band", "label").agg(
        F.count("*").alias("members"), F.sum("n_shingles").alias("shingles"))
    whole = sizes.groupBy("band").agg(
        F.max(F.struct("members", "shingles", "label")).alias("core"), F.sum("members").alias("members"),
        F.sum("shingles").alias("shingles"), F.count("*").alias("groups"),
    ).filter("groups > 1")

    def parts(members, shingles):
        return F.greatest(
            F.ceil(members / F.lit(BLOCK_MEMBERS)), F.ceil(shingles * 8 / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")

    mixed = stored(whole.select(
        "band", F.col("core.label").alias("core_label"), parts(F.col("core.members"), F.col("core.shingles")).alias("core_parts"),
        parts(F.col("members") - F.col("core.members"), F.col("shingles") - F.col("core.shingles")).alias("other_parts"),
    ), "mixed-buckets")
    members = placed.join(mixed, "band").withColumn("core", F.col("label") == F.col("core_label"))
    own = F.pmod(F.xxhash64("rep", F.lit(7)), F.when(F.col("core"), F.col("core_parts")).otherwise(F.col("other_parts"))).cast("int")

    def numbers(count):
        return F.sequence(F.lit(0), F.col(count) - 1)

    def with_core(core, other):
        return F.struct(F.lit(True).alias("with_core"), core.alias("x"), other.alias("y"))

    rest = F.transform(numbers("other_parts"), lambda j: F.struct(
        F.lit(False).alias("with_core"), F.least("own", j).alias("x"), F.greatest("own", j).alias("y")))
    blocks = F.when(F.col("core"), F.transform(numbers("other_parts"), lambda j: with_core(F.col("own"), j))).otherwise(
        F.concat(F.transform(numbers("core_parts"), lambda j: with_core(j, F.col("own"))), rest))
    rows = members.withColumn("own", own).select("band", "place", "rep", "label", "core", F.explode(blocks).alias("block"))
    kind = classes.schema["rep"].dataType.simpleString()
    filled = rows.join(classes.select("rep", "n_shingles", "sketch", "bands"), "rep").select(
        F.xxhash64("band", "block").alias("block"), "place", "rep", "label", "core", "block.with_core", "n_shingles", "sketch", "bands",
    )
    options = {"percent": percent, "most_bits": _most_bits(percent / 100 - SLACK)}
    screened = stored(
        arrow_map(
            filled.repartition("block").sortWithinPartitions("block"), _screen_blocks,
            f"block bigint, place int, rep {kind}, label {kind}, core boolean, with_core boolean, n_shingles bigint, "
            "sketch array<bigint>, bands array<bigint>", **options,
        ),
        "screened-members",
    )
    complete = screened.join(sets.withColumnRenamed("id", "rep"), "rep").select(*screened.columns, "shingles")
    return arrow_map(
        complete.repartition("block").sortWithinPartitions("block"), _compare_blocks, f"a {kind}, b {kind}", **options)


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id it is linked with) and kept."""
    kind = df.schema[id_column].dataType.simpleString()
    texts = df.filter(df[id_column].isNotNull()).select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    signed = stored(
        arrow_map(
            texts, _sign, f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, "
            "sketch array<bigint>", length=shingle_words,
        ),
        "minhash",
    )
    documents = signed.groupBy("id").agg(F.min(F.struct("set_a", "set_b", "n_shingles")).alias("s")).select("id", "s.*")
    filled = documents.filter("n_shingles > 0")
    leaders = filled.groupBy("set_a", "set_b").agg(F.min("id").alias("rep"))
    classes = stored(
        signed.withColumnRenamed("id", "rep").join(leaders, ["rep", "set_a", "set_b"]).dropDuplicates(["rep"]), "classes"
    )

    buckets = classes.select("rep", F.posexplode("bands").alias("place", "band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre != last")
    todo = stored(buckets.join(shared.select("band", "centre"), "band"), "buckets")
    wanted = classes.join(todo.select("rep").distinct(), "rep", "left_semi")
    wanted = stored(wanted.select(F.col("rep").alias("id"), "set_a", "set_b", "n_shingles"), "bucket-members").filter("n_shingles > 0")
    with filtered_scans(df.sparkSession):
        sets = stored(
            arrow_map(
                texts.join(wanted.select("id"), "id", "left_semi"), _full_sets,
                f"id {kind}, set_a bigint, set_b bigint, shingles binary", length=shingle_words,
            ).join(wanted.drop("n_shingles"), ["id", "set_a", "set_b"]).dropDuplicates(["id"]).select("id", "shingles"),
            "shingle-sets",
        )
    pairs = todo.filter("rep != centre").select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    links = stored(_confirmed(pairs, classes, sets, percent), "links")
    links = stored(links.union(_links_within_buckets(todo, links, classes, sets, percent)), "links")
    labels = components(links).select(F.col("node").alias("rep"), F.col("root").alias("label"))
    named = leaders.join(labels, "rep", "left").select("set_a", "set_b", F.coalesce("label", "rep").alias("root"))
    found = documents.join(named, ["set_a", "set_b"], "left").select(
        F.col("id").alias(id_column), "n_shingles", F.coalesce("root", "id").alias("component_id"))
    return found.withColumn("kept", F.col(id_column) == F.col("component_id"))
