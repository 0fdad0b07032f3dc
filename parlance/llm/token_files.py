"""Token ids in Arrow files of fixed-size lists.

Texts are sorted by id into ranges, one file each. A file is an Arrow IPC file whose batches hold sequences of equal length as
fixed-size lists, with a mask of the ids that are real; since every batch and sequence has a known size, id `i` of a file is
found by arithmetic in a memory-mapped buffer, without a copy and without reading what lies before it. The last sequence is
padded. Beside it lies an index file with the place and length of every text. Ids take two bytes if the vocabulary allows.

Tasks write under names no other attempt uses and report them in a manifest, which is stored by Spark; a file that a lost
executor left behind is in no manifest and thus never read. Files go to any file system that Arrow can open.

Cases: a null or empty text is only the end id; equal ids are ordered by text; repeated rows are written one by one; an
empty table writes no file and reads back empty. Other columns play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.tables import file_system, output_folder, stored, unique_name

SEQUENCE = 2048
BATCH_SEQUENCES = 256
END_ID = 1
CACHE_WORDS = 1_000_000
_tokenizers: dict[str, WordCache] = {}


def _words(text: bytes) -> list[bytes]:
    """Runs between ASCII white space; other white space is left to the tokenizer.

    A-Z are lower-cased here, as the tokenizer does, so that fewer words are learnt; not where a special token may stand, and
    not in words of texts with combining marks (U+0300 to U+036F), for it composes letters and marks before it lower-cases.
    """
    if b"<|" in text:
        return text.split()
    if b"\xcc" in text or b"\xcd" in text:
        return [word.lower() if word.isascii() else word for word in text.split()]
    return text.lower().split()


def _is_closed(word: bytes) -> bool:
    """Whether a full stop or comma follows a letter at the end; the tokenizer encodes such a mark apart."""
    return len(word) > 1 and word[-1] in b".," and 97 <= word[-2] <= 122


class WordCache(dict):
    """Ids of words as bytes. Words between white space never interact: the normaliser works inside words and turns
    white space into separators, which the pre-tokenizer drops. A full cache starts anew."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")

    def pack(self, ids: list[int]) -> bytes:
        return array("H" if self.kind.itemsize == 2 else "I", ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode words that are new; those closed by a mark are put together from word and mark."""
        closed = [word for word in words if _is_closed(word)]
        fresh = words.difference(closed)
        fresh.update(part for word in closed for part in (word[:-1], word[-1:]) if part not in self)
        plain = list(fresh)
        coded = self.tokenizer.encode_batch([str(word, "utf-8") for word in plain], add_special_tokens=False)
        for word, found in zip(plain, coded, strict=True):
            self[word] = self.pack(found.ids)
        for word in closed:
            self[word] = self[word[:-1]] + self[word[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of UTF-8 texts. Bytes split at ASCII white space only; other white space is left to the tokenizer."""
        split = [_words(text) for text in texts]
        unknown = {word for words in split for word in words if word not in self}
        if len(self) + len(unknown) > self.limit:
            self.clear()
            unknown.update(*split)
        if unknown:
            self.learn(unknown)
        return [b"".join(map(self.__getitem__, words)) for words in split]


def word_cache(path: str) -> WordCache:
    """One cache per worker process and vocabulary."""
    if path not in _tokenizers:
        _tokenizers[path] = WordCache(path)
    return _tokenizers[path]


def _schema(kind: np.dtype, length: int) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length)),
    ])


class _SequenceWriter:
    """Collects ids and writes full batches of sequences; only a batch is held."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length = kind, length
        self.schema = _schema(kind, length)
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0
        self.full = BATCH_SEQUENCES * length * kind.itemsize

    def add(self, coded: bytes) -> None:
        self.held.append(coded)
        self.size += len(coded)
        if self.size >= self.full:
            data = b"".join(self.held)
            whole = len(data) // self.full * self.full
            for begin in range(0, whole, self.full):
                self._write(data[begin : begin + self.full])
            self.held, self.size = [data[whole:]], len(data) - whole

    def _write(self, data: bytes) -> None:
        ids = np.frombuffer(data, dtype=self.kind)
        padded = -len(ids) % self.length
        mask = np.ones(len(ids) + padded, dtype=bool)
        if padded:
            mask[len(ids):] = False
            ids = np.concatenate([ids, np.zeros(padded, dtype=self.kind)])
        self.writer.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._write(b"".join(self.held))
        self.writer.close()


def write_token_files(
    df: DataFrame, vocabulary: str, folder: str | None = None, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID, length: int = SEQUENCE, files: int | None = None,
) -> tuple[str, DataFrame]:
    """Write all texts; returns the folder and the manifest: file, part, n_texts and n_ids, in file order by part."""
    spark = df.sparkSession
    folder = folder or output_folder(spark, "tokens")
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    texts = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    ranged = (texts.repartitionByRange(files, "id") if files else texts.repartitionByRange("id")).sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = file_system(folder)
        cache = word_cache(vocabulary)
        end = np.array([end_id], dtype=cache.kind).tobytes()
        name, sink, total, rows = unique_name("tokens", ".arrow"), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                sink = system.open_output_stream(f"{root}/{name}")
                index_sink = system.open_output_stream(f"{root}/{name}.index")
                writer = _SequenceWriter(sink, cache.kind, length)
                index_schema = pa.schema([("id", batch.schema.field(0).type), ("start", pa.int64()), ("length", pa.int64())])
                index = pa.ipc.new_file(index_sink, index_schema)
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                starts, sizes = [], []
                for coded in cache.encode([x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]):
                    writer.add(coded)
                    writer.add(end)
                    starts.append(total)
                    sizes.append(len(coded) // cache.kind.itemsize + 1)
                    total += sizes[-1]
                rows += part.num_rows
                index.write_batch(pa.record_batch(
                    [part.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index_schema))
        if sink is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict({
                "file": [name], "part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "n_texts": pa.array([rows], pa.int64()), "n_ids": pa.array([total], pa.int64()),
            })

    manifest = stored(ranged.mapInArrow(write, "file string, part bigint, n_texts bigint, n_ids bigint"), "token-manifest")
    return folder, manifest


class TokenFile:
    """Random access to the ids of a file. On a local disk nothing is copied: slices point into the mapped file."""

    def __init__(self, folder: str, name: str):
        system, root = file_system(folder)
        local = type(system).__name__ == "LocalFileSystem"
        source = pa.memory_map(f"{root}/{name}") if local else system.open_input_file(f"{root}/{name}")
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self._batch, self._ids = -1, np.empty(0)

    def _load(self, number: int) -> np.ndarray:
        if number != self._batch:
            batch = self.reader.get_batch(number)
            self._ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            self._batch = number
        return self._ids

    def slices(self, start: int, count: int) -> Iterator[np.ndarray]:
        """Views of ids from a place on, a batch at a time."""
        size = BATCH_SEQUENCES * self.length
        while count > 0:
            ids = self._load(start // size)
            piece = ids[start % size : start % size + count]
            yield piece
            start, count = start + len(piece), count - len(piece)

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """A sequence of the file and its mask."""
        batch = self.reader.get_batch(number // BATCH_SEQUENCES)
        place = number % BATCH_SEQUENCES
        return batch.column(0)[place].values.to_numpy(), batch.column(1)[place].values.to_numpy(zero_copy_only=False)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row per text, from the files: id, start (ids before it in all files), n_tokens and ids_crc32."""
    parts = sorted((row["part"], row["file"], row["n_ids"]) for row in manifest.collect())  # one row per file
    listed, before = [], 0
    for _, name, count in parts:
        listed.append((name, before))
        before += count
    files = spark.createDataFrame(listed, "file string, before bigint")
    files = files.repartition(max(1, len(listed))).select("file", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TokenFile(folder, name)
                with system.open_input_file(f"{root}/{name}.index") as source:
                    index = pa.ipc.open_file(source)
                    for number in range(index.num_record_batches):
                        rows = index.get_batch(number)
                        sums = []
                        for start, count in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                            crc = 0
                            for ids in tokens.slices(start, count):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(0), pa.array(rows.column(1).to_numpy() + first), rows.column(2), pa.array(sums, pa.int64())],
                            ["id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")
