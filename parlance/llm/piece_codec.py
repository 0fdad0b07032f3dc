"""SentencePiece encoding and decoding as a shortest path through a weighted transducer.

A model file is compiled into three parts: the normaliser (a prefix space, spaces as U+2581), an arc for every piece, and
byte arcs for characters that no piece spells. An input is composed with them lazily: states are (position, last arc), and the
path of least weight in the tropical semiring is searched for, states further on first among equals.

Merging by rank is not a sum of piece scores, but it is a matter of neighbours: a sequence of pieces is what merging would leave
if and only if that holds for every two adjacent pieces, since the first merge across a border would also happen between
those two alone. So an arc after another weighs nothing if merging their joint text leaves exactly these two pieces, and
infinitely much otherwise. Exactly one path has a finite weight: the encoding. Pair weights are compiled on first use.

Pieces never continue over a space into the next word (checked when compiling), so texts are cut there, and at control
characters no piece contains; encodings of such chunks are kept in a bounded cache that a task drops when it ends.

Cases: a null or empty text has no pieces; U+2581 in a text is a space; lone surrogates cannot occur; unknown characters become
bytes; very long words are searched iteratively; equal rows give equal results; an output column that exists is replaced,
others stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from parlance.llm.tables import release_memory

SPACE = "▁"
# Bounds of what a task keeps of chunks, about 150 MB, and a worker of pair weights, about 60 MB.
CACHE_CHUNKS = 600_000
CACHE_PAIRS = 400_000
# Characters whose arcs a task keeps, and how many such beginnings, about 20 MB.
WINDOW, CACHE_WINDOWS = 4, 60_000
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2
_codecs: dict[str, PieceCodec] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file, and what its normaliser does."""

    def __init__(self, path: str):
        with open(path, "rb") as source:
            data = source.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        model_kind, prefix, squeeze, table = 1, 1, 1, b""
        for field, value in _fields(data):
            if field == 1:
                item = dict(_fields(value))
                self.pieces.append(item[1].decode())
                self.scores.append(struct.unpack("<f", item[2])[0] if 2 in item else 0.0)
                self.kinds.append(item.get(3, NORMAL))
            elif field == 2:
                model_kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                rules = dict(_fields(value))
                table, prefix, squeeze = rules.get(2, b""), rules.get(3, 1), rules.get(4, 1)
        if model_kind != BPE_MODEL or table or squeeze or not prefix or USER in self.kinds:
            raise ValueError("only merge models with an identity normaliser and a prefix space are compiled")
        if any(SPACE in piece.lstrip(SPACE) for piece in self.pieces):
            raise ValueError("a piece continues over a space")


class Transducer:
    """Arcs of a model and the weights of one arc after another."""

    def __init__(self, model: Model):
        self.piece_of = {
            piece: i for i, (piece, kind) in enumerate(zip(model.pieces, model.kinds, strict=True)) if kind in (NORMAL, UNUSED)}
        self.text_of = model.pieces
        self.score = model.scores
        self.byte_of = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        # Every beginning of a piece, with the piece it is or -1: a look-up that fails ends the arcs from a place.
        self.begun: dict[str, int] = {}
        for piece, i in self.piece_of.items():
            for end in range(1, len(piece)):
                self.begun.setdefault(piece[:end], -1)
            self.begun[piece] = i
        joined = {c for piece in self.piece_of if len(piece) > 1 for c in piece}
        self.apart = "".join(c for c in map(chr, range(32)) if c not in joined)
        # Neighbours within a piece: merging never crosses a border between two characters that are no such neighbours.
        self.joined = {piece[i : i + 2] for piece in self.piece_of for i in range(len(piece) - 1)}
        # Weights of an arc by the arc before it; the first entry is for none.
        self.weights: list[dict[int, float]] = [{} for _ in range(len(self.text_of) + 1)]
        self.weighed = 0
        self.windows: dict[str, list[tuple[int, int]]] = {}

    def fallback(self, character: str) -> list[int]:
        found = [self.byte_of.get(byte) for byte in character.encode()]
        return [self.unknown] if None in found else found

    def merged(self, text: str) -> list[str]:
        """Merge neighbours whose joint text is a piece, best score first and leftmost among equals, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, place = -inf, -1
            for i in range(len(parts) - 1):
                piece = self.piece_of.get(parts[i] + parts[i + 1])
                if piece is not None and self.score[piece] > best:
                    best, place = self.score[piece], i
            if place < 0:
                break
            parts[place : place + 2] = [parts[place] + parts[place + 1]]
        return parts

    def weight(self, before: int, piece: int) -> float:
        """Of an arc after another; -1 stands for the start or for a character spelt in bytes, which never merges."""
        known = self.weights[before + 1].get(piece)
        if known is None:
            left = self.text_of[before] if before >= 0 else ""
            right = self.text_of[piece]
            known = 0.0 if self.merged(left + right) == [x for x in (left, right) if x] else inf
            if self.weighed >= CACHE_PAIRS:
                for weights in self.weights:
                    weights.clear()
                self.weighed = 0
            self.weights[before + 1][piece] = known
            self.weighed += 1
        return known

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """Pieces that spell the text from here, longest first, as (length, piece); -1 if only bytes can.

        Where no longer piece begins with the next few characters, they alone decide, and the answer is kept for them.
        """
        window = text[at : at + WINDOW]
        kept = self.windows.get(window)
        if kept is not None:
            return kept
        found, begun = [], self.begun
        decided = len(window) < WINDOW
        for end in range(at + 1, len(text) + 1):
            piece = begun.get(text[at:end])
            if piece is None:
                decided = decided or end - at <= WINDOW
                break
            if piece >= 0:
                found.append((end - at, piece))
        if not found or found[0][0] != 1:
            found.insert(0, (1, -1))
        found.reverse()
        if decided:
            if len(self.windows) >= CACHE_WINDOWS:
                self.windows.clear()
            self.windows[window] = found
        return found

    def shortest_path(self, text: str) -> list[int]:
        """Ids on the path of least weight over a chunk."""
        # A finite weight is zero, so a state, (position, last arc + 1), costs nothing once reached: further arcs are tried first, the
        # weight of a shorter one is asked only if those lead nowhere, and states without a way on are not entered again.
        width, weights, size = len(self.text_of) + 1, self.weights, len(text)
        closed: set[int] = set()
        at = last = 0
        untried = iter(self.arcs(text, 0))
        path: list[tuple[int, int, Iterator[tuple[int, int]]]] = []
        while True:
            known = weights[last]
            for length, piece in untried:
                if piece >= 0:
                    more = known.get(piece)
                    if more is None:
                        more = self.weight(last - 1, piece)
                    if more == inf:
                        continue
                end = at + length
                if end == size:
                    ids: list[int] = []
                    steps = [*[(place, arc) for place, arc, _ in path], (at, last), (size, piece + 1)]
                    for (place, _), (_, arc) in zip(steps, steps[1:], strict=False):
                        if arc:
                            ids.append(arc - 1)
                        else:
                            ids += self.fallback(text[place])
                    return ids
                if closed and end * width + piece + 1 in closed:
                    continue
                path.append((at, last, untried))
                at, last = end, piece + 1
                untried = iter(self.arcs(text, at))
                break
            else:
                if not path:
                    break
                closed.add(at * width + last)
                at, last, untried = path.pop()
        raise AssertionError(f"no path over {text[:40]!r}")


class PieceCodec(dict):
    """Encoder and decoder of a model file; as a dictionary it keeps the encoded chunks."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.machine = Transducer(Model(path))
        self.limit = limit
        apart = re.escape(self.machine.apart)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+|[{apart}]").findall if apart else re.compile(
            f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        spelt = {i: bytes([byte]) for byte, i in self.machine.byte_of.items()}
        self.spelling = [
            spelt.get(i, b"" if kind == CONTROL else piece.replace(SPACE, " ").encode())
            for i, (piece, kind) in enumerate(zip(self.machine.text_of, Model(path).kinds, strict=True))
        ]
        self.spelling[self.machine.unknown] = " ⁇ ".encode()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 1 and chunk[-2:] not in self.machine.joined:
            coded = self[chunk[:-1]] + self[chunk[-1]]
        else:
            coded = np.array(self.machine.shortest_path(chunk), dtype="<i4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = coded
        return coded

    def forget(self) -> None:
        """Drop the encoded chunks and the arcs of beginnings; the compiled model and the pair weights, which hardly grow from task to task, stay."""
        self.clear()
        self.machine.windows.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.chunks(SPACE + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.spelling.__getitem__, ids))
        first = next((i for i in ids if self.spelling[i]), self.machine.unknown)
        return data[self.machine.text_of[first].startswith(SPACE):].decode("utf-8", "replace")


def codec(path: str) -> PieceCodec:
    """One codec per worker process and model."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: values}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _schema_with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    kept = [T.StructField(name, kind) if field.name == name else field for field in schema.fields]
    return T.StructType(kept if name in schema.names else [*kept, T.StructField(name, kind)])


def _encoded(batch: pa.RecordBatch, coder: PieceCodec, text_column: str, output: str) -> pa.RecordBatch:
    coded = [coder.encode(text) for text in batch.column(text_column).to_pylist()]
    bounds = np.cumsum([0, *(len(x) // 4 for x in coded)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(coded), dtype=np.int32))
    return _with_column(batch, output, pa.ListArray.from_arrays(pa.array(bounds), values))


def _decoded(batch: pa.RecordBatch, coder: PieceCodec, ids_column: str, output: str) -> pa.RecordBatch:
    ids = batch.column(ids_column)
    bounds, flat = ids.offsets.to_pylist(), ids.values.to_numpy()
    texts = [coder.decode(flat[a:b].tolist()) for a, b in zip(bounds, bounds[1:], strict=False)]
    return _with_column(batch, output, pa.array(texts, pa.string()))


def _mapped(df: DataFrame, model: str, schema: T.StructType, *steps) -> DataFrame:
    """Apply steps to a few hundred rows at a time, all in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        try:
            for whole in batches:
                for begin in range(0, whole.num_rows, 250):
                    batch = whole.slice(begin, 250)
                    for step, *names in steps:
                        batch = step(batch, coder, *names)
                    yield batch
        finally:
            coder.forget()
            release_memory()

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, model: str, text_column: str = "text", output: str = "piece_ids") -> DataFrame:
    """Add the ids of each text as an array of integers."""
    schema = _schema_with(df.schema, output, T.ArrayType(T.IntegerType()))
    return _mapped(df, model, schema, (_encoded, text_column, output))


def decode(df: DataFrame, model: str, ids_column: str = "piece_ids", output: str = "decoded") -> DataFrame:
    """Add the text that ids stand for; null ids give an empty text."""
    return _mapped(df, model, _schema_with(df.schema, output, T.StringType()), (_decoded, ids_column, output))


def encode_and_decode(
    df: DataFrame, model: str, text_column: str = "text", ids_output: str = "piece_ids", text_output: str = "decoded"
) -> DataFrame:
    """Add ids and the text decoded from them, in one pass and one worker per task."""
    schema = _schema_with(_schema_with(df.schema, ids_output, T.ArrayType(T.IntegerType())), text_output, T.StringType())
    return _mapped(df, model, schema, (_encoded, text_column, ids_output), (_decoded, ids_output, text_output))
