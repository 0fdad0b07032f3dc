"""A log-structured store of partial tables, folded level by level.

Every commit adds one segment: a folder with one parquet table per name. A manifest, a small JSON file with a version in its
name, lists the live segments; a reader takes the newest one and sees either all tables of a commit or none. Segments of a
level are folded into one of the next level when there are `fanout` of them, so a row is rewritten a logarithmic number of times.
A folded segment replaces its parts in one step, by writing the next manifest under a name that must not exist yet; the parts'
folders are removed after that. A folder that no manifest names, left by a commit that did not finish, is never read.

Commits carry growing numbers. A number that the store already holds is not written again, so a replayed batch changes
nothing, whether or not its segment has been folded since. One writer at a time: of two that meet, one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Fold = Callable[[DataFrame], DataFrame]
_MANIFEST = "manifest-"


@dataclass(frozen=True)
class Segment:
    """One folder of tables: the commits it holds, and how often it has been folded."""

    folder: str
    first: int
    last: int
    level: int
    tables: tuple[str, ...]


class SegmentLog:
    """The store below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 8):
        if fanout < 2:
            raise ValueError("folding needs two segments at least")
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._files = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.fs.Path("/".join([self.root, *names]))

    def _names(self) -> list[str]:
        if not self._files.exists(self._path()):
            return []
        return [item.getPath().getName() for item in self._files.listStatus(self._path())]

    def version(self) -> int:
        """Number of the newest manifest, 0 for an empty store."""
        numbers = [name[len(_MANIFEST):-len(".json")] for name in self._names() if name.startswith(_MANIFEST) and name.endswith(".json")]
        return max(map(int, numbers), default=0)

    def segments(self) -> list[Segment]:
        """Live segments, in order of their commits."""
        version = self.version()
        if not version:
            return []
        stream = self._files.open(self._path(f"{_MANIFEST}{version:010d}.json"))
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        return [Segment(**{**item, "tables": tuple(item["tables"])}) for item in json.loads(text)]

    def _publish(self, segments: list[Segment], version: int) -> None:
        """Make the segments the live ones; fails if another writer has published this version."""
        final = self._path(f"{_MANIFEST}{version:010d}.json")
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps([asdict(segment) for segment in segments]).encode()))
        stream.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer has published version {version}")
        for name in self._names():
            if name.startswith(_MANIFEST) and name < final.getName():
                self._files.delete(self._path(name), False)

    def _write(self, tables: Mapping[str, DataFrame], folder: str) -> None:
        for name, table in tables.items():
            table.write.mode("errorifexists").parquet(f"{self.root}/{folder}/{name}")

    def committed(self) -> int:
        """The greatest commit number held, -1 if there is none."""
        return max((segment.last for segment in self.segments()), default=-1)

    def commit(self, number: int, tables: Mapping[str, DataFrame]) -> bool:
        """Add the tables of one commit; false if the store has it already."""
        version, live = self.version(), self.segments()
        if any(number <= segment.last for segment in live):
            return False
        folder = f"segment-{uuid.uuid4().hex}"
        self._write(tables, folder)
        self._publish([*live, Segment(folder, number, number, 0, tuple(tables))], version + 1)
        return True

    def read(self, table: str, segments: list[Segment] | None = None) -> DataFrame | None:
        """The rows of a table over the live segments, not yet folded; None if no segment has it."""
        held = [item for item in (self.segments() if segments is None else segments) if table in item.tables]
        if not held:
            return None
        parts = [self.spark.read.parquet(f"{self.root}/{item.folder}/{table}") for item in held]
        return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)

    def fold(self, folds: Mapping[str, Fold], everything: bool = False) -> int:
        """Fold full levels, or all segments into one; returns how many segments were replaced.

        `folds` gives for each table the aggregate that merges its rows; tables must be merged without loss.
        """
        replaced = 0
        while True:
            version, live = self.version(), self.segments()
            chosen = self._foldable(live, everything)
            if len(chosen) < 2:
                return replaced
            names = tuple(dict.fromkeys(name for item in chosen for name in item.tables))
            folder = f"segment-{uuid.uuid4().hex}"
            self._write({name: folds[name](self.read(name, chosen)) for name in names}, folder)
            level = 1 + max(item.level for item in chosen)
            merged = Segment(folder, chosen[0].first, chosen[-1].last, level, names)
            rest = [item for item in live if item not in chosen]
            self._publish(sorted([*rest, merged], key=lambda item: item.first), version + 1)
            for item in chosen:
                self._files.delete(self._path(item.folder), True)
            replaced += len(chosen)

    def _foldable(self, live: list[Segment], everything: bool) -> list[Segment]:
        if everything:
            return live
        for level in sorted({item.level for item in live}):
            same = [item for item in live if item.level == level]
            if len(same) >= self.fanout:
                return same[: self.fanout]
        return []
