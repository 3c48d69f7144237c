"""Tables that change by whole versions, and only where they are touched.

A store is a folder with ``data``, whose folders are written once and never changed, and ``manifests``,
one small file per version. A manifest says, for every table, which folders hold which of its cells
(a cell is a month of bookings, or a hash bucket), and the last batch applied of every source. A
version appears when its manifest is renamed into place: a reader has one version for as long as it
reads, a writer that dies leaves nothing but unnamed folders, and a batch that is run again is
recognised. A change rewrites the cells that hold a touched key and names all others again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bazaarflow.session import child_names, discard, read_text, rename_to_new, write_text

CELL = "cell"
ATTEMPTS = 5


class Conflict(RuntimeError):
    """Another writer published first, every time."""


@dataclass(frozen=True)
class Layout:
    """A table's schema, the text column that says which cell a row is in, and what a cell's files are sorted by."""

    schema: T.StructType
    cell: Callable[[], Column]
    sort: tuple[str, ...] = ()


@dataclass
class Manifest:
    version: int = 0
    applied: dict[str, int] = field(default_factory=dict)
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__)

    def has(self, source: str, batch: int) -> bool:
        return batch <= self.applied.get(source, -1)

    def next(self) -> Manifest:
        tables = {name: {c: list(f) for c, f in cells.items()} for name, cells in self.tables.items()}
        return Manifest(self.version + 1, dict(self.applied), tables)


class Store:
    """Versioned tables below ``path``, with a ``Layout`` for each name."""

    def __init__(self, spark: SparkSession, path: str, layouts: Mapping[str, Layout]):
        self.spark, self.path, self.layouts = spark, path.rstrip("/"), dict(layouts)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in child_names(self.spark, f"{self.path}/manifests")
                      if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The manifest of a version, by default the newest; an empty one before the first."""
        if version is None:
            version = max(self.versions(), default=0)
        return Manifest(**json.loads(read_text(self.spark, self._manifest(version)))) if version else Manifest()

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:020d}.json"

    def read(self, name: str, cells: Iterable[str] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """A table as of one version, by default the newest; ``cells`` reads only their folders."""
        held = (manifest or self.manifest()).tables.get(name, {})
        chosen = held if cells is None else [c for c in cells if c in held]
        paths = [f"{self.path}/data/{folder}" for c in chosen for folder in held[c]]
        schema = self.layouts[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, source: str, batch: int, write: Callable[[Change], None]) -> bool:
        """Make ``write``'s changes one new version; False where the source's ``batch`` was applied before.

        Batches of a source are numbered in order. Where another writer was faster, the change is made
        again on top of its version.
        """
        for _ in range(ATTEMPTS):
            base = self.manifest()
            if base.has(source, batch):
                return False
            change = Change(self, base)
            write(change)
            change.new.applied[source] = batch
            waiting = f"{self.path}/manifests/_{uuid.uuid4().hex}"
            write_text(self.spark, waiting, change.new.text())
            if rename_to_new(self.spark, waiting, self._manifest(change.new.version)):
                return True
            discard(self.spark, waiting)
        raise Conflict(f"{source} {batch}: {ATTEMPTS} other versions came first")

    def replace(self, tables: Mapping[str, DataFrame], source: str, batch: int) -> bool:
        """Replace whole tables, all of them in one version."""
        def write(change: Change) -> None:
            for name, rows in tables.items():
                change.replace(name, rows)

        return self.publish(source, batch, write)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and the folders that only the others name.

        Folders of changes that were never published go too, unless they build on the newest version
        or a later one: those may still be at work.
        """
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        named = {folder.split("/")[0] for v in kept for cells in self.manifest(v).tables.values()
                 for folders in cells.values() for folder in folders}
        for version in old:
            discard(self.spark, self._manifest(version))
        newest = kept[-1] if kept else 0
        for written in child_names(self.spark, f"{self.path}/data"):
            if written not in named and int(written.split("-")[0]) <= newest:
                discard(self.spark, f"{self.path}/data/{written}")


class Change:
    """What one version will change; nothing is seen of it before it is published."""

    def __init__(self, store: Store, base: Manifest):
        self.store, self.base, self.new = store, base, base.next()
        self.folder = f"{self.new.version}-{uuid.uuid4().hex}"
        self._writes = 0

    def read(self, name: str, cells: Iterable[str] | None = None) -> DataFrame:
        """The table before this change."""
        return self.store.read(name, cells, self.base)

    def touched(self, name: str, keys: DataFrame, key: str = "id") -> list[str]:
        """The cells that hold one of ``keys``: reads the key and what the cell is made of, no more."""
        cell = self.store.layouts[name].cell()
        held = self.read(name).select(key, cell.alias(CELL))
        return sorted(r[0] for r in held.join(keys.select(key), key, "left_semi").select(CELL).distinct().collect())

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add ``rows``; returns them read from what was written, so that they are computed once."""
        written = self._write(name, rows)
        for cell, folder in written.items():
            self.new.tables.setdefault(name, {}).setdefault(cell, []).append(folder)
        return self._written(name, written)

    def gathered(self, name: str, cells: Iterable[str]) -> bool:
        """Whether each of ``cells`` was written at once, not added to since."""
        return all(len(self.base.tables[name][c]) == 1 for c in cells)

    def rewrite(self, name: str, rows: DataFrame, cells: Iterable[str], in_place: bool = False) -> DataFrame:
        """``rows`` take the place of all rows in ``cells``; returns them read from what was written.

        ``in_place``: the rows are as they are read, with no shuffle since, and stay in their tasks, so a
        cell gets at most one file per file or split that it was read from.
        """
        written = self._write(name, rows, in_place)
        table = self.new.tables.setdefault(name, {})
        for cell in cells:
            table.pop(cell, None)
        for cell, folder in written.items():
            table.setdefault(cell, []).append(folder)
        return self._written(name, written)

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        return self.rewrite(name, rows, list(self.new.tables.get(name, {})))

    def _written(self, name: str, folders: Mapping[str, str]) -> DataFrame:
        return self.store.read(name, folders, Manifest(tables={name: {c: [f] for c, f in folders.items()}}))

    def _write(self, name: str, rows: DataFrame, in_place: bool = False) -> dict[str, str]:
        """The new folder of each cell among ``rows``; a large cell is several files."""
        layout = self.store.layouts[name]
        self._writes += 1
        folder = f"{self.folder}/{name}-{self._writes}"
        path = f"{self.store.path}/data/{folder}"
        placed = rows.select(
            *[F.col(f.name).cast(f.dataType) for f in layout.schema.fields], layout.cell().alias(CELL))
        placed = placed if in_place else placed.hint("rebalance", F.col(CELL))
        placed.sortWithinPartitions(CELL, *layout.sort).write.partitionBy(CELL).parquet(path)
        return {n.removeprefix(f"{CELL}="): f"{folder}/{n}"
                for n in child_names(self.store.spark, path) if n.startswith(f"{CELL}=")}


def month_cell(column: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.date_format(column, "yyyy-MM"), F.lit("undated"))


def bucket_cell(column: str, buckets: int) -> Callable[[], Column]:
    return lambda: F.format_string("%04d", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
