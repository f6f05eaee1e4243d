"""A table in parts (key buckets, days), of which a change rewrites only those it touches.

Each commit writes the parts it changes to a folder of its own, ``v=<number>/part=<part>``, and one
manifest says which folders make up each part. What a commit doesn't touch is not read, written or
listed again; readers open the folders of the parts they ask for and no others. Older manifests name
older folders, so a version stays readable until ``vacuum``. A commit cut short leaves a folder that no
manifest names, and the next one overwrites it.

The manifest has one entry per part: their number is to be bounded, as that of buckets or days is, and
their names are to be fit for folders (letters, digits, dots, hyphens).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from parcelrules.operators import maintenance
from parcelrules.streaming.ledger import Manifests

NO_PART = "none"        # the part of rows whose part is null


class PartedTable(Manifests):
    """Rows of ``kind`` (a DDL string or a StructType) under ``base``; ``part`` tells a row's part."""

    EMPTY = {"version": 0, "sources": {}, "parts": {}}

    def __init__(self, spark: SparkSession, base: str, kind: str | StructType, part: Column):
        super().__init__(spark, base)
        self.kind = StructType.fromDDL(kind) if isinstance(kind, str) else kind
        self.part = F.coalesce(part.cast("string"), F.lit(NO_PART))

    def touched(self, rows: DataFrame) -> set[str]:
        """The parts that have some of ``rows``; as few values as the table has parts."""
        return {r.part for r in rows.select(self.part.alias("part")).distinct().collect()}

    def folders(self, parts: Iterable[str] | None = None, version: int | None = None) -> list[str]:
        held = self.state(version)["parts"]
        wanted = held if parts is None else [p for p in parts if p in held]
        return [f"{self.base}/v={v}/part={p}" for p in sorted(wanted) for v in held[p]]

    def read(self, parts: Iterable[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of the given parts (of all), in the newest or an older version."""
        folders = self.folders(parts, version)
        return self.spark.read.schema(self.kind).parquet(*folders) if folders else self.spark.createDataFrame([], self.kind)

    def _write(self, rows: DataFrame) -> tuple[int, list[str]]:
        """The number of the commit to make and the parts written for it."""
        number = self.next()
        folder = f"{self.base}/v={number}"
        columns = [F.col(f.name).cast(f.dataType) for f in self.kind]
        # A rebalance puts a part into few files and, unlike a plain shuffle, splits a hot one.
        rows.select(*columns, self.part.alias("part")).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder)
        found = self._fs.globStatus(self._path(f"{folder}/part=*")) or []
        return number, [s.getPath().getName().split("=", 1)[1] for s in found]

    def append(self, rows: DataFrame, source: str, batch: int) -> bool:
        """Add rows to their parts; a batch committed before changes nothing."""
        if self.holds(source, batch):
            return False
        number, parts = self._write(rows)
        state = self.state()
        held = {**state["parts"], **{p: [*state["parts"].get(p, []), number] for p in parts}}
        self._commit({**state, "sources": {**state["sources"], source: batch}, "parts": held})
        return True

    def replace(self, rows: DataFrame, parts: Iterable[str], source: str, batch: int) -> bool:
        """Put ``rows`` in place of what the given parts hold; a part without any is gone."""
        if self.holds(source, batch):
            return False
        parts = set(parts)
        number, made = self._write(rows)
        if not parts.issuperset(made):
            raise ValueError(f"rows of parts that are not replaced: {sorted(set(made) - parts)[:5]}")
        state = self.state()
        held = {p: v for p, v in state["parts"].items() if p not in parts} | {p: [number] for p in made}
        self._commit({**state, "sources": {**state["sources"], source: batch}, "parts": held})
        return True

    def newer(self, than: int) -> list[str]:
        """The parts that changed after a version."""
        return [p for p, v in self.state()["parts"].items() if v[-1] > than]

    def vacuum(self) -> int:
        """Delete folders of parts that the newest manifest doesn't name, and older manifests; how many folders went."""
        state, gone = self.state(), 0
        named = {(v, p) for p, vs in state["parts"].items() for v in vs}
        for status in self._fs.globStatus(self._path(f"{self.base}/v=*/part=*")) or []:
            path = status.getPath()
            key = int(path.getParent().getName().split("=")[1]), path.getName().split("=", 1)[1]
            if key not in named and key[0] <= state["version"]:
                gone += bool(self._fs.delete(path, True))
        for version in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.base}/_commits/{version:012d}.json"), False)
        return gone


def bucketed_by(keys: list[str], buckets: int) -> Column:
    """The bucket of a row by its key; rows with null parts in the key have one too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets))


def upsert(table: PartedTable, changes: DataFrame, now: Column, source: str, batch: int,
           keys: list[str] = maintenance.UPSERT_KEY, order: tuple[str, ...] = ("created_at", "id")) -> bool:
    """Upsert into a table in key buckets: only buckets with changed keys are read and written; replaced rows get ``updated_at``."""
    if table.holds(source, batch):
        return False
    parts = table.touched(changes)
    rows = maintenance.upsert_touching(table.read(parts), changes, now, keys, order)
    return table.replace(rows, parts, source, batch)
