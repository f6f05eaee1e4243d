"""Several tables that change together, one commit per micro-batch.

Each commit has a number and a folder per table. All folders are written first and then one manifest,
a small file that lists what may be read: a snapshot and the commits after it. Readers
follow the newest manifest only, so they see all tables of a commit or none of them; one
that was cut short left folders no manifest names, and the next run overwrites them. The manifest
also holds the last batch of every source (a stream, say), so a batch is not committed twice.

The list in a manifest stays short: ``compact`` merges what is committed into one snapshot
folder per table and commits that. Old folders stay readable through old manifests until
``vacuum`` removes those no longer named.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class Manifests:
    """Numbered manifests under ``base``; the newest says what may be read."""

    EMPTY: dict = {"version": 0, "sources": {}}

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.base}/_commits/*.json")) or []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in found)

    def state(self, version: int | None = None) -> dict:
        """The newest manifest, or that of an older version."""
        known = self.versions()
        if not known:
            return dict(self.EMPTY)
        name = f"{self.base}/_commits/{known[-1] if version is None else version:012d}.json"
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        state = {**state, "version": state["version"] + 1}
        name = f"{state['version']:012d}.json"
        draft, final = (self._path(f"{self.base}/_commits/{n}") for n in (f".{name}.draft", name))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {state['version']} of {self.base} was committed by another writer")

    def holds(self, source: str, batch: int) -> bool:
        """The source's batch is committed: running it again must change nothing."""
        return batch <= self.state()["sources"].get(source, -1)

    def next(self) -> int:
        """The number of the next commit."""
        return self.state()["version"] + 1


class Ledger(Manifests):
    """Tables under ``base``; ``tables`` names each one's schema (a DDL string or a StructType)."""

    EMPTY = {"version": 0, "sources": {}, "snapshot": None, "commits": []}

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, str | StructType]):
        super().__init__(spark, base)
        self.tables = {n: StructType.fromDDL(t) if isinstance(t, str) else t for n, t in tables.items()}

    # --- tables ---

    def folder(self, table: str, number: int) -> str:
        return f"{self.base}/{table}/commit={number}"

    def write(self, table: str, number: int, rows: DataFrame) -> DataFrame:
        """Rows of a table for the commit ``number``, not visible before it; the rows as written."""
        kind = self.tables[table]
        rows.select(*[F.col(f.name).cast(f.dataType) for f in kind]).write.mode("overwrite").parquet(self.folder(table, number))
        return self.spark.read.schema(kind).parquet(self.folder(table, number))

    def commit(self, number: int, source: str, batch: int) -> None:
        """Make everything written for ``number`` visible at once, as the batch of a source."""
        state = self.state()
        if number != state["version"] + 1 or batch <= state["sources"].get(source, -1):
            raise ValueError(f"commit {number} ({source} {batch}) comes after version {state['version']} ({state['sources']})")
        self._commit({**state, "sources": {**state["sources"], source: batch}, "commits": [*state["commits"], number]})

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The committed rows of a table with ``_commit``, the commit they came with (in a snapshot: its last)."""
        state = self.state(version)
        kind = self.tables[table]
        parts = [f"{self.base}/{table}/upto={state['snapshot']}"] if state["snapshot"] is not None else []
        parts += [self.folder(table, n) for n in state["commits"]]
        if not parts:
            return self.spark.createDataFrame([], kind).withColumn("_commit", F.lit(None).cast("long"))
        rows = self.spark.read.schema(kind).parquet(*parts)
        return rows.withColumn("_commit", F.regexp_extract(F.col("_metadata.file_path"), r"/(?:commit|upto)=([0-9]+)/", 1).cast("long"))

    def compact(self, merge: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
        """One snapshot folder per table in place of all commits; ``merge`` reduces a table's rows first."""
        state = self.state()
        if not state["commits"]:
            return
        number = state["version"] + 1
        for table in self.tables:
            rows = self.read(table)
            rows = (merge or {}).get(table, lambda same: same)(rows)
            rows.drop("_commit").write.mode("overwrite").parquet(f"{self.base}/{table}/upto={number}")
        self._commit({**state, "snapshot": number, "commits": []})

    def vacuum(self) -> int:
        """Delete folders the newest manifest doesn't name, and older manifests; how many folders went."""
        state, gone = self.state(), 0
        named = {f"commit={n}" for n in state["commits"]} | {f"upto={state['snapshot']}"}
        for table in self.tables:
            for status in self._fs.globStatus(self._path(f"{self.base}/{table}/*=*")) or []:
                if status.getPath().getName() not in named and int(status.getPath().getName().split("=")[1]) <= state["version"]:
                    gone += bool(self._fs.delete(status.getPath(), True))
        for version in self.versions()[:-1]:
            self._fs.delete(self._path(f"{self.base}/_commits/{version:012d}.json"), False)
        return gone
