"""Tables that are changed by atomic commits: upserts, replaced documents, appends and revisions.

A table is a folder: ``data`` has Parquet files, written by Spark and never changed, and ``log``
has a manifest for each version that names the folders which make it up.  A change writes new
files first and then publishes the next manifest under a name that nobody else can take: by a
hard link or by a rename that fails where the name exists.  Until then the version before it is
what readers see, also when the writer dies.

Rows of a table with keys are dealt to ``parts`` by a hash of them; a change rewrites only the
parts that its keys fall in.  A writer whose parts were changed since it began is refused
(``Conflict``); one that changed other parts is put behind.  Tables without keys only grow, and
appending to them shuffles nothing.

The file system has to have an atomic rename or hard links (HDFS, local and network disks);
plain object stores do not.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import govern, records


class Conflict(Exception):
    """The rows of this change were changed by another writer since it began."""


class VersionedTable:
    """A table in a folder; ``create`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        first = self._manifest(0)
        self.schema, self.keys, self.parts = StructType.fromJson(first["schema"]), first["keys"], first["parts"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, keys: list[str] | None = None, parts: int = 64) -> VersionedTable:
        """An empty table; ``Conflict`` where there is one."""
        schema = spark.createDataFrame([], schema).schema
        table = cls.__new__(cls)
        table.spark, table.path = spark, path.rstrip("/")
        if not table._claim(0, {"op": "create", "schema": schema.jsonValue(), "keys": keys or [], "parts": parts if keys else 0, "files": [], "changed": [], "txn": {}}):
            raise Conflict(f"{path} is a table already")
        return cls(spark, path)

    # --- the log

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _name(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def _manifest(self, version: int) -> dict:
        p, fs = self._fs(self._name(version))
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version."""
        p, fs = self._fs(f"{self.path}/log")
        return max(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.endswith(".json") and n[0] != ".")

    def history(self) -> list[dict]:
        return [{"version": v, **{k: m[k] for k in ("op", "changed", "txn")}} for v in range(self.version() + 1) for m in [self._manifest(v)]]

    def _claim(self, version: int, manifest: dict) -> bool:
        """Publishes a version; false where another writer has taken its number."""
        draft, name = f"{self.path}/log/.{uuid.uuid4().hex}", self._name(version)
        p, fs = self._fs(draft)
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"version": version, **manifest}).encode()))
        out.close()
        to, _ = self._fs(name)
        try:
            if fs.getScheme() == "file":  # its rename would replace the file
                try:
                    os.link(p.toUri().getPath(), to.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not fs.exists(to) and bool(fs.rename(p, to))
        finally:
            fs.delete(p, False)

    def _commit(self, base: int, op: str, folder: str, changed: list[int], drop: bool, txn: tuple[str, int] | None) -> int | None:
        """Publishes ``folder`` (in place of ``changed`` parts with ``drop``) behind the newest version.

        None where the transaction was committed before.
        """
        p, fs = self._fs(folder)
        there = sorted(int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("_part=")) if self.keys else None
        while True:
            now = self.version()
            last = self._manifest(now)
            if txn and last["txn"].get(txn[0], -1) >= txn[1]:
                fs.delete(p, True)
                return None
            if drop:
                for v in range(base + 1, now + 1):
                    if set(self._manifest(v)["changed"]) & set(changed):
                        fs.delete(p, True)
                        raise Conflict(f"version {v} changed the same part of {self.path}")
            files = [{"folder": f["folder"], "parts": [x for x in f["parts"] if not drop or x not in changed]} for f in last["files"]] if self.keys else last["files"]
            files = [f for f in [*files, {"folder": folder, "parts": there}] if f["parts"] != []]
            made = {"op": op, "files": files, "changed": changed, "txn": {**last["txn"], **({txn[0]: txn[1]} if txn else {})}}
            if self._claim(now + 1, made):
                return now + 1

    # --- reading

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the newest unless told), of some parts where told."""
        files = self._manifest(self.version() if version is None else version)["files"]
        paths = [f["folder"] for f in files if f["parts"] is None] + [f"{f['folder']}/_part={p}" for f in files for p in f["parts"] or [] if only is None or p in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- changes

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.parts)).cast("int")

    def _fit(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])

    def append(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Adds rows.  Nothing else that goes on is in its way."""
        base, folder = self.version(), f"{self.path}/data/{uuid.uuid4().hex}"
        if not self.keys:
            self._fit(rows).write.parquet(folder)
            return self._commit(base, "append", folder, [], False, txn)
        self._fit(rows).withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(folder)
        p, fs = self._fs(folder)
        changed = sorted(int(n.split("=")[1]) for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("_part="))
        return self._commit(base, "append", folder, changed, False, txn)

    def rewrite(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], op: str = "rewrite", txn: tuple[str, int] | None = None, base: int | None = None) -> int | None:
        """Puts ``merge(old, rows)`` in place of the parts that the keys of ``rows`` fall in.

        ``rows`` have the keys and whatever ``merge`` needs; ``old`` are the table's rows in those
        parts at version ``base`` (the newest unless told).  The rows are written first, so they are
        computed once.  No rows change nothing but commit the transaction.
        """
        if not self.keys:
            raise ValueError("a table without keys only grows")
        base = self.version() if base is None else base
        if txn and self._manifest(base)["txn"].get(txn[0], -1) >= txn[1]:
            return None
        new, folder = f"{self.path}/data/.new-{uuid.uuid4().hex}", f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("_part", self._part()).write.parquet(new)
        try:
            given = self.spark.read.parquet(new)
            changed = sorted(given.select("_part").distinct().toArrow().column(0).to_pylist())  # no more than parts
            merged = self._fit(merge(self.read(base, changed), given.drop("_part")))
            merged.withColumn("_part", self._part()).repartition(max(1, len(changed)), "_part").write.partitionBy("_part").parquet(folder)
            return self._commit(base, op, folder, changed, True, txn)
        finally:
            p, fs = self._fs(new)
            fs.delete(p, True)

    def upsert(self, rows: DataFrame, stamp: str, txn: tuple[str, int] | None = None, base: int | None = None) -> int | None:
        """One row per key, the newest by ``stamp``; of equal stamps the new one."""
        return self.rewrite(rows, lambda old, new: govern.upsert(old, self._fit(new), self.keys, stamp), "upsert", txn, base)

    def replace_chunks(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> int | None:
        """Redacted chunks in place of their documents' pending and sanitized ones; the key is the document."""
        return self.rewrite(rows, govern.replace_chunks, "replace", txn)

    def revise(self, edits: DataFrame, txn: tuple[str, int] | None = None, base: int | None = None) -> DataFrame:
        """Writes edits (key, at, expected, ...) of rows with a revision; returns (key, at, outcome, revision).

        As ``records.revise`` judges them: edits that expect another revision than the row has are
        conflicts and write nothing.
        """
        (key,), judged = self.keys, f"{self.path}/outcomes/{uuid.uuid4().hex}"

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            records.revise(old.select(key, "revision"), new.select(key, "at", "expected"), key).write.parquet(judged)
            won = self.spark.read.parquet(judged).where("outcome != 'conflict'").select(key, "at", "revision")
            fresh = self._fit(new.drop("revision").join(won, [key, "at"]))
            return old.join(won.select(key), key, "left_anti").select(*old.columns).unionByName(fresh)

        self.rewrite(edits, merge, "revise", txn, base)
        return self.spark.read.parquet(judged)

    def swap(self, base: int, folder: str) -> int:
        """Puts one folder in place of those of a version of a table without keys, as compaction does.

        ``Conflict`` when anything was appended since.
        """
        if self.keys or not self._claim(base + 1, {**{k: self._manifest(base)[k] for k in ("changed", "txn")}, "op": "swap", "files": [{"folder": folder, "parts": None}]}):
            raise Conflict(f"{self.path} is not at version {base}")
        return base + 1

    def batch_sink(self, app: str, change: Callable[[DataFrame, tuple[str, int]], object]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: ``change(rows, txn)`` of each batch, once however often it is tried."""

        def sink(rows: DataFrame, batch: int) -> None:
            if self._manifest(self.version())["txn"].get(app, -1) < batch:
                change(rows, (app, batch))

        return sink

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the ``keep`` newest versions has; older versions can no longer be read.

        Only while no change is under way.
        """
        now = self.version()
        live = {f["folder"].rsplit("/", 1)[1] for v in range(max(0, now - keep + 1), now + 1) for f in self._manifest(v)["files"]}
        p, fs = self._fs(f"{self.path}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in live] if fs.exists(p) else []
        for g in gone:
            fs.delete(g, True)
        return len(gone)
