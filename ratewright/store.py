"""Tables that are changed in place: partitioned Parquet folders behind a version pointer.

A commit writes the touched partitions anew into a folder of its own, then publishes a
small manifest that says in which folder each partition now is. Readers take the highest
manifest, so they see a commit whole or not at all; what a run that broke off has written
is in no manifest and goes with the next clean-up. A manifest has an entry per partition,
and that is all the driver ever holds.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Times a commit starts anew when another one was published meanwhile.
TRIES = 5

Partition = tuple[str, ...]


class ConflictError(RuntimeError):
    """Other commits were published first, as often as this one was tried."""


@dataclass
class Manifest:
    """A version: the folder of each partition, and the last batch of each writer."""

    version: int = 0
    folders: dict[Partition, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"version": self.version, "folders": [[list(k), v] for k, v in sorted(self.folders.items())], "batches": self.batches})

    @classmethod
    def load(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(found["version"], {tuple(k): v for k, v in found["folders"]}, found["batches"])


class _Folder:
    """What a table needs of the file system that its path is in."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsparkSession.sessionState().newHadoopConf()
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.root.getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file whole under a name that nobody has taken; False where somebody has."""
        draft = self.path(f"drafts/{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        keep = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        self.fs.mkdirs(self.path(name).getParent())
        if self.fs.exists(self.path(name)):
            self.delete(f"drafts/{draft.getName()}")
            return False
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(self.path(name)), keep)
            return True
        except Exception as e:
            self.delete(f"drafts/{draft.getName()}")
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class StoredTable:
    """A table under ``path`` with one row per ``keys``.

    ``partitions`` gives each partition column its SQL expression over the row; files hold the
    rows' own columns only, so the partitioning can follow from any of them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], partitions: dict[str, str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        # values become folder names as they are; what a name cannot hold is replaced, at worst two values share a folder
        self.partitions = {f"in_{c}": f"coalesce(regexp_replace(cast({e} as string), '[^A-Za-z0-9_.-]', '_'), 'none')" for c, e in (partitions or {"part": "'all'"}).items()}
        self.folder = _Folder(spark, self.path)

    # --- reading ---

    def manifest(self, version: int | None = None) -> Manifest:
        names = self.folder.names("versions")
        if version is not None:
            names = [n for n in names if int(n.split(".")[0]) == version]
        return Manifest.load(self.folder.text(f"versions/{names[-1]}")) if names else Manifest()

    def read(self, version: int | None = None, only: Iterable[Partition] | None = None) -> DataFrame:
        """The rows of a version, the last one by default; ``only``: of these partitions, the others are not opened."""
        manifest = self.manifest(version)
        return self._rows(manifest, manifest.folders if only is None else set(only) & manifest.folders.keys())

    def _rows(self, manifest: Manifest, parts: Iterable[Partition]) -> DataFrame:
        paths = [f"{self.path}/data/{manifest.folders[p]}/" + "/".join(f"{c}={v}" for c, v in zip(self.partitions, p)) for p in sorted(parts)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def partitions_of(self, rows: DataFrame) -> set[Partition]:
        """The partitions that rows with the columns of the partition expressions lie in."""
        found = rows.select(*(F.expr(e).alias(c) for c, e in self.partitions.items())).distinct().collect()  # at most all partitions
        return {tuple(r) for r in found}

    # --- writing ---

    def _write(self, rows: DataFrame, name: str) -> set[Partition]:
        """Write rows under the folder ``name`` by partition, and say which ones these are."""
        split = rows.withColumns({c: F.expr(e) for c, e in self.partitions.items()})
        split.hint("rebalance", *map(F.col, self.partitions)).write.partitionBy(*self.partitions).mode("errorifexists").parquet(f"{self.path}/{name}")
        written = [()]
        for c in self.partitions:
            written = [(*p, n[len(c) + 1 :]) for p in written for n in self.folder.names("/".join([name, *(f"{d}={v}" for d, v in zip(self.partitions, p))])) if n.startswith(f"{c}=")]
        return set(written)

    def _staged(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(schema.names)

    def commit(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, writer: str | None = None, batch: int | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Delete the rows that ``deletes`` names by some of the columns, put ``upserts`` over those of the same keys, and give the version.

        Of several upserts with the same keys the greatest by its other columns stays; a
        row deleted and upserted at once is there. With ``writer`` and ``batch``, a batch not
        above the writer's last one changes nothing, so a repeated delivery counts once. Both
        inputs are written down first and read from there, however often the commit is tried.
        """
        if writer is not None and (batch is None or batch <= self.manifest().batches.get(writer, -1)):
            return self.manifest().version
        stage = f"stage/{uuid.uuid4().hex}"
        rest = [c for c in self.schema.names if c not in self.keys]
        touched: set[Partition] = set()
        gone: list[tuple[list[str], DataFrame]] = []
        fresh = None
        if upserts is not None:
            rows = upserts.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
            if rest:
                rows = rows.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*self.keys, "__r.*").select(self.schema.names)
            else:
                rows = rows.distinct()
            touched |= self._write(rows, f"{stage}/upserts")
            if touched:
                fresh = self._staged(f"{stage}/upserts", self.schema)
                gone.append((self.keys, fresh.select(self.keys)))
        if deletes is not None:
            deletes.distinct().write.parquet(f"{self.path}/{stage}/deletes")
            named = self._staged(f"{stage}/deletes", deletes.schema)
            gone.append((deletes.columns, named))
        try:
            for _ in range(TRIES):
                base = self.manifest()
                if writer is not None and batch <= base.batches.get(writer, -1):
                    return base.version
                # with deletes, the partitions that hold any of the rows to go; a partition that has none stays as it is
                hit = self._partitions_hit(base, *gone[-1]) if deletes is not None else set()
                parts = touched | hit
                old = self._rows(base, parts & base.folders.keys())
                kept = reduce(lambda rows, by: rows.join(by[1].select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in by[0])), by[0], "left_anti"), gone, old)
                rows = kept.select(self.schema.names).unionByName(fresh) if fresh is not None else kept.select(self.schema.names)
                name = uuid.uuid4().hex
                written = self._write(rows, f"data/{name}") if parts else set()
                folders = {p: f for p, f in base.folders.items() if p not in parts} | {p: name for p in written}
                batches = base.batches | ({writer: batch} if writer is not None else {})
                if before_publish:
                    before_publish()
                new = Manifest(base.version + 1, folders, batches)
                if self.folder.publish(f"versions/{new.version:012d}.json", new.dump()):
                    return new.version
            raise ConflictError(f"{self.path}: {TRIES} commits were overtaken")
        finally:
            self.folder.delete(stage)

    def _partitions_hit(self, base: Manifest, columns: list[str], named: DataFrame) -> set[Partition]:
        """Partitions with rows that are named; where the names tell the partition, only those are looked into."""
        parts: Iterable[Partition] = base.folders
        try:
            parts = self.partitions_of(named) & base.folders.keys()
        except Exception as e:  # the names lack a column of the partitions' expressions
            if "UNRESOLVED_COLUMN" not in str(e):
                raise
        if not parts:
            return set()
        rows = self._rows(base, parts)
        same = named.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns))
        return self.partitions_of(rows.join(same, columns, "left_semi"))

    def vacuum(self, keep: int = 1) -> None:
        """Delete all versions but the last ``keep``, and every folder that none of those names; no commit may be under way."""
        names = self.folder.names("versions")
        kept = names[-keep:]
        used = {f for n in kept for f in Manifest.load(self.folder.text(f"versions/{n}")).folders.values()}
        for n in names[:-keep]:
            self.folder.delete(f"versions/{n}")
        for n in self.folder.names("data"):
            if n not in used:
                self.folder.delete(f"data/{n}")
        self.folder.delete("stage")
        self.folder.delete("drafts")
