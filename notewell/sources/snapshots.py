"""Versions of an index: rows in buckets by a hash of their path, other tables beside them, one manifest for each version.

A version is a small file that names, for every bucket and table, the folder that holds it; folders never change once they
are named. A commit writes the buckets that differ to new folders, then creates the manifest of the next number in one
move: a reader sees the old version or the new one, and of two writers that started from the same version one loses. What
is written follows what changed, not the size of the index.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import Folder
from .index_store import WrongOwner

BUCKETS = 64
BROADCAST_PATHS = 1_000_000
_MANIFESTS = "manifests"


class Conflict(Exception):
    """Another writer has committed since the version that this commit is based on."""


@dataclass(frozen=True)
class Version:
    number: int
    vault: str
    buckets: int
    schema: str  # of the rows, as JSON
    rows: Mapping[str, str]  # folder by bucket; buckets without rows are absent
    tables: Mapping[str, str] = field(default_factory=dict)  # folder by name
    facts: Mapping[str, object] = field(default_factory=dict)
    created: float = 0.0

    @property
    def folders(self) -> set[str]:
        return {*self.rows.values(), *self.tables.values()}


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, vault: str, buckets: int = BUCKETS):
        self.spark, self.path, self.vault, self.buckets = spark, path.rstrip("/"), vault, buckets
        self.folder = Folder(spark, path)

    # Versions ------------------------------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        return [int(n.removeprefix("v").removesuffix(".json")) for n in self.folder.names(_MANIFESTS) if n.endswith(".json")]

    def version(self, number: int | None = None) -> Version | None:
        """The given or the newest version that can be read."""
        for n in [number] if number is not None else sorted(self.numbers(), reverse=True):
            found = self.folder.read(self._name(n))
            if found:
                return Version(**found)
        return None

    def _name(self, number: int) -> str:
        return f"{_MANIFESTS}/v{number:08d}.json"

    def exists(self) -> bool:
        return self.version() is not None

    def guard(self, force: bool = False) -> None:
        """Refuses an index of another vault, unless forced; an index without an owner passes."""
        found = self.version()
        if found and found.vault and found.vault != self.vault and not force:
            raise WrongOwner(f"the index in {self.path} belongs to {found.vault}")

    # Reading -------------------------------------------------------------------------------------------------------

    def rows(self, version: Version | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version (the newest one), or of some of its buckets. Later commits do not change them."""
        found = version or self.version()
        if found is None:
            raise FileNotFoundError(f"no index in {self.path}")
        wanted = found.rows if buckets is None else {k: v for k, v in found.rows.items() if int(k) in set(buckets)}
        schema = T.StructType.fromJson(json.loads(found.schema))
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in sorted(wanted.values())])

    def table(self, name: str, version: Version | None = None) -> str:
        """The folder of another table of a version."""
        found = version or self.version()
        if found is None or name not in found.tables:
            raise FileNotFoundError(f"no {name} in {self.path}")
        return f"{self.path}/{found.tables[name]}"

    # Writing -------------------------------------------------------------------------------------------------------

    def bucket(self, path: Column | str = "relative_path", buckets: int | None = None) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(buckets or self.buckets)).cast("int")

    def _write(self, rows: DataFrame, buckets: int) -> dict[str, str]:
        folder = f"rows/{uuid.uuid4().hex[:12]}"
        # Large buckets are dealt over several tasks, so none sorts more rows than it holds.
        dealt = rows.withColumn("_bucket", self.bucket(buckets=buckets)).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{self.path}/{folder}")
        names = [n for n in self.folder.names(folder) if n.startswith("_bucket=")]
        return {n.removeprefix("_bucket="): f"{folder}/{n}" for n in names}

    def commit(
        self,
        base: Version | None,
        rows: Mapping[str, str],
        schema: T.StructType,
        tables: Mapping[str, Callable[[DataFrame, str], None]],
        facts: Mapping[str, object],
        buckets: int,
    ) -> Version:
        """The version after base: its rows, other tables written from them, and the manifest last."""
        number = (base.number if base else max(self.numbers(), default=0)) + 1
        made = Version(number, self.vault, buckets, schema.json(), dict(rows), {}, dict(facts), time.time())
        now = self.rows(made)
        folders = {}
        for name, write in tables.items():
            folders[name] = f"{name}/{uuid.uuid4().hex[:12]}"
            write(now, f"{self.path}/{folders[name]}")
        made = Version(**{**made.__dict__, "tables": folders})
        if not self.folder.create(self._name(number), made.__dict__):
            raise Conflict(f"version {number} of {self.path} was committed by another writer")
        return made

    def replace(self, rows: DataFrame, tables: Mapping[str, Callable[[DataFrame, str], None]] | None = None, facts: Mapping[str, object] | None = None) -> Version:
        """A version with these rows alone. `tables` write further tables from the rows to the folder they are given."""
        written = self._write(rows, self.buckets)
        base = self.version()
        newest = max(self.numbers(), default=0)
        base = Version(**{**base.__dict__, "number": newest}) if base else None
        return self.commit(base, written, rows.schema, tables or {}, facts or {}, self.buckets)

    def merge(
        self, changed: DataFrame, fresh: DataFrame, tables: Mapping[str, Callable[[DataFrame, str], None]] | None = None, facts: Mapping[str, object] | None = None
    ) -> Version:
        """The newest version without the rows of changed paths, and with the fresh rows of those that are not deleted.

        changed: relative_path, change_type. Only buckets that hold a changed path are read and written. The same merge
        once more gives the same rows.
        """
        base = self.version()
        if base is None:
            raise FileNotFoundError(f"no index in {self.path}")
        changed = changed.select("relative_path", "change_type").persist(StorageLevel.MEMORY_AND_DISK)
        # Up to a bound the changed paths go to every task, and the rows of the index are not shuffled to meet them.
        named = F.broadcast if changed.count() <= BROADCAST_PATHS else lambda df: df
        # At most as many numbers as there are buckets.
        touched = sorted(r[0] for r in changed.select(self.bucket(buckets=base.buckets).alias("b")).distinct().collect())
        old = self.rows(base, touched)
        kept = old.join(named(changed.select("relative_path")), "relative_path", "left_anti")
        added = fresh.join(named(changed.filter("change_type != 'deleted'").select("relative_path")), "relative_path", "left_semi")
        written = self._write(kept.unionByName(added).select(*old.columns), base.buckets) if touched else {}
        changed.unpersist()
        rows = {k: v for k, v in base.rows.items() if int(k) not in touched} | written
        return self.commit(base, rows, old.schema, tables or {}, facts or base.facts, base.buckets)

    # Keeping -------------------------------------------------------------------------------------------------------

    def backup(self, name: str) -> None:
        """Copies the newest version, with all its folders, to backups/name."""
        found = self.version()
        if found is None:
            raise FileNotFoundError(f"no index in {self.path}")
        for f in sorted(found.folders):
            self.folder.copy(f, f"backups/{name}/{f}")
        self.folder.create(f"backups/{name}/manifest.json", found.__dict__)

    def restore(self, name: str) -> Version:
        """Makes a backup the newest version."""
        found = self.folder.read(f"backups/{name}/manifest.json")
        if found is None:
            raise FileNotFoundError(f"no backup {name} in {self.path}")
        old = Version(**found)
        at = lambda folders: {k: f"backups/{name}/{v}" for k, v in folders.items()}
        number = max(self.numbers(), default=0) + 1
        made = Version(**{**old.__dict__, "number": number, "rows": at(old.rows), "tables": at(old.tables), "created": time.time()})
        if not self.folder.create(self._name(number), made.__dict__):
            raise Conflict(f"version {number} of {self.path} was committed by another writer")
        return made

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forgets all but the newest `keep` versions and deletes the folders that no kept one names. Backups stay.

        For use while nobody writes: folders of a commit under way have no manifest yet.
        """
        numbers = sorted(self.numbers())
        for n in numbers[: max(0, len(numbers) - max(1, keep))]:
            self.folder.delete(self._name(n))
        held = set().union(*(v.folders for v in map(self.version, sorted(self.numbers())) if v))
        gone = []
        for top in self.folder.names():
            if top in (_MANIFESTS, "backups") or top.startswith("_"):
                continue
            for run in self.folder.names(top):
                mine = [f"{top}/{run}"] if top != "rows" else [f"{top}/{run}/{b}" for b in self.folder.names(f"{top}/{run}") if "=" in b]
                dead = [f for f in mine if f not in held]
                for f in dead if len(dead) < len(mine) else [f"{top}/{run}"]:
                    self.folder.delete(f)
                    gone.append(f)
        return gone

    def clear(self) -> None:
        """Deletes all versions and tables; backups stay."""
        for top in self.folder.names():
            if top != "backups":
                self.folder.delete(top)

    def stats(self) -> dict:
        found = self.version()
        if found is None:
            return {"exists": False}
        size = sum(map(self.folder.bytes, found.folders))
        return {"exists": True, "vault": found.vault, "version": found.number, "buckets": len(found.rows), "bytes": size, **found.facts}
