"""The latest state per path: upsert, deletion, change detection, and a table on shared storage."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_by(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per ``key``: the last by ``order``.  Combines before the shuffle; no sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(key, "__last.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "path", *, deleted: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key.

    Rows of ``new`` in which the flag ``deleted`` is true remove theirs.
    """
    gone = new.select(key).distinct()
    keep = old.join(gone, key, "left_anti")
    fresh = new.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else new
    return keep.unionByName(fresh)


def remove(rows: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def needs_update(new: DataFrame, old: DataFrame, key: str = "path", hash_column: str = "content_hash") -> DataFrame:
    """Rows of ``new`` that are missing in ``old`` or have another hash there."""
    was = old.select(F.col(key).alias("__key"), F.col(hash_column).alias("__hash"), F.lit(True).alias("__there"))
    d = new.join(was, F.col(key) == F.col("__key"), "left")
    return d.where(F.col("__there").isNull() | ~F.col(hash_column).eqNullSafe(F.col("__hash"))).drop("__key", "__hash", "__there")


class Store:
    """A versioned table: a base and runs of changes; the pointer with the highest number names the current ones.

    A change run takes in the changes alone.  Runs are merged while the one
    before is at most twice as large, so there are few, and the base is
    written anew once they hold a quarter of its rows: what is written stays
    in proportion to what changes, not to the table.

    A pointer appears by a rename and is never replaced, so a reader sees one
    whole version, and a write that fails at any point leaves the one before.
    The version before the current one stays for those who still read it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _numbers(self) -> list[int]:
        """The pointers there are, in order."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path(self.path))]
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def _at(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/current-{number}", wholetext=True).first()[0])

    def _pointer(self) -> dict | None:
        numbers = self._numbers()
        return self._at(numbers[-1]) if numbers else None

    def _parquet(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def _last(self, runs: list, key: str) -> DataFrame:
        """Each key's rows in the last of the runs that has it, removed ones marked."""
        d = reduce(DataFrame.unionByName, [self._parquet(folder).withColumn("__run", F.lit(i)) for i, (folder, _) in enumerate(runs)])
        newest = d.groupBy(key).agg(F.max("__run").alias("__run"))
        return d.join(newest, [key, "__run"], "left_semi").drop("__run")

    def _rows(self, now: dict) -> DataFrame:
        base = self._parquet(now["version"])
        if not now.get("runs"):
            return base
        return upsert(base, self._last(now["runs"], now["key"]), now["key"], deleted="__gone").select(*base.columns)

    def read(self) -> DataFrame | None:
        now = self._pointer()
        return self._rows(now) if now else None

    def get(self, key: str, column: str = "path"):
        """The row of one key; None if there is none."""
        now = self.read()
        return None if now is None else now.where(F.col(column) == key).first()

    def contains(self, key: str, column: str = "path") -> bool:
        return self.get(key, column) is not None

    def size(self) -> int:
        now = self.read()
        return 0 if now is None else now.count()

    def clear(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def batch(self) -> int:
        """Number of the last stream batch taken in; -1 before any."""
        return (self._pointer() or {}).get("batch", -1)

    def _folder(self, rows: DataFrame) -> tuple[str, int]:
        """Write rows to a new folder: its name and how many they are."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}")
        return name, self._parquet(name).count()

    def _publish(self, now: dict, numbers: list[int]) -> None:
        fs, path = self._fs()
        tmp = path(f"{self.path}/new-{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.writeBytes(json.dumps(now))
        out.close()
        if not fs.rename(tmp, path(f"{self.path}/current-{(numbers[-1] if numbers else 0) + 1}")):
            raise RuntimeError(f"another writer was faster in {self.path}")
        folders = lambda p: {p["version"], *(f for f, _ in p.get("runs", []))}
        held = folders(now) | (folders(self._at(numbers[-1])) if numbers else set())
        for old in numbers[:-1]:
            for folder in folders(self._at(old)) - held:
                fs.delete(path(f"{self.path}/{folder}"), True)
            fs.delete(path(f"{self.path}/current-{old}"), False)

    def write(self, rows: DataFrame, batch: int = -1) -> None:
        """Replace the whole table."""
        numbers = self._numbers()
        version, n = self._folder(rows)
        self._publish({"version": version, "rows": n, "batch": batch}, numbers)

    def upsert(self, new: DataFrame, key: str = "path", *, deleted: str | None = None, batch: int = -1) -> None:
        """Take in changes; a stream batch that was taken in already changes nothing."""
        numbers = self._numbers()
        now = self._at(numbers[-1]) if numbers else None
        if now is None:
            self.write(new.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else new, batch)
            return
        if 0 <= batch <= now["batch"]:
            return
        if now.get("key", key) != key:  # runs of another key are taken in first
            self.write(upsert(self._rows(now), new, key, deleted=deleted), batch)
            return
        columns = self._parquet(now["version"]).columns
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        runs = [*now.get("runs", []), self._folder(new.withColumn("__gone", gone).select(*columns, "__gone"))]
        made = {runs[-1][0]}
        if 4 * sum(n for _, n in runs) >= now["rows"]:
            self.write(self._rows(now | {"runs": runs, "key": key}), batch)
        else:
            take, total = 1, runs[-1][1]
            while take < len(runs) and runs[-take - 1][1] <= 2 * total:
                take, total = take + 1, total + runs[-take - 1][1]
            if take > 1:
                runs = [*runs[:-take], self._folder(self._last(runs[-take:], key))]
            self._publish(now | {"runs": runs, "key": key, "batch": batch}, numbers)
        fs, path = self._fs()
        for folder in made - {f for f, _ in (self._pointer() or {}).get("runs", [])}:  # merged at once
            fs.delete(path(f"{self.path}/{folder}"), True)
