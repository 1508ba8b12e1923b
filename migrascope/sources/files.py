"""The ``tsfiles`` data source: TypeScript files of a tree, as a batch or as a stream of changes.

Spark's own file sources leave out names that begin with ``_`` or ``.`` and
never show a changed file again; this one walks the tree itself, prunes while
it walks, and compares snapshots.

Options: ``path`` (root), ``recursive`` (true), ``skip_dirs`` (JSON list, on
top of the built-in ones), ``follow_links`` (false), ``paths`` (JSON list: read
these files instead of walking), ``files_per_partition`` (200), ``state_dir``
(stream: where snapshots are kept; without it the offset holds the snapshot),
``max_files_per_batch`` (stream), ``quiet_ms`` (stream: a file counts as changed
once it has been quiet that long).
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..functions.paths import SKIP_DIRS
from .ignore import Ignored

BATCH_SCHEMA = "path string, rel_path string, content binary, mtime bigint, error string"
STREAM_SCHEMA = "path string, rel_path string, deleted boolean, mtime bigint, ts timestamp"
SUFFIXES = (".ts", ".tsx")


class WalkError(ValueError):
    """The tree can't be walked: no such directory, or a path that isn't UTF-8."""


def check_root(root: str) -> str:
    """The canonical path of an existing directory."""
    if not os.path.exists(root):
        raise WalkError(f"path does not exist: {root}")
    if not os.path.isdir(root):
        raise WalkError(f"path is not a directory: {root}")
    return os.path.realpath(root)


def walk(root: str, recursive: bool = True, skip_dirs: tuple[str, ...] = (), follow_links: bool = False) -> Iterator[str]:
    """TypeScript files below ``root``, sorted.

    Hidden entries, ignored ones and the directories to skip are never
    entered.  A root that itself lies in such a directory has no files.
    """
    root = check_root(root)
    skip = {*SKIP_DIRS, *skip_dirs}
    if skip & set(root.split("/")):
        return
    ignored, seen = Ignored(root), set()

    def fail(e: OSError) -> None:
        raise WalkError(str(e))

    for directory, dirs, names in os.walk(root, followlinks=follow_links, onerror=fail):
        real = os.path.realpath(directory)
        if real in seen:
            dirs[:] = []
            continue
        seen.add(real)
        ignored.enter(directory)
        dirs[:] = sorted(d for d in dirs if d not in skip and not d.startswith(".") and not ignored.drops(os.path.join(directory, d), True)) if recursive else []
        for name in sorted(names):
            path = os.path.join(directory, name)
            if not name.endswith(SUFFIXES) or name in SUFFIXES or name.startswith(".") or name in skip or ignored.drops(path, False):
                continue
            if os.path.islink(path) and not follow_links:
                continue
            try:
                path.encode("utf-8")
            except UnicodeEncodeError as e:
                raise WalkError(f"path is not UTF-8: {path!r}") from e
            yield path


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class _Options:
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}.get
        self.root = get("path", "")
        self.recursive = str(get("recursive", "true")).lower() == "true"
        self.follow = str(get("follow_links", "false")).lower() == "true"
        self.skip = tuple(json.loads(get("skip_dirs", "[]")))
        self.paths = json.loads(get("paths", "null"))
        self.chunk = int(get("files_per_partition", 200))
        self.state = get("state_dir", "")
        self.most = int(get("max_files_per_batch", 0))
        self.quiet = int(get("quiet_ms", 0))

    def files(self) -> list[str]:
        return sorted(self.paths) if self.paths is not None else list(walk(self.root, self.recursive, self.skip, self.follow))

    def rel(self, path: str) -> str:
        return os.path.relpath(path, os.path.realpath(self.root)) if self.root else path


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = _Options(options)

    def partitions(self) -> list[InputPartition]:
        files = self.options.files()
        return [Files(files[i : i + self.options.chunk]) for i in range(0, len(files), self.options.chunk)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            content = mtime = error = None
            try:
                with open(path, "rb") as f:
                    content, mtime = f.read(), os.fstat(f.fileno()).st_mtime_ns
            except OSError as e:
                # of a list, a file that is gone is no error: all of its row is null
                if self.options.paths is None or not isinstance(e, FileNotFoundError):
                    error = e.strerror or str(e)
            yield path, self.options.rel(path), content, mtime, error


class ChangeReader(SimpleDataSourceStreamReader):
    """Changed, new and deleted files between two snapshots of {path: mtime}."""

    def __init__(self, options: dict):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"snapshot": {}}

    def _load(self, offset: dict) -> dict[str, int]:
        if "snapshot" in offset:
            return offset["snapshot"]
        with open(os.path.join(self.options.state, offset["digest"] + ".json"), encoding="utf-8") as f:
            return json.load(f)

    def _offset(self, snapshot: dict[str, int]) -> dict:
        if not self.options.state:
            return {"snapshot": snapshot}
        text = json.dumps(snapshot, sort_keys=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        os.makedirs(self.options.state, exist_ok=True)
        path = os.path.join(self.options.state, digest + ".json")
        if not os.path.exists(path):
            with open(path + ".tmp", "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(path + ".tmp", path)
        return {"digest": digest}

    def _now(self) -> dict[str, int]:
        out = {}
        for path in self.options.files():
            try:
                out[path] = os.stat(path).st_mtime_ns
            except OSError:
                continue
        return out

    def _rows(self, before: dict[str, int], after: dict[str, int]) -> list[tuple]:
        from datetime import UTC, datetime

        now = datetime.fromtimestamp(time.time(), UTC)
        rows = [(p, self.options.rel(p), False, m, now) for p, m in sorted(after.items()) if before.get(p) != m]
        return rows + [(p, self.options.rel(p), True, None, now) for p in sorted(before.keys() - after.keys())]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, after = self._load(start), self._now()
        if self.options.quiet:  # what changed a moment ago may go on changing: it waits for a later look
            edge = time.time_ns() - self.options.quiet * 1_000_000
            for path in [p for p, m in after.items() if m > edge and before.get(p) != m]:
                if path in before:
                    after[path] = before[path]
                else:
                    del after[path]
        rows = self._rows(before, after)
        if self.options.most and len(rows) > self.options.most:
            rows = rows[: self.options.most]
            after_all, after = after, dict(before)
            for path, _, deleted, _, _ in rows:
                if deleted:
                    after.pop(path, None)
                else:
                    after[path] = after_all[path]
        return iter(rows), self._offset(after)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(self._load(start), self._load(end)))

    def commit(self, end: dict) -> None:
        pass


class TypeScriptFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tsfiles"

    def schema(self) -> str:
        return BATCH_SCHEMA if str(self.options.get("changes", "false")).lower() != "true" else STREAM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return ChangeReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(TypeScriptFiles)


def tree(spark, root: str, *, recursive: bool = True, skip_dirs: tuple[str, ...] = (), follow_links: bool = False):
    """(path, rel_path, content, mtime, error) of the TypeScript files below ``root``; content of one that can't be read is null."""
    register(spark)
    check_root(root)
    r = spark.read.format("tsfiles").option("recursive", recursive).option("skip_dirs", json.dumps(list(skip_dirs))).option("follow_links", follow_links)
    return r.load(root)


def listed(spark, paths: list[str], root: str = ""):
    """The same for a list of files; those that are gone have neither content nor error."""
    register(spark)
    r = spark.read.format("tsfiles").option("paths", json.dumps(paths))
    return r.load(root) if root else r.load()


def changes(spark, root: str, *, state_dir: str = "", recursive: bool = True, skip_dirs: tuple[str, ...] = (), max_files: int = 0, quiet_ms: int = 0):
    """Stream of (path, rel_path, deleted, mtime, ts)."""
    register(spark)
    check_root(root)
    r = spark.readStream.format("tsfiles").option("changes", "true").option("recursive", recursive).option("skip_dirs", json.dumps(list(skip_dirs))).option("max_files_per_batch", max_files).option("quiet_ms", quiet_ms)
    r = r.option("state_dir", state_dir) if state_dir else r
    return r.load(root)
