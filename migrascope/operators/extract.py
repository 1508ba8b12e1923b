"""Text to rows: imports and exports of each file, by Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, status, text
from ..schema import EXPORT, IMPORT, LEGACY, MODEL_REF, MODERN, PARSED_IMPORT
from ..sources import typescript

_LOCATION = pa.struct([("line", pa.int32()), ("column", pa.int32()), ("byte_offset", pa.int32())])
_IMPORTS = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("names", pa.list_(pa.string())), ("location", _LOCATION)]))
_EXPORTS = pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("location", _LOCATION), ("reexport_source", pa.string())]))


def _parsed(want_imports: bool, want_exports: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            imports, exports, kinds, messages = [], [], [], []
            for path, content, unread in zip(b.column(0), b.column(1), b.column(3), strict=True):
                found_i, found_e, kind, message = [], [], None, None
                try:
                    code = (content.as_py() if content.is_valid else b"").decode("utf-8")
                    tsx = (path.as_py() or "").endswith(".tsx")
                    if want_imports:
                        found_i = [{"path": x.path, "kind": x.kind, "names": x.names, "location": x.location._asdict()} for x in typescript.imports(code, tsx)]
                    if want_exports:
                        found_e = [{"name": x.name, "kind": x.kind, "location": x.location._asdict(), "reexport_source": x.reexport_source} for x in typescript.exports(code, tsx)]
                except UnicodeDecodeError:
                    kind, message = "read", "stream did not contain valid UTF-8"
                if unread.is_valid:
                    kind, message = "read", unread.as_py()
                imports.append(found_i)
                exports.append(found_e)
                kinds.append(kind)
                messages.append(message)
            cols = {"path": b.column(0), "content_hash": b.column(2), "imports": pa.array(imports, _IMPORTS), "exports": pa.array(exports, _EXPORTS)}
            cols |= {"error_kind": pa.array(kinds, pa.string()), "message": pa.array(messages, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def parse(files: DataFrame, imports: bool = True, exports: bool = False) -> DataFrame:
    """(path, content_hash, imports, exports, error_kind, message) of files (path, content).

    A file that isn't UTF-8, or has an ``error``, is a read error with no
    imports; null content is an empty file.  The text itself goes no further
    than the parser.
    """
    unread = F.col("error") if "error" in files.columns else F.lit(None)
    d = files.select("path", F.col("content").cast("binary").alias("content"), F.xxhash64("content").alias("content_hash"), unread.cast("string").alias("unread"))
    return d.mapInArrow(_parsed(imports, exports), f"path string, content_hash bigint, imports array<{PARSED_IMPORT}>, exports array<{EXPORT}>, error_kind string, message string")


def classified(imports: Column, matcher: paths.Matcher) -> Column:
    """Imports with their ``source``."""
    return F.transform(imports, lambda i: F.struct(i["path"].alias("path"), i["kind"].alias("kind"), i["names"].alias("names"), matcher.source(i["path"]).alias("source"), i["location"].alias("location"))).cast(f"array<{IMPORT}>")


def analyze(files: DataFrame, matcher: paths.Matcher | None = None, registry: DataFrame | None = None) -> DataFrame:
    """One row per file: id, path, content_hash, imports, model_refs, status, last_scanned, error_kind, message.

    With a ``registry`` (source, export_name), an import keeps its source only
    if one of its names is a known export of that source.
    """
    d = parse(files).withColumn("imports", classified(F.col("imports"), matcher or paths.Matcher()))
    if registry is not None:
        from .registry import confirmed

        d = confirmed(d, registry)
    return d.select(
        text.file_id(F.col("path")).alias("id"),
        "path",
        "content_hash",
        "imports",
        F.array().cast(f"array<{MODEL_REF}>").alias("model_refs"),
        status.imports_status(F.col("imports")).alias("status"),
        text.scanned_at().alias("last_scanned"),
        "error_kind",
        "message",
    )


def files_of(analyzed: DataFrame) -> DataFrame:
    return analyzed.where("error_kind IS NULL").drop("error_kind", "message")


def errors_of(analyzed: DataFrame) -> DataFrame:
    return analyzed.where("error_kind IS NOT NULL").select("path", "error_kind", "message")


def flat_imports(files: DataFrame) -> DataFrame:
    """One row per import."""
    return files.select(F.col("path").alias("file"), F.posexplode("imports").alias("pos", "i")).select(
        "file", "pos", F.col("i.path").alias("import_path"), F.col("i.kind").alias("kind"), F.col("i.names").alias("names"), F.col("i.source").alias("source"), F.col("i.location.line").alias("line"), F.col("i.location.column").alias("column"), F.col("i.location.byte_offset").alias("byte_offset")
    )


def counted(files: DataFrame) -> DataFrame:
    """The report's row per file."""
    of = lambda s: F.size(F.filter("imports", lambda i: i["source"] == s)).cast("bigint")
    return files.select("path", "status", F.size("imports").cast("bigint").alias("import_count"), of(LEGACY).alias("legacy_imports"), of(MODERN).alias("migrated_imports"), F.size("model_refs").cast("bigint").alias("model_ref_count"))


def model_names(files: DataFrame) -> DataFrame:
    """Names that each file imports, legacy ones first: (path, source, name, place)."""
    d = files.select("path", F.explode(F.filter("imports", lambda i: i["source"].isNotNull())).alias("i"))
    return d.select("path", F.col("i.source").alias("source"), F.posexplode("i.names").alias("place", "name"), F.col("i.location.byte_offset").alias("byte_offset")).orderBy("path", "source", "byte_offset", "place")


def name_counts(files: DataFrame) -> DataFrame:
    """The model imports of each file with how many names each takes: (path, source, import_path, kind, names, byte_offset)."""
    d = files.select("path", F.explode(F.filter("imports", lambda i: i["source"].isNotNull())).alias("i"))
    return d.select("path", F.col("i.source").alias("source"), F.col("i.path").alias("import_path"), F.col("i.kind").alias("kind"), F.size("i.names").cast("bigint").alias("names"), F.col("i.location.byte_offset").alias("byte_offset"))


def first_location(imports: Column) -> Column:
    """Where to open a file: its first legacy import, else its first import, else null."""
    legacy = F.get(F.filter(imports, lambda i: F.coalesce(i["source"] == LEGACY, F.lit(False))), F.lit(0))
    return F.coalesce(legacy["location"], F.get(imports, F.lit(0))["location"])


def with_status(files: DataFrame, wanted: str) -> DataFrame:
    return files.where(F.col("status") == wanted)


def needing_migration(files: DataFrame) -> DataFrame:
    return files.where(status.needs_migration(F.col("status")))


def filtered(files: DataFrame, text_part: str = "", wanted: str | None = None) -> DataFrame:
    """Files whose path holds ``text_part`` in any case, and of one status if given."""
    d = files.where(F.contains(F.lower("path"), F.lit(text_part.lower()))) if text_part else files
    return with_status(d, wanted) if wanted else d


def next_status_filter(now: str | None) -> str | None:
    """The cycle of the status filter."""
    cycle = [None, "legacy", "partial", "migrated", "no_models"]
    return cycle[(cycle.index(now) + 1) % len(cycle)]


@dataclass(frozen=True)
class Narrowing:
    """What a listing is narrowed to: a part of the path and a status."""

    text_part: str = ""
    wanted: str | None = None

    @property
    def is_active(self) -> bool:
        return bool(self.text_part) or self.wanted is not None

    def next_status(self) -> Narrowing:
        return replace(self, wanted=next_status_filter(self.wanted))

    def clear(self) -> Narrowing:
        return Narrowing()

    def of(self, files: DataFrame) -> DataFrame:
        return filtered(files, self.text_part, self.wanted)


def by_path(files: DataFrame) -> DataFrame:
    """Sorted by path components: a/b stands before a-b."""
    return files.orderBy(F.split("path", "/"))


def page(files: DataFrame, offset: int, height: int) -> DataFrame:
    """The rows of a window over the sorted files."""
    return by_path(files).offset(offset).limit(height)
