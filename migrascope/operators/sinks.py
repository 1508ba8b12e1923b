"""Reports: JSON, CSV and text, to a file or standard output, or as distributed tables."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status, text
from .extract import by_path, counted, with_status

CSV_HEADER = ("path", "status", "import_count", "legacy_imports", "migrated_imports")


def csv_rows(files: DataFrame) -> DataFrame:
    """The report's columns; the status as its label."""
    return counted(files).select("path", status.label(F.col("status")).alias("status"), "import_count", "legacy_imports", "migrated_imports")


def csv_lines(files: DataFrame) -> DataFrame:
    """(path, line): each file's CSV line."""
    d = csv_rows(files)
    return d.select("path", F.concat_ws(",", text.escape_csv(F.col("path")), *[F.col(c).cast("string") for c in CSV_HEADER[1:]]).alias("line"))


def csv_report(files: DataFrame) -> str:
    """The whole report, sorted by path, row by row from the executors."""
    lines = csv_lines(files).orderBy(F.split("path", "/")).select("line").toLocalIterator()
    return "\n".join([",".join(CSV_HEADER), *(r[0] for r in lines)]) + "\n"


def json_rows(files: DataFrame) -> DataFrame:
    """(path, json): each file as a JSON object, nulls kept."""
    cols = [c for c in ("id", "path", "content_hash", "imports", "model_refs", "status", "last_scanned") if c in files.columns]
    return files.select("path", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def json_report(stats: DataFrame, files: DataFrame) -> str:
    """One pretty-printed object {stats, files}, files sorted by path."""
    s = stats.select("total", "legacy", "migrated", "partial", "no_models", "errors").first().asDict()
    rows = [json.loads(r[0]) for r in json_rows(files).orderBy(F.split("path", "/")).select("json").toLocalIterator()]
    return json.dumps({"stats": s, "files": rows}, indent=2, ensure_ascii=False)


def write_csv(files: DataFrame, path: str) -> None:
    """The report as a distributed CSV table."""
    w = csv_rows(files).write.mode("overwrite").option("header", True).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json(files: DataFrame, path: str) -> None:
    """One JSON object per line, distributed."""
    files.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def summary(stats: DataFrame) -> str:
    """Counts, progress with one decimal, and the files that need work."""
    r = stats.first()
    den = r["legacy"] + r["migrated"] + r["partial"]
    progress = 100.0 * r["migrated"] / den if den else 100.0
    rows = [("Legacy:", r["legacy"], "need migration"), ("Partial:", r["partial"], "in progress"), ("Migrated:", r["migrated"], "complete"), ("No models:", r["no_models"], "no action needed")]
    out = ["", "Migration Status Summary", "=" * 24, "", f"Total files scanned: {r['total']}"]
    out += [f"  {name:<17} {n} ({what})" for name, n, what in rows]
    out += [f"  {'Errors:':<17} {r['errors']}", "", f"Migration progress: {progress:.1f}%", f"Files needing work: {r['legacy'] + r['partial']}"]
    return "\n".join(out)


def detailed(files: DataFrame) -> str:
    """Paths of legacy, then of partial files; empty sections are left out."""
    out = []
    for name, wanted in (("Legacy", "legacy"), ("Partial", "partial")):
        paths = [r[0] for r in by_path(with_status(files, wanted).select("path")).toLocalIterator()]
        if paths:
            out += ["", f"{name} files ({len(paths)}):", *(f"  {p}" for p in paths)]
    return "\n".join(out)


def error_lines(errors: DataFrame) -> str:
    return "\n".join(f"  {r['path']} - {r['message']}" for r in errors.orderBy("path").toLocalIterator())


def deliver(report: str, path: str | None = None) -> None:
    """To the file, overwriting it, or to standard output."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(report)
    else:
        sys.stdout.write(report if report.endswith("\n") else report + "\n")
