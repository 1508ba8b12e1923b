"""Commands: scan, report, watch."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .functions.paths import Matcher
from .operators import extract, registry, sinks, stats
from .operators.store import Store
from .sources.files import check_root, tree
from .sources.models import model_files
from .streaming.live import follow

# Directories the commands leave out besides the built-in ones.
SKIPPED = ("node_modules", "dist", ".git")


def parser() -> argparse.ArgumentParser:
    env = os.environ.get
    p = argparse.ArgumentParser(prog="migrascope", description="Track a migration of TypeScript model imports.")
    p.add_argument("--path", default=env("MIGRASCOPE_PATH", Config().scan.root), help="root of the sources")
    p.add_argument("--shared-path", help="legacy library (default <path>/app/shared)")
    p.add_argument("--shared-2023-path", help="modern library (default <path>/app/shared_2023)")
    p.add_argument("--app-path", help="what is scanned (default <path>/app)")
    p.add_argument("--use-registry", action="store_true", help="count an import only if the library exports one of its names")
    sub = p.add_subparsers(dest="command")
    s = sub.add_parser("scan", help="summary of all files")
    s.add_argument("--detailed", action="store_true", help="also list the files that need work")
    s.add_argument("--stats-only", action="store_true", help="nothing but the summary")
    r = sub.add_parser("report", help="JSON or CSV of all files")
    r.add_argument("--format", choices=("json", "csv"), default="json")
    r.add_argument("--output", help="file to write; standard output without it")
    w = sub.add_parser("watch", help="follow changes")
    w.add_argument("--store", required=True, help="folder of the latest state")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--interval", default="1 second")
    w.add_argument("--once", action="store_true", help="take in what is there and end")
    return p


def config_of(args: argparse.Namespace) -> Config:
    c = Config()
    c.scan.root = args.path
    c.scan.app_path = args.app_path or os.path.join(args.path, "app")
    c.scan.shared_dir = args.shared_path or os.path.join(args.path, "app", "shared")
    c.scan.shared_2023_dir = args.shared_2023_path or os.path.join(args.path, "app", "shared_2023")
    return c


def exports(spark: SparkSession, c: Config) -> DataFrame:
    """(source, export_name) of both libraries."""
    return registry.exports(registry.models(model_files(spark, c.scan.shared_dir, c.scan.shared_2023_dir, c.scan.models_subdir)))


def analyzed(spark: SparkSession, c: Config, use_registry: bool = False) -> DataFrame:
    """All files below the app path; both libraries must exist."""
    for path in (c.scan.app_path, c.scan.shared_dir, c.scan.shared_2023_dir):
        check_root(path)
    known = exports(spark, c) if use_registry else None
    files = tree(spark, c.scan.app_path, skip_dirs=SKIPPED)
    return extract.analyze(files, Matcher.of(c.scan), known)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("migrascope").getOrCreate()
    c = config_of(args)
    if args.command == "watch":
        check_root(c.scan.app_path)
        show = lambda store: print(sinks.summary(stats.scan_stats(store.read())))
        known = exports(spark, c) if args.use_registry else None
        quiet = 0 if args.once else c.watch.debounce_ms
        q = follow(spark, c.scan.app_path, Store(spark, args.store), args.checkpoint, matcher=Matcher.of(c.scan), registry=known, on_update=show, interval=None if args.once else args.interval, quiet_ms=quiet, skip_dirs=SKIPPED)
        q.awaitTermination()
        return 0
    rows = analyzed(spark, c, args.use_registry).persist()  # parsed once for all parts of the report
    try:
        counts, files = stats.scan_stats(rows), extract.files_of(rows)
        if args.command == "report":
            sinks.deliver(sinks.json_report(counts, files) if args.format == "json" else sinks.csv_report(files), args.output)
            return 0
        print(sinks.summary(counts))
        only = getattr(args, "stats_only", False)  # neither option is there without a command
        if getattr(args, "detailed", False) and not only:
            print(sinks.detailed(files))
        errors = sinks.error_lines(extract.errors_of(rows))
        if errors and not only:
            print("\nErrors:\n" + errors, file=sys.stderr)
        return 0
    finally:
        rows.unpersist()


if __name__ == "__main__":
    sys.exit(main())
