"""Statuses, import and export predicates, and the rates built from counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CATEGORY_SUFFIXES, LEGACY, MODERN, RECOVERABLE_SCAN_ERRORS, SOURCE_DIRS, STATUS_LABELS, STATUS_MARKS


def _named(c: Column, names: dict[str, str]) -> Column:
    out = None
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out


def status_of(has_legacy: Column, has_modern: Column) -> Column:
    """Status from two flags; null counts as false."""
    a, b = F.coalesce(has_legacy, F.lit(False)), F.coalesce(has_modern, F.lit(False))
    return F.when(a & b, "partial").when(a, "legacy").when(b, "migrated").otherwise("no_models")


def imports_status(imports: Column) -> Column:
    """Status of a file by its array of imports."""
    has = lambda s: F.exists(imports, lambda i: F.coalesce(i["source"] == s, F.lit(False)))
    return status_of(has(LEGACY), has(MODERN))


def needs_migration(status: Column) -> Column:
    return status.isin("legacy", "partial")


def is_migrated(status: Column) -> Column:
    return status == "migrated"


def has_models(status: Column) -> Column:
    return status != "no_models"


def label(status: Column) -> Column:
    return _named(status, STATUS_LABELS)


def mark(status: Column) -> Column:
    return _named(status, STATUS_MARKS)


def is_model_import(source: Column) -> Column:
    return source.isNotNull()


def is_legacy(source: Column) -> Column:
    return F.coalesce(source == LEGACY, F.lit(False))


def dir_name(source: Column) -> Column:
    return _named(source, SOURCE_DIRS)


def is_dynamic(kind: Column) -> Column:
    return kind == "dynamic"


def is_type_only(kind: Column) -> Column:
    return kind == "type_only"


def has_bindings(kind: Column) -> Column:
    return kind != "side_effect"


def is_class(kind: Column) -> Column:
    return kind == "class"


def is_interface(kind: Column) -> Column:
    return kind == "interface"


def is_reexport(kind: Column) -> Column:
    return kind == "re_export"


def category_suffix(category: Column) -> Column:
    return _named(category, CATEGORY_SUFFIXES)


def is_codegen(category: Column) -> Column:
    return F.startswith(category, F.lit("code_gen"))


def is_recoverable(error_kind: Column) -> Column:
    return error_kind.isin(*RECOVERABLE_SCAN_ERRORS)


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, F.lit(100.0))


def progress_percent(legacy: Column, migrated: Column, partial: Column) -> Column:
    """Migrated share of the files with models; 100 if there are none."""
    return _percent(migrated, legacy + migrated + partial)


def success_rate(total: Column, errors: Column) -> Column:
    """Share of files read without error; 100 if there are none."""
    return _percent(total - errors, total)


def scan_progress(scanned: Column, discovered: Column) -> Column:
    """Percent of the discovered files that are scanned; null before any is discovered."""
    return F.try_divide(scanned.cast("double"), discovered.cast("double")) * 100.0
