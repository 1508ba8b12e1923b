"""Paths: classification, names, filters, truncation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ScanConfig
from ..schema import LEGACY, MODERN

# Directories no scan enters.
SKIP_DIRS = ("node_modules", "dist", "build", ".git", ".angular", "coverage", "__pycache__", ".turbo", ".next", ".nuxt")
# Parts of the paths of tests, which the watch filter leaves out.
TEST_PARTS = (".spec.", ".test.", "__tests__", "__mocks__")


def strip_quotes(c: Column) -> Column:
    """Without the quotes of either kind at both ends."""
    return F.btrim(c, F.lit("'\""))


@dataclass(frozen=True)
class Matcher:
    """Which paths mean the legacy and the modern model library."""

    legacy_dir: str = "shared"
    modern_dir: str = "shared_2023"
    models_subdir: str = "models"

    @classmethod
    def of(cls, config: ScanConfig) -> Matcher:
        return cls(config.shared_name, config.shared_2023_name, config.models_subdir)

    def needles(self, directory: str) -> tuple[str, str]:
        return f"{directory}/{self.models_subdir}", f"{directory}/interfaces"

    def source(self, path: Column) -> Column:
        """``shared2023``, ``shared_legacy`` or null of an import path, quoted or not.

        Modern wins; a path that names the modern directory is never legacy.
        """
        p = strip_quotes(path)
        hit = lambda needle: F.contains(p, F.lit("/" + needle)) | F.startswith(p, F.lit(needle))
        modern = reduce(or_, map(hit, self.needles(self.modern_dir)))
        legacy = reduce(or_, map(hit, self.needles(self.legacy_dir))) & ~F.contains(p, F.lit(self.modern_dir))
        return F.when(modern, F.lit(MODERN)).when(legacy, F.lit(LEGACY))


def file_name(path: Column) -> Column:
    """Last component; null if the path ends in none."""
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name; null without one or for names that only begin with a dot."""
    return F.nullif(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1), F.lit(""))


def is_typescript(path: Column) -> Column:
    return F.coalesce(extension(path).isin("ts", "tsx"), F.lit(False))


def in_skipped_dir(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether any component of the path is a directory to leave out."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in (*SKIP_DIRS, *more)]))


def model_name(path: Column) -> Column:
    """Last segment of an import path, without ``.ts``; null if empty."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(strip_quotes(path), r"\.ts$", ""), "/"), -1), F.lit(""))


def truncate_path(path: Column, length: int) -> Column:
    """At most ``length`` characters: the tail behind three dots."""
    return F.when(F.char_length(path) <= length, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(max(length - 3, 0)))))


def all_of(*conditions: Column) -> Column:
    """Conjunction; true if there are none."""
    return reduce(and_, conditions, F.lit(True))


def accept_all() -> Column:
    return F.lit(True)


def has_extension(path: Column, extensions: list[str]) -> Column:
    return F.coalesce(extension(path).isin(extensions), F.lit(False))


@dataclass(frozen=True)
class WatchFilter:
    """Which changed files matter: TypeScript, no declarations, no tests.

    Taking tests in turns off every exclusion, own patterns included.
    """

    include_tests: bool = False
    include_declarations: bool = False
    extensions: tuple[str, ...] = ("ts", "tsx")
    exclude: tuple[str, ...] = TEST_PARTS

    def accepts(self, path: Column) -> Column:
        parts = [has_extension(path, list(self.extensions))]
        if not self.include_declarations:
            parts.append(~(F.endswith(path, F.lit(".d.ts")) | F.endswith(path, F.lit(".d.tsx"))))
        if not self.include_tests:
            parts += [~F.contains(path, F.lit(x)) for x in self.exclude]
        return all_of(*parts)
