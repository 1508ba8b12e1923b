"""Browsing a sorted result: which row is chosen, which rows are in sight.

Only numbers live here; rows are fetched by ``offset`` and ``limit`` over the
sorted DataFrame, so a list of any length costs one page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

from .extract import by_path, page


@dataclass
class Browser:
    """A cursor over ``files``, sorted by path; ``height`` rows are in sight."""

    files: DataFrame
    height: int = 20
    at: int | None = None
    top: int = 0

    def __post_init__(self) -> None:
        self.total = self.files.count()

    def narrowed(self, files: DataFrame) -> Browser:
        """The same window over other rows, the first of them chosen."""
        other = Browser(files, self.height)
        return other.go(0)

    def go(self, row: int | None) -> Browser:
        """Choose a row that exists, and bring it into sight."""
        if self.total == 0:
            self.at = None
        elif row is not None and 0 <= row < self.total:
            self.at = row
            self.top = min(max(self.top, row - max(self.height, 1) + 1), row)
        return self

    def step(self, by: int) -> Browser:
        """Rows further or back, around both ends; without a choice, from the end it comes from."""
        if self.at is None:
            return self.go(0 if by > 0 else self.total - 1)
        return self.go((self.at + by) % self.total) if self.total else self.go(None)

    def turn(self, pages: int) -> Browser:
        """Whole pages, stopping at both ends."""
        to = (self.at or 0) + pages * max(self.height, 1)
        return self.go(min(max(to, 0), self.total - 1))

    def first(self) -> Browser:
        return self.go(0)

    def last(self) -> Browser:
        return self.go(self.total - 1)

    def in_sight(self) -> DataFrame:
        return page(self.files, self.top, max(self.height, 1))

    def chosen(self) -> Row | None:
        return None if self.at is None else by_path(self.files).offset(self.at).first()
