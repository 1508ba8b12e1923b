"""Strings and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def kebab_to_pascal(c: Column) -> Column:
    """``active-contract.ts`` to ``ActiveContract``: first letters behind - and _ in upper case (A-Z), the rest as it is."""
    words = F.split(F.regexp_replace(c, r"\.tsx?$", ""), "[-_]")
    return F.array_join(F.transform(words, lambda w: F.concat(F.translate(F.substring(w, 1, 1), LOWER, UPPER), F.substring(w, 2, 2147483647))), "")


def pascal_to_kebab(c: Column) -> Column:
    """``ActiveContract`` to ``active-contract``: a dash before every upper-case letter but the first, A-Z in lower case."""
    return F.translate(F.regexp_replace(c, r"(?<!^)(\p{IsUppercase})", "-$1"), UPPER, LOWER)


def escape_csv(c: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed; quotes doubled."""
    return F.when(c.rlike('[,"\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def content_hash(c: Column) -> Column:
    """Opaque 64-bit hash of a text."""
    return F.xxhash64(c)


def file_id(path: Column) -> Column:
    """Opaque 64-bit id of a path."""
    return F.xxhash64(path)


def scanned_at() -> Column:
    """Epoch seconds of the statement's start."""
    return F.unix_timestamp(F.current_timestamp())
