"""Known models and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import IMPORT
from .extract import parse


def models(files: DataFrame) -> DataFrame:
    """(name, source, definition_path, exports, seq) of model files (path, content, source, seq).

    Names are the file's stem in Pascal case; files of interfaces keep theirs
    as it is.  Files without exports or without a name define no model.
    """
    d = parse(files, imports=False, exports=True).where("error_kind IS NULL AND size(exports) > 0").select("path", F.transform("exports", lambda e: e["name"]).alias("exports"))
    known = files.select(F.col("path").alias("definition_path"), "source", "seq")
    d = known.join(d, F.col("definition_path") == F.col("path")).drop("path")
    stem = F.regexp_replace(F.element_at(F.split("definition_path", "/"), -1), r"(?<=.)\.[^.]*$", "")
    name = F.when(stem.isin("interfaces", "interfaces.codegen"), stem).otherwise(text.kebab_to_pascal(stem))
    return d.select(name.alias("name"), "source", "definition_path", "exports", "seq").where("name <> ''")


def latest(registered: DataFrame) -> DataFrame:
    """One row per source and name: the last registration."""
    return registered.groupBy("source", "name").agg(F.max_by(F.struct("definition_path", "exports"), F.struct("seq", "definition_path")).alias("m")).select("name", "source", "m.definition_path", "m.exports")


def exports(registered: DataFrame) -> DataFrame:
    """(source, export_name) over all registrations: exports are only ever added."""
    return registered.select("source", F.explode("exports").alias("export_name")).distinct()


def counts(registered: DataFrame) -> DataFrame:
    """(source, models, exports): distinct of each."""
    m = registered.groupBy("source").agg(F.count_distinct("name").alias("models"))
    return m.join(exports(registered).groupBy("source").agg(F.count("*").alias("exports")), "source", "left")


def known(names: DataFrame, known_exports: DataFrame) -> DataFrame:
    """Rows of ``names`` (export_name, ...) that any source exports."""
    return names.join(known_exports.select("export_name").distinct(), "export_name", "left_semi")


def confirmed(files: DataFrame, known_exports: DataFrame) -> DataFrame:
    """``files`` whose imports keep their source only if one of their names is a known export of it.

    Imports without names lose it.  A row is known by a number of its own, so
    rows of one path stay apart; files are parsed once, and both groupings
    stand on the one shuffle by that number.
    """
    with_source = lambda i, s: F.struct(i["path"].alias("path"), i["kind"].alias("kind"), i["names"].alias("names"), s.alias("source"), i["location"].alias("location"))
    rest = [c for c in files.columns if c != "imports"]
    rows = files.withColumn("__row", F.monotonically_increasing_id()).select("__row", *rest, F.posexplode_outer("imports").alias("__pos", "__i")).select("*", F.explode_outer("__i.names").alias("__name"))
    hit = known_exports.select(F.col("source").alias("__source"), F.col("export_name").alias("__export"), F.lit(True).alias("__hit")).distinct()
    rows = rows.join(hit, (F.col("__i.source") == F.col("__source")) & (F.col("__name") == F.col("__export")), "left").repartition("__row")
    one = rows.groupBy("__row", "__pos").agg(F.bool_or("__hit").alias("__hit"), F.first("__i").alias("__i"), *[F.first(c).alias(c) for c in rest])
    i = F.col("__i")
    kept = F.when(i.isNotNull(), F.struct("__pos", with_source(i, F.when(F.coalesce("__hit", F.lit(False)), i["source"])).alias("i")))
    by_file = one.groupBy("__row").agg(F.array_sort(F.collect_list(kept)).alias("imports"), *[F.first(c).alias(c) for c in rest])
    return by_file.withColumn("imports", F.transform("imports", lambda x: x["i"]).cast(f"array<{IMPORT}>")).select(*files.columns)
