"""The registered queries over source trees, and DuckDB SQL that gives the same rows.

Queries over ``orders`` and ``lineitem`` parse generated files; their SQL
computes the answer from the columns.  The rest apply one operator to a
column directly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, status, text
from ..functions.paths import Matcher, WatchFilter
from ..operators import extract, registry, sinks, stats, store
from ..schema import SCAN_ERRORS
from ..streaming import live
from . import synthetic
from .synthetic import DECOY, HEAD, MODULE, STATEMENT, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# ---------------------------------------------------------------- SQL parts
KIND = "CASE l_linenumber % 6 WHEN 0 THEN 'named' WHEN 1 THEN 'default' WHEN 2 THEN 'namespace' WHEN 3 THEN 'side_effect' WHEN 4 THEN 'type_only' ELSE 'dynamic' END"
SOURCE = "CASE l_returnflag WHEN 'R' THEN 'shared_legacy' WHEN 'A' THEN 'shared2023' END"
IMPORTS = f"""imp AS (
  SELECT 'src/app/o-' || l_orderkey || '.ts' AS file, l_linenumber, l_partkey, l_suppkey, l_returnflag, {MODULE} AS module, {SOURCE} AS source, {KIND} AS kind, {STATEMENT} AS code,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity) AS rn
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""
FLAGS = """flags AS (
  SELECT o_orderkey, 'src/app/o-' || o_orderkey || '.ts' AS path, count(l_orderkey) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS legacy, count(*) FILTER (WHERE l_returnflag = 'A') AS modern
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
files AS (SELECT *, CASE WHEN legacy > 0 AND modern > 0 THEN 'partial' WHEN legacy > 0 THEN 'legacy' WHEN modern > 0 THEN 'migrated' ELSE 'no_models' END AS status FROM flags)"""
COUNTS = "counts AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'legacy') AS legacy, count(*) FILTER (WHERE status = 'migrated') AS migrated, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'no_models') AS no_models, 0::BIGINT AS errors FROM files)"
LABEL = "CASE status WHEN 'legacy' THEN 'Legacy' WHEN 'migrated' THEN 'Migrated' WHEN 'partial' THEN 'Partial' ELSE 'No Models' END"
HEAD_BYTES, DECOY_BYTES = len(HEAD.encode()), len(DECOY.encode())
PART_PATH = "'../' || CASE p_partkey % 4 WHEN 0 THEN 'shared/models' WHEN 1 THEN 'shared_2023/models' WHEN 2 THEN 'shared/interfaces' ELSE 'shared/utils' END || '/' || replace(p_name, ' ', '-') || '.ts'"
EVENT_PATH = "'src/u-' || user_id || '.' || CASE user_id % 5 WHEN 0 THEN 'ts' WHEN 1 THEN 'tsx' WHEN 2 THEN 'js' WHEN 3 THEN 'd.ts' ELSE 'spec.ts' END"
EVENTS = f"ev AS (SELECT event_id, {EVENT_PATH} AS path, ts, event_type, md5(event_type || '|' || (event_id % 3)) AS content_hash FROM events)"
MODELS = """mo AS (SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN 'shared_legacy' ELSE 'shared2023' END AS source,
  'app/' || CASE WHEN p_partkey % 2 = 0 THEN 'shared' ELSE 'shared_2023' END || '/models/part-model-' || (p_partkey % 50) || '.' || p_partkey || '.ts' AS definition_path,
  'PartModel' || (p_partkey % 50) || '.' || p_partkey AS name, p_partkey FROM part),
ex AS (SELECT seq, source, definition_path, name, unnest(list_concat(['P' || p_partkey, 'P' || p_partkey || 'Model'], CASE WHEN p_partkey % 3 = 0 THEN ['X' || p_partkey, 'Y' || p_partkey] ELSE [] END, CASE WHEN p_partkey % 5 = 0 THEN ['R' || p_partkey] ELSE [] END)) AS export_name FROM mo)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.analyze(synthetic.order_files(spark, sf_dir))


def _part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    side = F.element_at(F.array(*map(F.lit, ("shared/models", "shared_2023/models", "shared/interfaces", "shared/utils"))), (p % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("../"), side, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".ts")).alias("path"))


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.models(synthetic.model_files(spark, sf_dir))


# ---------------------------------------------------------------- scan, status, statistics
@_query(
    f"WITH {FLAGS}, {COUNTS} SELECT *, legacy + partial AS needs_migration, legacy + migrated + partial AS with_models, coalesce(migrated::DOUBLE / nullif(legacy + migrated + partial, 0) * 100, 100.0) AS progress_percent, coalesce((total - errors)::DOUBLE / nullif(total, 0) * 100, 100.0) AS success_rate FROM counts"
)
def scan_summary(spark, sf_dir):
    return stats.with_rates(stats.scan_stats(_files(spark, sf_dir)))


@_query(f"WITH {FLAGS} SELECT path, status FROM files")
def file_status(spark, sf_dir):
    return _files(spark, sf_dir).select("path", "status")


@_query("SELECT 'src/c-' || c_custkey || '.ts' AS path, CASE WHEN bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') THEN 'partial' WHEN bool_or(o_orderstatus = 'F') THEN 'legacy' WHEN bool_or(o_orderstatus = 'O') THEN 'migrated' ELSE 'no_models' END AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def file_status_with_empty_files(spark, sf_dir):
    module = F.when(F.col("o_orderstatus") == "F", "shared/models/a").when(F.col("o_orderstatus") == "O", "shared_2023/interfaces").otherwise("rxjs")
    per = table(spark, sf_dir, "orders").select(F.col("o_custkey"), module.alias("m")).groupBy("o_custkey").agg(F.collect_set("m").alias("m"))
    c = table(spark, sf_dir, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    body = F.array_join(F.transform(F.coalesce("m", F.array().cast("array<string>")), lambda m: F.concat(F.lit("import '"), m, F.lit("';"))), "\n")
    return extract.analyze(c.select(F.concat(F.lit("src/c-"), "c_custkey", F.lit(".ts")).alias("path"), body.alias("content"))).select("path", "status")


@_query(f"WITH {FLAGS} SELECT path, status, n AS import_count, legacy AS legacy_imports, modern AS migrated_imports, 0::BIGINT AS model_ref_count FROM files")
def legacy_migrated_counts(spark, sf_dir):
    return extract.counted(_files(spark, sf_dir))


@_query(f"WITH {FLAGS} SELECT path FROM files WHERE status = 'partial'")
def files_with_status(spark, sf_dir):
    return extract.with_status(_files(spark, sf_dir), "partial").select("path")


@_query(f"WITH {FLAGS} SELECT path, status FROM files WHERE status IN ('legacy', 'partial')")
def files_needing_migration(spark, sf_dir):
    return extract.needing_migration(_files(spark, sf_dir)).select("path", "status")


@_query(f"WITH {FLAGS} SELECT path, {LABEL} AS label, CASE status WHEN 'legacy' THEN '[L]' WHEN 'migrated' THEN '[M]' WHEN 'partial' THEN '[P]' ELSE '[-]' END AS mark, status IN ('legacy', 'partial') AS needs_migration, status = 'migrated' AS is_migrated, status <> 'no_models' AS has_models FROM files")
def status_labels(spark, sf_dir):
    s = F.col("status")
    return _files(spark, sf_dir).select("path", status.label(s).alias("label"), status.mark(s).alias("mark"), status.needs_migration(s).alias("needs_migration"), status.is_migrated(s).alias("is_migrated"), status.has_models(s).alias("has_models"))


@_query(f"WITH {FLAGS} SELECT path, status FROM files WHERE contains(lower(path), 'o-1') AND status = 'legacy'")
def text_status_filter(spark, sf_dir):
    return extract.filtered(_files(spark, sf_dir), "O-1", "legacy").select("path", "status")


@_query(f"WITH {FLAGS} SELECT path, status FROM files ORDER BY string_split(path, '/') LIMIT 25 OFFSET 50")
def viewport_page(spark, sf_dir):
    return extract.page(_files(spark, sf_dir).select("path", "status"), 50, 25)


@_query(f"WITH {FLAGS}, numbered AS (SELECT path, status, row_number() OVER (ORDER BY path) - 1 AS i FROM files WHERE status = 'legacy') SELECT (SELECT count(*) FROM files) AS file_count, (SELECT count(*) FROM numbered) AS filtered_count, (SELECT path FROM numbered WHERE i = 3) AS selected")
def view_counts(spark, sf_dir):
    f = _files(spark, sf_dir).select("path", "status")
    legacy = F.col("status") == "legacy"
    third = extract.by_path(f.where(legacy)).offset(3).limit(1).select(F.col("path").alias("selected"))
    return f.agg(F.count("*").alias("file_count"), F.count_if(legacy).alias("filtered_count")).join(third, how="left")


# ---------------------------------------------------------------- imports
@_query(f"WITH {IMPORTS} SELECT file, rn - 1 AS pos, CASE kind WHEN 'default' THEN '\"' || module || '\"' ELSE '''' || module || '''' END AS import_path, kind, source FROM imp")
def imports_flat(spark, sf_dir):
    return extract.flat_imports(_files(spark, sf_dir)).select("file", F.col("pos").cast("bigint").alias("pos"), "import_path", "kind", "source")


@_query(f"WITH {IMPORTS} SELECT file, rn - 1 AS pos, unnest(CASE kind WHEN 'named' THEN ['P' || l_partkey, 'S' || l_suppkey] WHEN 'default' THEN ['D' || l_partkey] WHEN 'namespace' THEN ['N' || l_partkey] WHEN 'type_only' THEN ['T' || l_partkey] ELSE [] END) AS name FROM imp")
def import_names(spark, sf_dir):
    return extract.flat_imports(_files(spark, sf_dir)).select("file", F.col("pos").cast("bigint").alias("pos"), F.explode("names").alias("name"))


@_query(f"WITH {IMPORTS} SELECT kind, count(*) AS n, count(source) AS model_imports, count(*) FILTER (WHERE source = 'shared_legacy') AS legacy_imports FROM imp GROUP BY kind")
def import_kind_counts(spark, sf_dir):
    s = F.col("source")
    return extract.flat_imports(_files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(status.is_model_import(s)).alias("model_imports"), F.count_if(status.is_legacy(s)).alias("legacy_imports"))


@_query(f"WITH {IMPORTS} SELECT file, rn - 1 AS pos, 'T' || l_partkey AS name FROM imp WHERE kind = 'type_only'")
def import_type_only(spark, sf_dir):
    return extract.flat_imports(_files(spark, sf_dir)).where(status.is_type_only(F.col("kind"))).select("file", F.col("pos").cast("bigint").alias("pos"), F.col("names")[0].alias("name"))


@_query(f"WITH {IMPORTS} SELECT file, '''' || module || '''' AS import_path, source FROM imp WHERE kind = 'dynamic'")
def dynamic_imports(spark, sf_dir):
    return extract.flat_imports(_files(spark, sf_dir)).where(status.is_dynamic(F.col("kind"))).select("file", "import_path", "source")


@_query("SELECT 'doc-' || doc_id || '.ts' AS path, 2::BIGINT AS n_imports FROM documents")
def decoy_imports_ignored(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("*/"), F.lit("* /")).alias("text"))
    quoted = F.regexp_replace("text", r"[`\\$'\"\n\r]", " ")
    code = F.concat(F.lit("/* import 'c';\n"), "text", F.lit("\nimport 'c'; */\nimport a from './a';\nconst t = `import 'x' "), quoted, F.lit("`;\n// import 'y'\nconst s = \"import 'z' "), quoted, F.lit("\";\nimport './b';\n"))
    f = extract.parse(d.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".ts")).alias("path"), code.alias("content")))
    return f.select("path", F.size("imports").cast("bigint").alias("n_imports"))


@_query(
    f"WITH {IMPORTS} SELECT file, rn - 1 AS pos, 2 * rn + 1 AS line, CASE kind WHEN 'dynamic' THEN 23 ELSE 0 END::BIGINT AS \"column\", ({HEAD_BYTES} + rn * {DECOY_BYTES} + coalesce(sum(length(code) + 1) OVER (PARTITION BY file ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE kind WHEN 'dynamic' THEN 23 ELSE 0 END)::BIGINT AS byte_offset FROM imp"
)
def import_locations(spark, sf_dir):
    return extract.flat_imports(_files(spark, sf_dir)).select("file", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "line", "column", "byte_offset")])


@_query(f"WITH {IMPORTS}, firsts AS (SELECT file, min(rn) AS any_rn, min(rn) FILTER (WHERE source = 'shared_legacy') AS legacy_rn FROM imp GROUP BY file) SELECT file AS path, 2 * coalesce(legacy_rn, any_rn) + 1 AS line FROM firsts UNION ALL SELECT 'src/app/o-' || o_orderkey || '.ts', NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def first_legacy_location(spark, sf_dir):
    return _files(spark, sf_dir).select("path", extract.first_location(F.col("imports"))["line"].cast("bigint").alias("line"))


@_query(f"WITH {IMPORTS} SELECT file AS path, source, unnest(CASE kind WHEN 'named' THEN ['P' || l_partkey, 'S' || l_suppkey] WHEN 'default' THEN ['D' || l_partkey] WHEN 'namespace' THEN ['N' || l_partkey] WHEN 'type_only' THEN ['T' || l_partkey] ELSE [] END) AS name FROM imp WHERE source IS NOT NULL")
def file_details(spark, sf_dir):
    return extract.model_names(_files(spark, sf_dir)).select("path", "source", "name")


# ---------------------------------------------------------------- exports, registry
@_query("WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'shared' ELSE 'shared_2023' END AS side FROM part), f AS (SELECT 'app/' || side || '/models/part-model-' || (p_partkey % 50) || '.' || p_partkey || '.ts' AS path, p_partkey FROM p) SELECT path, 'P' || p_partkey AS name, 'class' AS kind, NULL::VARCHAR AS reexport_source FROM f UNION ALL SELECT path, 'P' || p_partkey || 'Model', 'interface', NULL FROM f UNION ALL SELECT path, unnest(['X' || p_partkey, 'Y' || p_partkey]), 'named', NULL FROM f WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'R' || p_partkey, 're_export', '''./r''' FROM f WHERE p_partkey % 5 = 0")
def exports_flat(spark, sf_dir):
    d = extract.parse(synthetic.model_files(spark, sf_dir), imports=False, exports=True)
    return d.select("path", F.explode("exports").alias("e")).select("path", "e.name", "e.kind", "e.reexport_source")


@_query("SELECT 'class' AS kind, count(*) AS n FROM part UNION ALL SELECT 'interface', count(*) FROM part UNION ALL SELECT 'named', 2 * count(*) FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 're_export', count(*) FROM part WHERE p_partkey % 5 = 0")
def export_kind_counts(spark, sf_dir):
    d = extract.parse(synthetic.model_files(spark, sf_dir), imports=False, exports=True)
    return d.select(F.explode("exports").alias("e")).groupBy(F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))


@_query(f"WITH {MODELS} SELECT name, source, definition_path, count(export_name) AS n_exports FROM ex GROUP BY ALL")
def registry_models(spark, sf_dir):
    return registry.latest(_models(spark, sf_dir)).select("name", "source", "definition_path", F.size("exports").cast("bigint").alias("n_exports"))


@_query(f"WITH {MODELS} SELECT source, count(DISTINCT name) AS models, count(DISTINCT export_name) AS exports FROM ex GROUP BY source")
def registry_export_counts(spark, sf_dir):
    return registry.counts(_models(spark, sf_dir))


@_query("SELECT source, name, max(s_suppkey) AS last_key FROM (SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'shared_legacy' ELSE 'shared2023' END AS source, 'M' || s_nationkey AS name FROM supplier) GROUP BY source, name")
def registry_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("M"), "s_nationkey").alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "shared_legacy").otherwise("shared2023").alias("source"), F.col("s_suppkey").cast("string").alias("definition_path"), F.array(F.lit("A")).alias("exports"), F.col("s_suppkey").alias("seq"))
    return registry.latest(rows).select("source", "name", F.col("definition_path").cast("bigint").alias("last_key"))


@_query(f"WITH {MODELS} SELECT source, name FROM mo")
def all_models_union(spark, sf_dir):
    m = registry.latest(_models(spark, sf_dir)).select("source", "name")
    return m.where("source = 'shared_legacy'").unionByName(m.where("source = 'shared2023'"))


@_query(f"WITH {MODELS} SELECT DISTINCT 'P' || s_suppkey AS export_name FROM supplier WHERE 'P' || s_suppkey IN (SELECT export_name FROM ex)")
def known_exports(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("P"), "s_suppkey").alias("export_name"))
    return registry.known(names, registry.exports(_models(spark, sf_dir)))


@_query(f"""WITH {MODELS}, {IMPORTS}, named AS (SELECT file, source, unnest(CASE kind WHEN 'named' THEN ['P' || l_partkey, 'S' || l_suppkey] WHEN 'default' THEN ['D' || l_partkey] WHEN 'namespace' THEN ['N' || l_partkey] WHEN 'type_only' THEN ['T' || l_partkey] ELSE [] END) AS name FROM imp),
ok AS (SELECT file, bool_or(n.source = 'shared_legacy') AS l, bool_or(n.source = 'shared2023') AS m FROM named n JOIN (SELECT DISTINCT source, export_name FROM ex) e ON e.source = n.source AND e.export_name = n.name GROUP BY file)
SELECT 'src/app/o-' || o_orderkey || '.ts' AS path, CASE WHEN l AND m THEN 'partial' WHEN l THEN 'legacy' WHEN m THEN 'migrated' ELSE 'no_models' END AS status FROM orders LEFT JOIN ok ON file = 'src/app/o-' || o_orderkey || '.ts'""")
def registry_filtered_status(spark, sf_dir):
    known = registry.exports(_models(spark, sf_dir))
    return extract.analyze(synthetic.order_files(spark, sf_dir), registry=known).select("path", "status")


# ---------------------------------------------------------------- functions
@_query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'shared2023' WHEN 3 THEN NULL ELSE 'shared_legacy' END AS source, CASE p_partkey % 4 WHEN 1 THEN 'shared_2023' WHEN 3 THEN NULL ELSE 'shared' END AS dir_name FROM (SELECT p_partkey, {PART_PATH} AS path FROM part)")
def classify_default(spark, sf_dir):
    d = _part_paths(spark, sf_dir).withColumn("source", Matcher().source(F.concat(F.lit("'"), "path", F.lit("'"))))
    return d.select("p_partkey", "source", status.dir_name(F.col("source")).alias("dir_name"))


@_query("SELECT page_id, CASE WHEN contains(url, '/new/models') OR starts_with(url, 'new/models') OR contains(url, '/new/interfaces') THEN 'shared2023' WHEN (contains(url, '/en/models') OR contains(url, '/en/interfaces')) AND NOT contains(url, 'new') THEN 'shared_legacy' END AS source FROM (SELECT page_id, replace(replace(url, '/fr/', '/new/models/'), '/en/', '/en/models/') AS url FROM pages)")
def classify_custom_dirs(spark, sf_dir):
    url = F.replace(F.replace("url", F.lit("/fr/"), F.lit("/new/models/")), F.lit("/en/"), F.lit("/en/models/"))
    return table(spark, sf_dir, "pages").select("page_id", Matcher("en", "new").source(url).alias("source"))


@_query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'shared2023' WHEN 1 THEN NULL ELSE 'shared_legacy' END AS source FROM part")
def classify_precedence(spark, sf_dir):
    p = F.col("p_partkey")
    path = F.when(p % 3 == 0, "../shared_2023/models/shared/models/").when(p % 3 == 1, "shared_2023/shared/models/").otherwise("shared/models-old/")
    return table(spark, sf_dir, "part").select("p_partkey", Matcher().source(F.concat(path, p)).alias("source"))


@_query("SELECT page_id, nullif(list_extract(string_split(regexp_replace(trim(url, '''\"'), '\\.ts$', ''), '/'), -1), '') AS name FROM pages")
def model_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.model_name(F.col("url")).alias("name"))


@_query("SELECT p_partkey, list_aggregate(list_transform(string_split(replace(p_name, ' ', '-'), '-'), lambda w: upper(w[1]) || w[2:]), 'string_agg', '') AS pascal FROM part")
def kebab_to_pascal(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.kebab_to_pascal(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".ts"))).alias("pascal"))


@_query("SELECT p_partkey, lower(p_brand[1]) || regexp_replace(p_brand[2:], '([A-Z])', '-\\1', 'g').lower() AS kebab FROM part")
def pascal_to_kebab(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.pascal_to_kebab(F.col("p_brand")).alias("kebab"))


@_query("SELECT doc_id, CASE WHEN contains(text, ',') OR contains(text, '\"') OR contains(text, chr(10)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS escaped FROM documents")
def csv_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_csv(F.col("text")).alias("escaped"))


@_query(f"WITH {FLAGS} SELECT path, path || ',' || {LABEL} || ',' || n || ',' || legacy || ',' || modern AS line FROM files")
def csv_report(spark, sf_dir):
    return sinks.csv_lines(_files(spark, sf_dir))


@_query(f"WITH {IMPORTS}, {FLAGS} SELECT path, status, n AS n_imports, (SELECT count(*) FROM imp WHERE file = path AND source IS NULL) AS n_null_sources FROM files")
def json_report_rows(spark, sf_dir):
    d = sinks.json_rows(_files(spark, sf_dir).drop("last_scanned"))
    shape = "path string, status string, imports array<struct<source:string>>"
    j = d.select(F.from_json("json", shape).alias("j"), (F.length("json") - F.length(F.replace("json", F.lit('"source":null'), F.lit("")))).alias("cut"))
    return j.select("j.path", "j.status", F.size("j.imports").cast("bigint").alias("n_imports"), (F.col("cut") / 13).cast("bigint").alias("n_null_sources"))


@_query("SELECT page_id, CASE WHEN length(url) <= 30 THEN url ELSE '...' || right(url, 27) END AS short FROM pages")
def truncate_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.truncate_path(F.col("url"), 30).alias("short"))


@_query("SELECT count(*) AS n, count(DISTINCT text) AS distinct_hashes FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(text.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("n"), F.count_distinct("h").alias("distinct_hashes"))


@_query(f"SELECT p_partkey, NOT (p_partkey % 7 = 1 OR p_partkey % 7 = 2 OR p_partkey % 7 = 4) AS kept, p_partkey % 7 <> 5 AS typescript FROM part")
def scan_filter(spark, sf_dir):
    p = F.col("p_partkey")
    forms = ("src/a.ts", "src/node_modules/b.ts", "dist/c.tsx", "src/node_modules2/d.ts", "custom/e.ts", "src/f.js", "src/g.d.ts")
    path = F.element_at(F.array(*map(F.lit, forms)), (p % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", (~paths.in_skipped_dir(path, ("custom",))).alias("kept"), paths.is_typescript(path).alias("typescript"))


@_query(f"WITH {EVENTS} SELECT event_id, user_id % 5 IN (0, 1) AS accepted, user_id % 5 <> 3 AND user_id % 5 <> 2 AS with_tests, user_id % 5 IN (0, 1, 3) AS with_declarations, user_id % 5 IN (0, 1) AND NOT contains(path, 'u-1') AS composite, user_id % 5 = 2 AS javascript, true AS everything FROM ev JOIN events USING (event_id)")
def watch_filter(spark, sf_dir):
    p = F.col("path")
    out = {
        "accepted": WatchFilter().accepts(p),
        "with_tests": WatchFilter(include_tests=True).accepts(p),
        "with_declarations": WatchFilter(include_declarations=True).accepts(p),
        "composite": paths.all_of(WatchFilter().accepts(p), ~F.contains(p, F.lit("u-1"))),
        "javascript": paths.has_extension(p, ["js", "mjs"]),
        "everything": paths.accept_all(),
    }
    return synthetic.event_paths(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in out.items()])


@_query("SELECT DISTINCT p_type, CASE p_partkey % 3 WHEN 0 THEN 'CodeGen' WHEN 1 THEN 'Model' ELSE '' END AS suffix, p_partkey % 3 = 0 AS is_codegen FROM part")
def model_categories(spark, sf_dir):
    c = F.element_at(F.array(*map(F.lit, ("code_gen", "interface", "model"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_type", status.category_suffix(c).alias("suffix"), status.is_codegen(c).alias("is_codegen")).distinct()


# ---------------------------------------------------------------- store, events, streams
@_query(f"WITH {EVENTS} SELECT path, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM ev GROUP BY path")
def latest_by_path(spark, sf_dir):
    e = synthetic.event_paths(spark, sf_dir).select("path", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return store.latest_by(e, "path", "ts", "event_id").select("path", "ts", "event_id")


@_query(f"WITH {EVENTS}, old AS (SELECT path, arg_max(content_hash, event_id) AS h FROM ev WHERE event_id % 2 = 0 GROUP BY path), new AS (SELECT path, arg_max(content_hash, event_id) AS h FROM ev WHERE event_id % 2 = 1 GROUP BY path) SELECT new.path FROM new LEFT JOIN old USING (path) WHERE old.path IS NULL OR old.h <> new.h")
def needs_update(spark, sf_dir):
    e = synthetic.event_paths(spark, sf_dir).select("event_id", "path", "content_hash")
    half = lambda k: store.latest_by(e.where(F.col("event_id") % 2 == k), "path", "event_id")
    return store.needs_update(half(1), half(0)).select("path")


@_query(f"WITH {EVENTS}, old AS (SELECT path, max(event_id) AS event_id FROM ev WHERE event_id % 3 = 0 GROUP BY path), new AS (SELECT path, max(event_id) AS event_id FROM ev WHERE event_id % 3 <> 0 GROUP BY path) SELECT path, event_id FROM new WHERE event_id % 5 <> 0 UNION ALL SELECT path, event_id FROM old WHERE path NOT IN (SELECT path FROM new)")
def upsert_with_deletes(spark, sf_dir):
    e = synthetic.event_paths(spark, sf_dir).select("path", "event_id")
    part = lambda rows: e.where(rows).groupBy("path").agg(F.max("event_id").alias("event_id"))
    old = F.col("event_id") % 3 == 0
    return store.upsert(part(old), part(~old).withColumn("gone", F.col("event_id") % 5 == 0), deleted="gone")


@_query(f"WITH {EVENTS} SELECT DISTINCT path FROM ev")
def unique_paths(spark, sf_dir):
    return stats.unique_paths(synthetic.event_paths(spark, sf_dir))


@_query(f"WITH {EVENTS} SELECT count(*) AS total, count(*) FILTER (WHERE NOT ends_with(path, '.js')) AS typescript, count(DISTINCT path) AS unique_files FROM ev")
def event_batch_stats(spark, sf_dir):
    return stats.batch_stats(synthetic.event_paths(spark, sf_dir))


@_query(f"WITH {EVENTS}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM g) SELECT path, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY path, grp")
def debounce(spark, sf_dir):
    d = live.debounce(synthetic.event_paths(spark, sf_dir).select("path", "ts"), "1 hour")
    return d.select("path", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "events")


@_query(f"WITH {EVENTS}, last AS (SELECT path, arg_max(event_type, (ts, event_id)) AS t FROM ev GROUP BY path) SELECT CASE t WHEN 'error' THEN 'legacy' WHEN 'purchase' THEN 'migrated' WHEN 'view' THEN 'partial' ELSE 'no_models' END AS status, count(*) AS n FROM last GROUP BY 1")
def upsert_stats(spark, sf_dir):
    t = F.col("event_type")
    e = synthetic.event_paths(spark, sf_dir).withColumn("status", F.when(t == "error", "legacy").when(t == "purchase", "migrated").when(t == "view", "partial").otherwise("no_models"))
    return store.latest_by(e.select("path", "ts", "event_id", "status"), "path", "ts", "event_id").groupBy("status").agg(F.count("*").alias("n"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'read' END AS error_kind, CASE WHEN s_suppkey % 3 = 0 THEN true END AS recoverable, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_imports FROM supplier")
def error_rows(spark, sf_dir):
    s = F.col("s_suppkey")
    code = F.when(s % 3 == 0, F.unhex(F.lit("696D706F72742027FF273B"))).otherwise(F.lit("import 'a';").cast("binary"))
    d = extract.parse(table(spark, sf_dir, "supplier").select(s.cast("string").alias("path"), code.alias("content")))
    return d.select(F.col("path").cast("bigint").alias("s_suppkey"), "error_kind", status.is_recoverable(F.col("error_kind")).alias("recoverable"), F.size("imports").cast("bigint").alias("n_imports"))


@_query("SELECT event_type, count(*) FILTER (WHERE value > 50)::DOUBLE / nullif(count(*), 0) * 100 AS percent FROM events GROUP BY event_type")
def scan_progress(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(status.scan_progress(F.count_if(F.col("value") > 50), F.count("*")).alias("percent"))


# ---------------------------------------------------------------- predicates and rules on their own
@_query(f"WITH {IMPORTS} SELECT kind, count(*) AS n, kind <> 'side_effect' AS with_bindings, kind = 'dynamic' AS dynamic, kind = 'type_only' AS type_only FROM imp GROUP BY kind")
def import_predicates(spark, sf_dir):
    k = F.col("kind")
    d = extract.flat_imports(_files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))
    return d.select("kind", "n", status.has_bindings(k).alias("with_bindings"), status.is_dynamic(k).alias("dynamic"), status.is_type_only(k).alias("type_only"))


@_query("SELECT count(*) AS classes, count(*) AS interfaces, count(*) FILTER (WHERE p_partkey % 5 = 0) AS reexports FROM part")
def export_predicates(spark, sf_dir):
    d = extract.parse(synthetic.model_files(spark, sf_dir), imports=False, exports=True)
    k = F.col("kind")
    of = {"classes": status.is_class(k), "interfaces": status.is_interface(k), "reexports": status.is_reexport(k)}
    return d.select(F.explode("exports").alias("e")).select("e.kind").agg(*[F.count_if(c).alias(n) for n, c in of.items()])


@_query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Model' WHEN 1 THEN '' WHEN 2 THEN 'CodeGen' WHEN 3 THEN 'CodeGenForApi' WHEN 4 THEN 'CodeGenForm' ELSE 'CodeGenFormArray' END AS suffix, p_partkey % 6 >= 2 AS is_codegen FROM part")
def category_suffixes(spark, sf_dir):
    forms = ("interface", "model", "code_gen", "code_gen_for_api", "code_gen_form", "code_gen_form_array")
    c = F.element_at(F.array(*map(F.lit, forms)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", status.category_suffix(c).alias("suffix"), status.is_codegen(c).alias("is_codegen"))


@_query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'walk' WHEN 1 THEN 'read' WHEN 2 THEN 'parse' WHEN 3 THEN 'config' WHEN 4 THEN 'non_utf8_path' ELSE 'registry' END AS error_kind, p_partkey % 6 IN (1, 2) AS recoverable, p_partkey % 6 NOT IN (1, 2) AS fatal FROM part")
def error_kinds(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, SCAN_ERRORS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("error_kind"), status.is_recoverable(kind).alias("recoverable"), (~status.is_recoverable(kind)).alias("fatal"))


@_query(f"WITH {EVENTS} SELECT event_id, regexp_extract(path, '[^/]+$') AS file_name, regexp_extract(path, '\\.([^.]+)$', 1) AS extension, NOT ends_with(path, '.js') AS typescript FROM ev")
def event_names(spark, sf_dir):
    p = F.col("path")
    return synthetic.event_paths(spark, sf_dir).select("event_id", paths.file_name(p).alias("file_name"), paths.extension(p).alias("extension"), paths.is_typescript(p).alias("typescript"))


@_query(f"WITH {EVENTS} SELECT event_id, path FROM ev WHERE (ends_with(path, '.ts') OR ends_with(path, '.tsx')) AND NOT ends_with(path, '.d.ts') AND NOT contains(path, '.spec.') AND NOT contains(path, 'u-1')")
def accepted_events(spark, sf_dir):
    return live.accepted(synthetic.event_paths(spark, sf_dir), extra=~F.contains("path", F.lit("u-1"))).select("event_id", "path")


@_query("SELECT count(*) AS n, count(DISTINCT url) AS distinct_ids, 0::BIGINT AS missing FROM pages")
def file_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(text.file_id(F.col("url")).alias("id")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.count_if(F.col("id").isNull()).alias("missing"))


@_query("SELECT count(*) AS n, count(DISTINCT epoch(now())::BIGINT) AS instants, bool_and(epoch(now())::BIGINT BETWEEN 1500000000 AND 9999999999) AS in_seconds FROM part")
def scanned_at(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(text.scanned_at().alias("at"))
    return d.agg(F.count("*").alias("n"), F.count_distinct("at").alias("instants"), F.bool_and(F.col("at").between(1500000000, 9999999999)).alias("in_seconds"))


@_query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'ActiveOrder' ELSE 'interfaces' END AS name FROM supplier WHERE s_suppkey % 4 IN (0, 1)")
def registry_guard(spark, sf_dir):
    """A model with a name, a file of interfaces, a file that exports nothing, a file whose name gives none."""
    s = F.col("s_suppkey")
    stem = F.element_at(F.array(*map(F.lit, ("active-order.ts", "interfaces.ts", "active-order.ts", "-.ts"))), (s % 4 + 1).cast("int"))
    code = F.when(s % 4 == 2, "class Hidden {}").otherwise("export class Shown {}").cast("binary")
    files = table(spark, sf_dir, "supplier").select(F.concat(s.cast("string"), F.lit("/"), stem).alias("path"), code.alias("content"), F.lit("shared_legacy").alias("source"), s.alias("seq"))
    return registry.models(files).select(F.col("seq").alias("s_suppkey"), "name")


@_query("SELECT DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN 'shared_legacy' ELSE 'shared2023' END AS source, 'E' || (s_suppkey % 7) AS export_name FROM supplier")
def registry_exports_added(spark, sf_dir):
    """Later registrations of a name replace its definition; the exports of earlier ones stay known."""
    s = F.when(F.col("s_nationkey") % 2 == 0, "shared_legacy").otherwise("shared2023")
    name = F.concat(F.lit("M"), F.col("s_nationkey"))
    rows = table(spark, sf_dir, "supplier").select(name.alias("name"), s.alias("source"), F.array(F.concat(F.lit("E"), F.col("s_suppkey") % 7)).alias("exports"))
    return registry.exports(rows)


@_query(f"WITH {IMPORTS} SELECT file AS path, source, module AS import_path, kind, CASE kind WHEN 'named' THEN 2 WHEN 'side_effect' THEN 0 WHEN 'dynamic' THEN 0 ELSE 1 END::BIGINT AS names FROM imp WHERE source IS NOT NULL")
def import_name_counts(spark, sf_dir):
    return extract.name_counts(_files(spark, sf_dir)).select("path", "source", paths.strip_quotes(F.col("import_path")).alias("import_path"), "kind", "names")


@_query(f"WITH {FLAGS}, {COUNTS}, lines AS (SELECT unnest([(1, 'Total files scanned: ' || total), (2, '  Legacy:           ' || legacy || ' (need migration)'), (3, '  Partial:          ' || partial || ' (in progress)'), (4, '  Migrated:         ' || migrated || ' (complete)'), (5, '  No models:        ' || no_models || ' (no action needed)'), (6, '  Errors:           ' || errors), (7, 'Migration progress: ' || printf('%.1f', coalesce(100.0 * migrated / nullif(legacy + migrated + partial, 0), 100.0)) || '%'), (8, 'Files needing work: ' || (legacy + partial))]) AS r FROM counts) SELECT r[1]::BIGINT AS place, r[2] AS line FROM lines")
def text_summary(spark, sf_dir):
    lines = [x for x in sinks.summary(stats.scan_stats(_files(spark, sf_dir))).split("\n")[3:] if x]
    return spark.createDataFrame(list(enumerate(lines, 1)), "place bigint, line string")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
