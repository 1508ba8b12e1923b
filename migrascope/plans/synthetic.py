"""Source trees made from the star-schema tables, so that SQL knows the answer without parsing.

Each order is a file, each of its line items an import: its return flag picks
the library, its line number the kind of import.  Decoys stand between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order of a file's imports; rows alike in these give the same text.
KEYS = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")

HEAD = "// é header: import { Fake } from '../shared/models/fake';\n"
MODULE = "CASE l_returnflag WHEN 'R' THEN concat('../shared/models/p-', l_partkey) WHEN 'A' THEN concat('../shared_2023/models/p-', l_partkey) ELSE concat('@angular/core-', l_partkey) END"
STATEMENT = f"""CASE l_linenumber % 6
  WHEN 0 THEN concat('import {{ P', l_partkey, ', S', l_suppkey, ' as Other }} from ''', {MODULE}, ''';')
  WHEN 1 THEN concat('import D', l_partkey, ' from "', {MODULE}, '";')
  WHEN 2 THEN concat('import * as N', l_partkey, ' from ''', {MODULE}, ''';')
  WHEN 3 THEN concat('import ''', {MODULE}, ''';')
  WHEN 4 THEN concat('import type {{ T', l_partkey, ' }} from ''', {MODULE}, ''';')
  ELSE concat('const m = await import(''', {MODULE}, ''');') END"""
DECOY = "/* import 'x' */ const s = \"import '../shared/models/decoy'\"; const t = `import '../shared_2023/models/decoy'`;\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_path(key: Column) -> Column:
    return F.concat(F.lit("src/app/o-"), key, F.lit(".ts"))


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): one file per order; orders without line items import nothing."""
    # Dealt by key to a stated number of partitions: parsing costs far more than these bytes
    # tell, so they must not be coalesced to a few tasks.
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *KEYS).repartition(n, "l_orderkey").withColumn("code", F.expr(STATEMENT))
    code = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*KEYS, "code"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit(DECOY), x["code"])), "\n")
    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(n, "o_orderkey")
    d = orders.join(code, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return d.select(order_path(F.col("o_orderkey")).alias("path"), F.concat(F.lit(HEAD), F.coalesce(body, F.lit(""))).cast("binary").alias("content"))


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content, source, seq): a model per part; even part keys are legacy, odd ones modern."""
    p = F.col("p_partkey")
    side = F.when(p % 2 == 0, "shared").otherwise("shared_2023")
    name = F.concat(F.lit("P"), p)
    code = F.concat(
        F.lit("// export class Fake {}\nexport class "), name, F.lit(" extends Base { x = 'export { No }'; }\nexport interface "), name, F.lit("Model { a: string; }\n"),
        F.when(p % 3 == 0, F.concat(F.lit("export { X"), p, F.lit(", Y"), p, F.lit(" as Z };\n"))).otherwise(F.lit("export const k = 1;\n")),
        F.when(p % 5 == 0, F.concat(F.lit("export { R"), p, F.lit(" } from './r';\n"))).otherwise(F.lit("export * from './all';\n")),
    )
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("app/"), side, F.lit("/models/part-model-"), p % 50, F.lit("."), p, F.lit(".ts")).alias("path"),
        code.cast("binary").alias("content"),
        F.when(p % 2 == 0, "shared_legacy").otherwise("shared2023").alias("source"),
        p.alias("seq"),
    )


def event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events (event_id, path, ts, hash): each user is a path."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    ext = F.element_at(F.array(*map(F.lit, ("ts", "tsx", "js", "d.ts", "spec.ts"))), (u % 5 + 1).cast("int"))
    return e.select("event_id", F.concat(F.lit("src/u-"), u, F.lit("."), ext).alias("path"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.md5(F.concat_ws("|", "event_type", F.col("event_id") % 3)).alias("content_hash"))
