"""SimHash near-duplicates by covering locality-sensitive hashing.

A family of 2^(r+1)-1 bit masks is built from vectors m(i) in {0,1}^(r+1), one
per bit position: mask v keeps the positions with <m(i), v> odd.  Two
fingerprints that differ in at most r positions span at most r dimensions, so
some v is orthogonal to all of them: under that mask the two agree.  No pair
within the radius is missed; every pair found is verified by its distance.

Defined cases: null text counts as empty; texts without words have the
fingerprint zero and link like any other; rows without doc_id take no part in
the groups and form none; repeated rows repeat in the result; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_LEAST, HOT_SHARE, clean_documents, drop, hash_parts, mark, release, small, stored, tidy, workspace

SEED = 42
RADIUS = 3
BITS = 64
SHINGLE = 3
#: Rows of a bucket that one task compares with each other; larger buckets are split into pairs of blocks,
#: and those of over CROWD blocks first by a second family of masks.
BLOCK, CROWD = 2048, 16
#: Shingles hashed at a time.
CHUNK = 1 << 18


def fingerprint(text: bytes | None) -> int:
    """Bit i is set if over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()  # ASCII only, on the six blanks
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    count = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        h = np.fromiter((digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:], strict=False)), np.uint64, len(part) - SHINGLE + 1)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(tidy(_fingerprints), "doc_id bigint, fp bigint")


def masks(radius: int = RADIUS, bits: int = BITS, second: bool = False) -> list[int]:
    """The covering masks: balanced, as each vector of {0,1}^(r+1) serves equally many positions.

    The second family gives neighbouring positions one vector, so its masks cut across those of the first.
    """
    size = 1 << (radius + 1)
    vector = lambda i: i * size // bits if second else i % size
    return [sum(1 << i for i in range(bits) if bin(vector(i) & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (root, reached) of a spanning forest of the links among ``fp``, by search from each root."""
    left, out = np.arange(len(fp)), []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        root = todo[0]
        while todo and len(left):
            near = np.bitwise_count(fp[left] ^ fp[todo.pop()]) <= radius
            if near.any():
                hit = left[near]
                out.append((np.full(len(hit), root), hit))
                todo.extend(hit)
                left = left[~near]
    return out


def _linker(radius: int):
    """Rows sorted by bucket in, edges out; a bucket never holds more than two blocks."""

    def edges(bucket: np.ndarray, fp: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        cut = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        lo, hi = np.r_[0, cut], np.r_[cut, len(bucket)]
        two = lo[hi - lo == 2]
        if len(two):
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            found.append((node[two], node[two + 1]))
        for a, b in zip(lo[hi - lo > 2], hi[hi - lo > 2], strict=True):
            found.extend((node[a:b][x], node[a:b][y]) for x, y in _spanning(fp[a:b], radius))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            now = np.stack([b.column(i).to_numpy() for i in range(3)])
            if held:
                now = np.concatenate([*held, now], axis=1)
            last = int(np.searchsorted(now[0], now[0, -1]))  # the last bucket may go on in the next batch
            held = [now[:, last:]]
            yield from told(edges(now[0, :last], now[1, :last].view(np.uint64), now[2, :last]) if last else [])
        if held:
            now = np.ascontiguousarray(held[0])
            yield from told(edges(now[0], now[1].view(np.uint64), now[2]))

    def told(found: list) -> Iterator[pa.RecordBatch]:
        if found:
            a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v), u > v, that connect what links within ``radius``; not every pair.

    ``nodes``: (fp, node), each fp once.  A bucket of more than CROWD * BLOCK
    rows is split by the second family of masks, under which each of its pairs
    within the radius meets again, a row once per mask.  One that still has
    more than BLOCK rows is dealt out as pairs of blocks, so no task meets an
    unbounded bucket and every pair of its rows still meets in one task.
    """
    parts = hash_parts(nodes.sparkSession)

    def tables(d: DataFrame, second: bool, *within: str) -> DataFrame:
        key = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius, second=second))]
        d = d.select(*within, "fp", "node", F.explode(F.array(*key)).alias("x"))
        return d.select(F.xxhash64(*within, "x.t", "x.key").alias("bucket"), "fp", "node")

    def over(d: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """Buckets of more than ``rows`` rows, and their number."""
        hot = stored(d.groupBy("bucket").count().where(F.col("count") > rows).select(F.col("bucket").alias("b"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        return hot, hot.count()

    keyed = tables(nodes, False)
    hot, n = over(keyed, BLOCK)
    crowd = hot.where(F.col("blocks") > CROWD)
    n_crowd = crowd.count() if n else 0
    if n_crowd:
        on = F.col("bucket") == F.col("b")
        again = keyed.join(small(crowd, n_crowd), on, "left_semi")
        keyed = keyed.join(small(crowd, n_crowd), on, "left_anti").unionByName(tables(again, True, "bucket"))
        hot, n = over(keyed, BLOCK)
    if n:
        k = keyed.join(small(hot, n), F.col("bucket") == F.col("b"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        k = k.withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "fp"), F.col("blocks")))
        k = k.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
        keyed = k.select(F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(pair).alias("bucket"), "fp", "node")
    dealt = keyed.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(_linker(radius)), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of ``edges`` (u > v) is connected with.

    Alternating large-star and small-star steps; each aggregates minima before
    its shuffle, and each round is a written table.  Where a node could be the
    hub of very many edges, what such hubs need is broadcast: there are fewer
    than HOT_SHARE of them.
    """
    spark = edges.sparkSession
    path, before = None, None
    now, n = edges, edges.count()

    def told(rows: DataFrame, of: DataFrame) -> DataFrame:
        """``rows`` with ``m`` of their u, from ``of`` (x, m, n): one row per u and how many rows it has."""
        if n <= HOT_LEAST * HOT_SHARE:
            return rows.join(of, F.col("u") == F.col("x"))
        of = stored(of)
        most = 2 * n // HOT_SHARE
        hubs = F.broadcast(of.where(F.col("n") > most))
        rest = rows.join(hubs, F.col("u") == F.col("x"), "left_anti").join(of.where(F.col("n") <= most), F.col("u") == F.col("x"))
        return rows.join(hubs, F.col("u") == F.col("x")).unionByName(rest)

    while True:
        since = mark()
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "n")
        large = told(both, least).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("x"), "m", "n")
        tied = told(large, low)
        star = tied.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        fresh = workspace(spark)
        now = stored(star.where(F.col("u") > F.col("v")).distinct(), fresh)
        said = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(spark, since, now)
        if path:
            drop(spark, path)
        path, n = fresh, said[0]
        if said == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = said


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id): the smallest doc_id reachable, per distinct fingerprint of ``prints``."""
    nodes = stored(prints.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    tree = components(stored(links(nodes, radius)))
    return nodes.join(tree, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))


def digest(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The contract's columns for every row."""
    prints = stored(fingerprints(docs))
    g = groups(prints, radius).withColumnRenamed("fp", "g")
    d = prints.join(g, F.col("fp") == F.col("g"), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))


def dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the row whose doc_id names the group.

    Rows that repeat that doc_id are one document: of them the smallest text
    hash stays.  Rows without doc_id all stay.
    """
    docs = clean_documents(docs)
    prints = stored(fingerprints(docs))
    keep = groups(prints, radius).select(F.col("component_id").alias("__keep")).distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(keep, F.col("doc_id") == F.col("__keep"), "left_semi")
    again = prints.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again"))
    again = stored(again)
    if not again.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text", "lang", "source"))
        twice = named.join(again, F.col("doc_id") == F.col("__again"), "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        named = named.join(again, F.col("doc_id") == F.col("__again"), "left_anti").unionByName(twice)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
