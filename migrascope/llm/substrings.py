"""Substring dedup over a log-structured index of window fingerprints.

Documents arrive in batches of ascending doc_id.  A batch's 13-word windows
are fingerprinted, sorted and dealt out by fingerprint range.  Per range the
sorted batch is merge-joined with the immutable sorted runs of earlier
batches: a window whose fingerprint a run holds, or that starts in a document
of the batch with a smaller doc_id, is a repeat.  The batch then becomes a
run of its own, and once there are too many runs they are compacted to one.

A fingerprint is a 40-bit key, on which runs are sorted and joined, and a
44-bit check, by which every hit of the join is verified before it counts.
Both roll over hashes of the words of their own, 64 bits each, so words that
agree in one don't in the other.

Rows are packed column blocks, not one row per window: keys as deltas in byte
planes, so a window takes about 12 bytes in the shuffle and 8 in a run.

Defined cases: null text has no words; rows without doc_id are neither
earlier nor later than others and lose nothing; rows that share a doc_id are
one document number, so they don't remove each other's windows; an empty
table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, hash_parts, stored, tidy, workspace

WINDOW = 13
#: Windows a map task sorts and packs at a time.
PACK = 600_000
#: Windows a range of fingerprints is meant to hold over all batches: so many tasks, whatever their number, fit an executor.
RANGE = 4_000_000
#: Ranges of fingerprints per bucket of documents: a range sends a row of repeats to each bucket.
BUCKET_PARTS = 8
#: Bytes of text split at a time.
SPLIT = 2_000_000
#: Words whose hash a worker remembers.
REMEMBER = 300_000
KEY_BITS, CHECK_BITS = 40, 44
#: Odd multipliers of the two rolling hashes and of the final mix.
ROLL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ENTRY = "rng int, bucket int, ids binary, ths binary, doc binary, pos binary, key binary, chk binary, kind int"
WINDOWS, RUN, FLAGS = 0, 1, 2


def pack(a: np.ndarray) -> bytes:
    """Non-negative integers as non-empty byte planes, compressed."""
    planes = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    n = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return bytes([n]) + len(a).to_bytes(6, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:n]).tobytes())


def unpack(b: bytes) -> np.ndarray:
    n, size = b[0], int.from_bytes(b[1:7], "little")
    planes = np.zeros((8, size), np.uint8)
    if n and size:
        planes[:n] = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[7:]), np.uint8).reshape(n, size)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for m, s in zip(MIX, (30, 27), strict=True):
        h = (h ^ (h >> np.uint64(s))) * np.uint64(m)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Numbers of words, and two independent hashes of each by that number."""

    def __init__(self):
        self.hashes = (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.hashes[0].append(h >> 64)
        self.hashes[1].append(h & 0xFFFFFFFFFFFFFFFF)
        n = self[word] = len(self)
        return n

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of all words of some texts, one after the other."""
        if len(self) >= REMEMBER:
            self.clear()
            self.hashes = (array("Q"), array("Q"))
        n = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64)
        return tuple(np.array(h, np.uint64)[n] for h in self.hashes)


def rolled(hashes: tuple[np.ndarray, np.ndarray], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Key and check of each window of ``size`` words, by the two hashes of each word."""
    n = max(0, len(hashes[0]) - size + 1)
    out = []
    for r, own in zip(ROLL, hashes, strict=True):
        a = _mixed(own)
        h = a[:n].copy()
        for j in range(1, size):
            h = h * np.uint64(r) + a[j : j + n]
        out.append(_mixed(h))
    return out[0] >> np.uint64(64 - KEY_BITS), out[1] >> np.uint64(64 - CHECK_BITS)


def _flag_rows(parts: int, rng: int | None, doc: np.ndarray, pos: np.ndarray, id_of: np.ndarray, th_of: np.ndarray) -> list[tuple]:
    """Repeats as one row per bucket of documents, filed under ``rng`` or, without one, under their bucket's number."""
    if not len(doc):
        return []
    buckets = max(1, parts // BUCKET_PARTS)
    bucket = (id_of.view(np.uint64) % np.uint64(buckets)).astype(np.int64)[doc]
    order = np.lexsort((pos, doc, bucket))
    doc, pos, bucket = doc[order], pos[order], bucket[order]
    cut = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        used, local = _local(doc[a:b], len(id_of))
        out.append((int(bucket[a]) if rng is None else rng, int(bucket[a]), _signed(id_of[used]), _signed(th_of[used]), pack(local), pack(pos[a:b]), None, None, FLAGS))
    return out


def _signed(a: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(a).view(np.uint64))


def _local(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``doc``, all below ``n``, and their places in that list."""
    used = np.flatnonzero(np.bincount(doc, minlength=n))
    place = np.zeros(n, np.int32)
    place[used] = np.arange(len(used))
    return used, place[doc]


def _packer(parts: int):
    """Documents in, packed windows by range of key out.

    Inside a pack only the smallest doc_id of a fingerprint goes on; the
    others are flagged here, so a window that very many documents share sends
    one entry per pack, not one per document.
    """
    width = -(-(1 << KEY_BITS) // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = _Words()
        ids: list[int] = []
        ths: list[int] = []
        cols: list[list[np.ndarray]] = [[], [], [], []]
        held = 0

        def split(docs: list[tuple[int, int, bytes]]) -> int:
            """Adds the windows of some documents; their number."""
            texts = [t.split() for _, _, t in docs]
            n = np.array([len(t) for t in texts], np.int64)
            hashes = words_of.of(texts)
            key, chk = rolled(hashes)
            doc = np.repeat(np.arange(len(docs), dtype=np.int32), n)
            pos = (np.arange(len(hashes[0])) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            ok = (pos + WINDOW <= np.repeat(n, n))[: len(key)]
            for c, v in zip(cols, (key[ok], chk[ok], doc[: len(key)][ok] + np.int32(len(ids)), pos[: len(key)][ok]), strict=True):
                c.append(v)
            ids.extend(d for d, _, _ in docs)
            ths.extend(h for _, h, _ in docs)
            return int(ok.sum())

        def packed() -> Iterator[pa.RecordBatch]:
            arrays = [np.concatenate(c) for c in cols]
            for c in cols:
                c.clear()
            id_of, th_of = np.array(ids, np.int64), np.array(ths, np.int64)
            order = _order(arrays[0], arrays[1])
            key, chk, doc, pos = (a[order] for a in arrays)
            del arrays, order
            repeat = id_of[doc] != _least(key, chk, id_of[doc])
            rows = _flag_rows(parts, None, doc[repeat], pos[repeat], id_of, th_of)
            key, chk, doc, pos = (x[~repeat] for x in (key, chk, doc, pos))
            cut = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) * np.uint64(width))
            for r, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    used, local = _local(doc[a:b], len(id_of))
                    rows.append((r, None, _signed(id_of[used]), _signed(th_of[used]), pack(local), pack(pos[a:b]), pack_sorted(key[a:b]), pack(chk[a:b]), WINDOWS))
                if len(rows) >= 256:
                    yield pa.RecordBatch.from_arrays(_columns(rows), names=NAMES)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays(_columns(rows), names=NAMES)

        for b in batches:
            some, size = [], 0
            for d, h, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                text = t.as_py()
                some.append((d.as_py(), h.as_py(), text))
                size += len(text)
                if size >= SPLIT:
                    held += split(some)
                    some, size = [], 0
                    if held >= PACK or len(ids) > 200_000:
                        yield from packed()
                        ids, ths, held = [], [], 0
            if some:
                held += split(some)
        if held:
            yield from packed()

    return run


NAMES = [x.split()[0] for x in ENTRY.split(", ")]
TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 6, pa.int32()]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    cols = list(zip(*rows, strict=True)) or [[]] * len(NAMES)
    return [pa.array(list(c), t) for c, t in zip(cols, TYPES, strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table(_columns(rows), names=NAMES)


def _order(key: np.ndarray, chk: np.ndarray) -> np.ndarray:
    """Sorts fingerprints: by key and the check's upper bits, and by all of it where these don't tell fingerprints apart."""
    most = (key << np.uint64(64 - KEY_BITS)) | (chk.astype(np.uint64) >> np.uint64(KEY_BITS + CHECK_BITS - 64))
    order = np.argsort(most)
    m, c = most[order], chk[order]
    if ((m[1:] == m[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((chk, key))
    return order


def _starts(key: np.ndarray, chk: np.ndarray) -> np.ndarray:
    """Where each of the sorted fingerprints begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chk[1:] != chk[:-1])])


def _least(key: np.ndarray, chk: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id among equal ones of the sorted fingerprints, for each."""
    at = _starts(key, chk)
    return np.repeat(np.minimum.reduceat(ids, at), np.diff(np.r_[at, len(key)])) if len(at) else ids


def _held(key: np.ndarray, chk: np.ndarray, run_key: np.ndarray, run_chk: np.ndarray) -> np.ndarray:
    """Which fingerprints a sorted run holds: joined on the key, verified by the check."""
    at = np.searchsorted(run_key, key)
    out = np.zeros(len(key), bool)
    todo = np.arange(len(key))
    while len(todo):
        todo = todo[at[todo] < len(run_key)]
        todo = todo[run_key[at[todo]] == key[todo]]
        hit = run_chk[at[todo]] == chk[todo]
        out[todo[hit]] = True
        todo = todo[~hit]
        at[todo] += 1
    return out


def _merger(parts: int):
    def merge(table: pa.Table) -> pa.Table:
        """One range: the batch against itself and the runs; flags by bucket of documents, and the batch's new run."""
        every = table.to_pylist()
        out = [tuple(r[c] for c in NAMES) for r in every if r["kind"] == FLAGS]
        rows = [r for r in every if r["kind"] == WINDOWS]
        if rows:
            key = np.concatenate([unpack_sorted(r["key"]) for r in rows])
            chk = np.concatenate([unpack(r["chk"]) for r in rows])
            pos = np.concatenate([unpack(r["pos"]).astype(np.int32) for r in rows])
            ids = [unpack(r["ids"]).view(np.int64) for r in rows]
            start = np.cumsum([0, *map(len, ids)])
            doc = np.concatenate([(unpack(r["doc"]).astype(np.int64) + s).astype(np.int32) for r, s in zip(rows, start, strict=False)])
            id_of, th_of = np.concatenate(ids), np.concatenate([unpack(r["ths"]).view(np.int64) for r in rows])
            order = _order(key, chk)
            key, chk, pos, doc = key[order], chk[order], pos[order], doc[order]
            repeat = id_of[doc] != _least(key, chk, id_of[doc])
            own = _starts(key, chk)
            new_key, new_chk = key[own], chk[own]
            held = np.zeros(len(own), bool)
            for r in (r for r in every if r["kind"] == RUN):
                held |= _held(new_key, new_chk, unpack_sorted(r["key"]), unpack(r["chk"]))
            repeat |= np.repeat(held, np.diff(np.r_[own, len(key)]))
            out += _flag_rows(parts, rows[0]["rng"], doc[repeat], pos[repeat], id_of, th_of)
            out.append((rows[0]["rng"], None, None, None, None, None, pack_sorted(new_key[~held]), pack(new_chk[~held]), RUN))
        return _table(out)

    return merge


def _compact(table: pa.Table) -> pa.Table:
    """One range of several runs as one run; no two runs hold the same fingerprint."""
    rows = table.to_pylist()
    key = np.concatenate([unpack_sorted(r["key"]) for r in rows])
    chk = np.concatenate([unpack(r["chk"]) for r in rows])
    order = _order(key, chk)
    return _table([(rows[0]["rng"], None, None, None, None, None, pack_sorted(key[order]), pack(chk[order]), RUN)])


def _gather(table: pa.Table) -> pa.Table:
    """One bucket of documents: (doc_id, th, pos) with all repeats of each document."""
    ids, ths, doc, pos, n = [], [], [], [], 0
    for r in table.to_pylist():
        i = unpack(r["ids"]).view(np.int64)
        ids.append(i)
        ths.append(unpack(r["ths"]).view(np.int64))
        doc.append(unpack(r["doc"]).astype(np.int64) + n)
        pos.append(unpack(r["pos"]))
        n += len(i)
    id_of, th_of, doc, pos = (np.concatenate(x) for x in (ids, ths, doc, pos))
    order = np.lexsort((pos, th_of[doc], id_of[doc]))
    i, h, pos = id_of[doc][order], th_of[doc][order], pos[order]
    cut = np.r_[0, np.flatnonzero((i[1:] != i[:-1]) | (h[1:] != h[:-1])) + 1, len(i)]
    rows = [(int(i[a]), int(h[a]), pack_sorted(pos[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["f_id", "f_th", "flags"])


@dataclass
class Index:
    """Runs of window fingerprints on shared storage, oldest first, and the largest doc_id they cover.

    While there are more than ``max_runs`` runs, the next batch first has the
    two neighbours that are smallest together compacted.
    """

    spark: SparkSession
    parts: int
    max_runs: int = 2
    runs: list[str] = field(default_factory=list)
    flags: list[str] = field(default_factory=list)
    sizes: dict[str, int] = field(default_factory=dict)
    upto: int | None = None

    def _write(self, rows: DataFrame) -> str:
        path = workspace(self.spark)
        stored(rows, path, "kind")
        run = self._read(path, RUN)
        self.sizes[path] = run.agg(F.coalesce(F.sum(F.octet_length("key") + F.octet_length("chk")), F.lit(0))).first()[0]
        return path

    def _read(self, path: str, kind: int) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(path).where(F.col("kind") == kind)

    def _all(self, paths: list[str], kind: int) -> DataFrame:
        return reduce(DataFrame.unionByName, [self._read(p, kind) for p in paths], self.spark.createDataFrame([], ENTRY))

    def add(self, docs: DataFrame) -> None:
        """Take in the next batch (doc_id, th, text).

        Every doc_id must be larger than all those before.
        """
        ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        if ends[0] is None:
            return
        if self.upto is not None and ends[0] <= self.upto:
            raise ValueError(f"batches must come in ascending doc_id: {ends[0]} after {self.upto}")
        while len(self.runs) > self.max_runs:
            self.compact()
        rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "th", F.col("text").cast("binary")).mapInArrow(tidy(_packer(self.parts)), ENTRY)
        path = self._write(rows.unionByName(self._all(self.runs, RUN)).repartition(self.parts, "rng").groupBy("rng").applyInArrow(_merger(self.parts), ENTRY))
        self.runs.append(path)
        self.flags.append(path)
        self.upto = ends[1]

    def compact(self) -> None:
        """Merge the two neighbouring runs that are smallest together; their flags stay."""
        at = min(range(len(self.runs) - 1), key=lambda i: self.sizes[self.runs[i]] + self.sizes[self.runs[i + 1]])
        old = self.runs[at : at + 2]
        self.runs[at : at + 2] = [self._write(self._all(old, RUN).repartition(self.parts, "rng").groupBy("rng").applyInArrow(_compact, ENTRY))]
        for path in old:
            drop(self.spark, f"{path}/kind={RUN}")

    def close(self) -> None:
        """Remove all runs and flags."""
        for path in {*self.runs, *self.flags}:
            drop(self.spark, path)
        self.runs, self.flags = [], []

    def repeats(self) -> DataFrame:
        """(f_id, f_th, flags): the packed starts of the repeated windows of each document so far."""
        return self._all(self.flags, FLAGS).repartition(max(1, self.parts // BUCKET_PARTS), "bucket").groupBy("bucket").applyInArrow(_gather, "f_id bigint, f_th bigint, flags binary")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, flags) to words kept and lost."""
    for b in batches:
        out: list[list] = [[], [], []]
        for t, flags in zip(b.column(1), b.column(2), strict=True):
            words = (t.as_py() or b"").split()
            lost = 0
            if flags.is_valid:
                starts = unpack_sorted(flags.as_py()).astype(np.int64)
                edge = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + WINDOW, minlength=len(words) + 1)
                keep = np.cumsum(edge[:-1]) == 0
                lost = len(words) - int(keep.sum())
                words = [words[i] for i in np.flatnonzero(keep)]
            out[0].append(len(words) + lost)
            out[1].append(lost)
            out[2].append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _finish(batches):
        sha = pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in b.column(3)])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], sha], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, batches: int, max_runs: int) -> DataFrame:
    """(doc_id, text, flags) per row of ``docs``."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    # a word and its blank take six bytes or more in most texts, so this is about the number of windows
    cuts, size = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10000), F.sum(F.octet_length("text"))).first()
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    index = Index(spark, max(2 * hash_parts(spark), -(-(size or 0) // (6 * RANGE))), max_runs)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = keyed.where(F.col("doc_id").isNotNull())
        part = part.where(F.col("doc_id") > low) if low is not None else part
        part = part.where(F.col("doc_id") <= high) if high is not None else part
        index.add(part)
    by_doc = stored(index.repeats())
    index.close()
    joined = keyed.join(by_doc.hint("shuffle_hash"), (F.col("doc_id") == F.col("f_id")) & (F.col("th") == F.col("f_th")), "left")
    return joined.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), "flags")


def dedup(docs: DataFrame, batches: int = 3, max_runs: int = 1) -> DataFrame:
    """(doc_id, n_words, n_removed, text): ``text`` is the kept words, joined by one space."""
    rows = _joined(docs, batches, max_runs).mapInArrow(tidy(_finish), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
    return rows.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("text"))


def digest(docs: DataFrame, batches: int = 3, max_runs: int = 1) -> DataFrame:
    """The contract's columns for every row: a written table, as its rows are few bytes and the texts behind them many."""
    return stored(_joined(docs, batches, max_runs).mapInArrow(tidy(_digested), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"))
