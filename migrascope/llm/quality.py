"""Quality rules: base rules, and robust multivariate outliers.

Every text gets counts; from these a vector of transformed statistics.  For
each language and source the minimum-covariance-determinant estimate of
location and scatter is sought by concentration steps, and a text whose
vector lies too far from it in Mahalanobis distance is rejected.

A concentration step keeps, per group, the share H of rows nearest to the
current estimate and estimates anew from these.  It runs as two grouped sums:
rows are summed per group and narrow bin of distance (count, sums and
cross-products, combined before the shuffle), and per group the bins are
taken from the nearest on until they hold that share, of the last one as much
as is missing.  So every row counts, and no group is ever gathered.  Steps
end once no determinant changes any more, or after STEPS of them.  Two
deterministic starts (scaled medians; the correlation of the squashed
coordinates) are carried on side by side, and the smaller determinant wins.
FLOOR is added to the scatter, so a statistic that is constant in most texts
rejects no small deviation.

A group of fewer than GROUP rows takes the estimate of its language, and a
language of fewer that of all rows.

Defined cases: null text has no words and fails the base rules; null language
or source is a group of its own; repeated rows count each; an empty table
gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Hot, bounded, clean_documents, mark, release, stored, tidy

#: Smoothing of the ratios: words or lines of an average text put to each text.
PRIOR_WORDS, PRIOR_LINES, PRIOR_CHARS = 20, 5, 5.2
#: Share of rows in a concentration step, most steps, rows a group needs, and bins per doubling of the squared distance.
H, STEPS, GROUP, FINE = 0.75, 12, 50, 8
#: Change of a log-determinant that ends the steps.
STILL = 1e-3
#: Standard deviation added to each statistic.
FLOOR = (0.035, 0.15, 0.2, 0.2, 0.012)
DIM = len(FLOOR)
#: Share of clean texts, were they normal, that the cut rejects.
TAIL = 1e-8
SYMBOLS = b"#*$%&|<>"
COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if len(number) == len(words):
        return 0
    key, width = ids[:n], len(number)
    for j in range(1, size):
        if width * len(number) >= 1 << 62:  # number the windows so far anew
            _, key = np.unique(key, return_inverse=True)
            width = int(key.max()) + 1
        key, width = key * len(number) + ids[j : j + n], width * len(number)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple[list, list[float]]:
    """The counts of a text, and its transformed statistics."""
    t = text or b""
    words = t.split()
    n = len(words)
    chars = len(t.decode("utf-8", "replace")) - sum(t.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(t.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = [x for x in t.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    failed = n < 10 or 100 * repeat > 20 * n
    m = n + PRIOR_WORDS
    x = [
        math.log((chars + PRIOR_WORDS * PRIOR_CHARS) / m),
        math.log1p(10 * symbols / m),
        math.sqrt(dup / (len(lines) + PRIOR_LINES)),
        math.sqrt(repeat / m),
        math.log(len(set(words)) + PRIOR_WORDS) / math.log(m),
    ]
    return [n, chars, symbols, dup, repeat, failed], x


def _measurer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.schema.get_field_index("__bytes")
            got = [measure(t.as_py()) for t in b.column(text)]
            counts = list(zip(*(g[0] for g in got), strict=True)) or [[]] * 6
            cols = [pa.array(list(c), pa.int64()) for c in counts[:5]] + [pa.array(list(counts[5]), pa.bool_())]
            x = pa.array([g[1] for g in got], pa.list_(pa.float64()))
            keep = [i for i in range(b.num_columns) if i != text]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], *cols, x], names=[*[b.schema.names[i] for i in keep], *names])

    return run


def statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of each row with its counts and ``x``, the transformed statistics."""
    d = docs.select(*columns, F.col("text").cast("binary").alias("__bytes"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    names = [x.split()[0] for x in COUNTS.split(", ")] + ["x"]
    return d.mapInArrow(tidy(_measurer(names)), f"{kept}, {COUNTS}, x array<double>")


def chi2_below(x: float, k: int) -> float:
    """Chance that a chi-squared variable of ``k`` degrees is at most ``x``: series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_at(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < share else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest ``share`` of normal rows that of all."""
    return 1.0 if share >= 1 else share / chi2_below(chi2_at(share, DIM), DIM + 2)


def _moments(x: Column) -> list[Column]:
    """Sums for a mean and a covariance."""
    at = lambda i: F.element_at(x, i + 1)
    return [F.sum(at(i)).alias(f"s{i}") for i in range(DIM)] + [F.sum(at(i) * at(j)).alias(f"s{i}_{j}") for i in range(DIM) for j in range(i, DIM)]


MOMENTS = [f"s{i}" for i in range(DIM)] + [f"s{i}_{j}" for i in range(DIM) for j in range(i, DIM)]
ESTIMATE = "pool string, start int, center array<double>, inverse array<double>, logdet double, was double, pool_n bigint"


def _centred(row: dict) -> tuple[np.ndarray, np.ndarray]:
    n = row["n"]
    mean = np.array([row[f"s{i}"] for i in range(DIM)]) / n
    cov = np.zeros((DIM, DIM))
    for i in range(DIM):
        for j in range(i, DIM):
            cov[i, j] = cov[j, i] = row[f"s{i}_{j}"] / n - mean[i] * mean[j]
    return mean, cov


def _estimates(rows: list[tuple[dict, int, np.ndarray, np.ndarray, float | None]]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(7)]
    for r, start, mean, cov, was in rows:
        full = cov + np.diag(np.square(FLOOR))
        for c, v in zip(out, (r["pool"], start, mean.tolist(), np.linalg.inv(full).ravel().tolist(), float(np.linalg.slogdet(full)[1]), was, r["pool_n"]), strict=True):
            c.append(v)
    types = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split()[0] for x in ESTIMATE.split(", ")])


def _concentrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            mean, cov = _centred(r)
            rows.append((r, r["start"], mean, cov * consistency(min(1.0, r["n"] / r["pool_n"])), r["was"]))
        yield _estimates(rows)


def _started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            middle, scale = np.array(r["middle"]), np.array(r["scale"])
            rows.append((r, 0, middle, np.diag(scale**2), None))
            _, cov = _centred(r)
            d = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rows.append((r, 1, middle, cov / np.outer(d, d) * np.outer(scale, scale), None))
        yield _estimates(rows)


def distance(x: Column, center: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    d = [F.element_at(x, i + 1) - F.element_at(center, i + 1) for i in range(DIM)]
    terms = [d[i] * d[j] * F.element_at(inverse, i * DIM + j + 1) * (1 if i == j else 2) for i in range(DIM) for j in range(i, DIM)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _pool(level: str, *keys: str) -> Column:
    return bounded(F.to_json(F.struct(F.lit(level).alias("level"), *keys)))


def fit(stats: DataFrame) -> DataFrame:
    """(lang, source, center, inverse) for every language and source of ``stats``."""
    since = mark()
    group, lang = _pool("source", "lang", "source"), _pool("lang", "lang")
    counts = stored(stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("base_failed"), 1)).alias("n")).withColumns({"group": group, "of_lang": lang}))
    n_groups = counts.count()
    langs = counts.groupBy("of_lang").agg(F.sum("n").alias("n_lang"), (F.min("n") < GROUP).alias("short"))
    counts = stored(Hot(counts, "of_lang", n_groups).join(counts, langs))
    lone = (F.col("n") < GROUP) & (F.col("n_lang") < GROUP)
    pool = F.when(F.col("n") >= GROUP, F.col("group")).when(lone, F.lit("all")).otherwise(F.col("of_lang"))
    pools = counts.select("lang", "source", "group", pool.alias("pool"))
    # A language's estimate looks at all its rows, also those of groups with one of their own.
    everything = F.lit("all") if counts.agg(F.max(lone)).first()[0] else F.lit(None).cast("string")
    own = F.array_compact(F.array(F.when(F.col("n") >= GROUP, F.col("group")), F.when(F.col("short") & (F.col("n_lang") >= GROUP), F.col("of_lang")), everything))
    own = counts.select("group", own.alias("pools"))
    ok = stats.where(~F.col("base_failed")).select(group.alias("group"), "x")
    rows = Hot(ok, "group", n_groups).join(ok, own).select(F.explode("pools").alias("pool"), "x")
    by_pool = Hot(rows, "pool", 2 * n_groups)
    quart = lambda i: F.percentile_approx(F.element_at("x", i + 1), [0.25, 0.5, 0.75], 2000).alias(f"q{i}")
    q = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("pool_n"), *[quart(i) for i in range(DIM)])
    robust = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOOR[i] / 4)) for i in range(DIM)]
    q = stored(q.select("pool", "pool_n", F.array(*[F.col(f"q{i}")[1] for i in range(DIM)]).alias("middle"), F.array(*robust).alias("scale")))
    z = F.array(*[F.tanh((F.element_at("x", i + 1) - F.element_at("middle", i + 1)) / F.element_at("scale", i + 1)) for i in range(DIM)])
    squashed = by_pool.join(rows, q).select("pool", z.alias("z")).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), *_moments(F.col("z")))
    now = stored(squashed.join(q, "pool").mapInArrow(_started, ESTIMATE))
    for _ in range(STEPS):
        d2 = distance(F.col("x"), F.col("center"), F.col("inverse"))
        near = by_pool.join(rows, now).select("pool", "start", "x", "pool_n", "logdet", F.floor(F.log2(d2 + 2.0**-10) * FINE).cast("int").alias("bin"))
        bins = near.groupBy("pool", "start", "bin").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in ("pool_n", "logdet")], *_moments(F.col("x")))
        before = Window.partitionBy("pool", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("missing", F.ceil(F.col("pool_n") * H) - F.coalesce(F.sum("n").over(before), F.lit(0))).where("missing > 0")
        share = F.least(F.col("missing") / F.col("n"), F.lit(1.0))
        half = bins.groupBy("pool", "start").agg(F.max("pool_n").alias("pool_n"), F.max("logdet").alias("was"), F.sum(F.col("n") * share).alias("n"), *[F.sum(F.col(m) * share).alias(m) for m in MOMENTS])
        now = stored(half.mapInArrow(_concentrated, ESTIMATE))
        if (now.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0] or 0.0) <= STILL:
            break
    best = now.groupBy("pool").agg(F.min_by(F.struct("center", "inverse"), F.struct("logdet", "start")).alias("b"))
    rules = stored(Hot(pools, "pool", n_groups).join(pools, best, "left").select("lang", "source", "b.center", "b.inverse"))
    release(stats.sparkSession, since, rules)
    return rules


def judged(stats: DataFrame, rules: DataFrame) -> DataFrame:
    """``stats`` with ``distance2`` and ``kept``."""
    group = _pool("source", "lang", "source")
    stats = stats.withColumn("__group", group)
    side = rules.select(group.alias("__group"), "center", "inverse")
    d = Hot(stats, "__group", rules.count()).join(stats, side, "left")
    d = d.withColumn("distance2", distance(F.col("x"), F.col("center"), F.col("inverse")))
    kept = ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= chi2_at(1 - TAIL, DIM))
    return d.withColumn("kept", kept).drop("__group", "center", "inverse")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row, and the squared distance."""
    stats = stored(statistics(docs, "doc_id", "lang", "source"))
    names = [x.split()[0] for x in COUNTS.split(", ")]
    return judged(stats, fit(stats)).select("doc_id", *names, "kept", "distance2")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept; texts are measured once and never take part in a shuffle."""
    d = clean_documents(docs)
    stats = stored(statistics(d, *d.columns))
    return judged(stats, fit(stats.select("lang", "source", "base_failed", "x"))).where("kept").select(*d.columns)
