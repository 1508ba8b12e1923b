"""Secret scans [native]: fixed formats plus sliding-window Shannon entropy.

Everything is a narrow projection over each whole text: no shuffle, no
Python.  Null text counts as empty.  Repeated rows are scanned alike, each on
its own; extra columns play no part.  Ties in a start are ordered by kind.  Of a
run that base spans cover in part, the rest is scored by itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import clean_documents

# Fixed formats of the base kinds.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
)
# The value starts behind the first separator, its blanks and one quote.
ASSIGN_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20+: a shorter rest of the run can't match either
HEX = r"[0-9a-f]{24,}"
# Candidates of the entropy scan: runs of key characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
# Alphabets by character class, and the entropy in bits that a window of 20 must reach.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
CLASSES = (("hex", r"^[0-9a-f]+$", 16, 2.95), ("lower", r"^[0-9a-z]+$", 36, 3.35), ("mixed", r".", len(ALPHABET), 3.65))
# Allow-list: strings that look random but are no secrets.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",  # UUID
    r"^[0-9_-]+$",  # numbers, dates
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|lorem",
    r"^(?:[A-Za-z]+[/_-])+[A-Za-z]+[0-9]{0,4}$",  # paths and slugs of words
    r"^[A-Za-z]+[0-9]{0,4}$",  # one word, numbered or not
)


def window_entropy(s: Column, size: int) -> Column:
    """Largest Shannon entropy in bits of any ``WINDOW`` characters of ``s``.

    One fold over the string keeps the count of each character in the window
    and the sum of c*log2(c); a step touches only the counts of the character
    that enters and the one that leaves.  Shorter strings give 0.
    """
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(ALPHABET)))
    c_log = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    f = lambda n: F.element_at(c_log, n + 1)
    state = F.struct(F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("sum"), F.lit(1e9).alias("least"))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new = F.element_at(codes, i)
            old = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
            n_new = F.element_at(acc["n"], new)
            n_old = F.when(old > 0, F.element_at(acc["n"], F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
            same = new == old
            total = F.when(same, acc["sum"]).otherwise(acc["sum"] - f(n_new) + f(n_new + 1) - f(n_old) + f(F.greatest(n_old - 1, F.lit(0))))
            counts = F.when(same, acc["n"]).otherwise(F.transform(acc["n"], lambda n, k: n + F.when(k + 1 == new, 1).otherwise(0) - F.when(k + 1 == old, 1).otherwise(0)))
            return F.struct(counts.alias("n"), total.alias("sum"), F.when(i >= WINDOW, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), state, step, lambda acc: F.when(acc["least"] > 1e8, 0.0).otherwise(F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW))

    # bound to a lambda's variable, the codes are computed once, not at every step
    return F.get(F.transform(F.array(codes), over), F.lit(0))


def outside(run: Column, base: Column) -> Column:
    """What of ``run`` lies outside the spans ``base``, as an array of spans."""
    zero = F.struct(run["start"].alias("at"), S.none().alias("out"))

    def piece(a: Column, b: Column) -> Column:
        text = F.substring(run["text"], (a - run["start"] + 1).cast("int"), (b - a).cast("int"))
        return F.array(F.struct(a.alias("start"), run["ord"].alias("ord"), b.alias("end"), run["kind"].alias("kind"), text.alias("text")))

    def step(acc: Column, b: Column) -> Column:
        lead = F.when(b["start"] > acc["at"], piece(acc["at"], b["start"])).otherwise(S.none())
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], lead).alias("out"))

    met = F.array_sort(F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])))
    rest = lambda acc: F.concat(acc["out"], F.when(acc["at"] < run["end"], piece(acc["at"], run["end"])).otherwise(S.none()))
    return F.aggregate(met, zero, step, rest)


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, ord, end, kind, text) in code points."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda s: F.regexp_extract(s["text"], ASSIGN_VALUE, 1)
    base = F.concat(
        F.filter(S.found(text, ASSIGN, "assign", 0), lambda s: F.char_length(value(s)) >= 6),
        S.found(text, ACCESS, "access", 1),
        S.found(text, HEX, "hex", 2),
    )

    def is_candidate(s: Column) -> Column:
        ok = s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]")
        for p in ALLOWED:
            ok = ok & ~s["text"].rlike(p)
        return ok

    def random_enough(s: Column) -> Column:
        out = F.lit(False)
        for _, shape, size, bits in reversed(CLASSES):
            out = F.when(s["text"].rlike(shape), window_entropy(s["text"], size) >= bits).otherwise(out)
        return out

    runs = F.when(text.rlike(CANDIDATE), S.found(text, CANDIDATE, "entropy", 3)).otherwise(S.none())
    out = docs.withColumn("base", base).withColumn("runs", runs)
    # what base spans leave of a run is a candidate of its own if it still has the shape of one
    left = F.filter(F.flatten(F.transform("runs", lambda s: outside(s, F.col("base")))), lambda s: s["text"].rlike(f"^{CANDIDATE}$"))
    free = F.when((F.size("runs") > 0) & (F.size("base") > 0), left).otherwise(F.col("runs"))
    out = out.withColumn("runs", F.filter(free, is_candidate))
    more = F.when(F.size("runs") > 0, F.filter("runs", random_enough)).otherwise(S.none())
    return out.withColumn("spans", F.concat("base", more)).drop("runs")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of ``docs``."""
    d = scan(docs.select("doc_id", "text"))
    of = lambda kind: S.count_of(F.filter("base", lambda s: s["kind"] == kind))
    return d.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret replaced by ``mark`` and ``n_chars`` counted anew; clean rows stay as they are."""
    d = scan(clean_documents(docs))
    hit = F.size("spans") > 0
    return (
        d.withColumn("masked", F.when(hit, S.masked(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text")))
        .withColumn("n_chars", F.when(hit, F.char_length("masked").cast("bigint")).otherwise(F.col("n_chars")))
        .withColumn("text", F.col("masked"))
        .drop("masked", "base", "spans")
    )
