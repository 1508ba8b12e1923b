"""PII [native]: fixed formats, and contexts bootstrapped from them.

Entities of the fixed formats are seeds.  The two words before a seed are a
lexical pattern; what stands behind the same two words elsewhere and looks
like an identifier is an instance.  Pattern and instance scores take turns
over that graph: a pattern scores the mean of its instances, damped; an
instance that is no seed scores its best pattern, and from SCORE on it
supports other patterns as a seed does.  Patterns that end with a high score
and enough different supporters add their unseen instances as spans.

Edges are distinct pairs, counted before their shuffle.  A pattern with very
many instances, or an instance with very many patterns, is hot: its score is
broadcast to its edges, of which there are few such keys, and grouped sums
combine before their shuffle.  So no task gathers the edges of one key.

Defined cases: null text counts as empty; repeated rows are rows of their own
and give equal results; ties in a start are ordered by kind; an entity with
fewer than two words before it has no pattern; an empty table gives none;
extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import Hot, bound, bounded, mark, release, stored

# Fixed formats.  Possessive quantifiers and the look-behind keep them linear on any text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # a run of fewer digits can't hold more
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# What may be an identifier in a learnt context.
CANDIDATE = r"(?<![A-Za-z0-9#_.@-])[A-Za-z#_-]*+[0-9][A-Za-z0-9#_-]{4,}+"
#: Characters before an entity in which its pattern is sought first; where these don't hold two whole words, all before it are.
REACH = 128
ROUNDS = 3
#: A pattern adds instances from this score and this many different supporters on.
SCORE, SUPPORT, DAMP = 0.8, 4, 1.0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.char_length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _seen(text: Column) -> Column:
    digits = lambda s: _digits(s["text"])
    return F.concat(
        S.found(text, EMAIL, "email", 0, "@[A-Za-z0-9-]", REACH),
        F.filter(S.found(text, IP, "ip", 1, None, REACH), lambda s: s["text"].rlike(IP_PARTS)),
        F.filter(S.found(text, CARD, "card", 2, None, REACH), lambda s: F.char_length(digits(s)).between(12, 19) & luhn(digits(s))),
        F.filter(S.found(text, PHONE, "phone", 3, None, REACH), lambda s: F.char_length(digits(s)).between(9, 15)),
    )


def context(text: Column, start: Column, lead: Column) -> Column:
    """The two words before ``start``, lower-cased, digits alike; empty if there are none.

    ``lead`` is the REACH characters before ``start``.  Cut off from more, its
    first word counts only if a blank shows where it begins; else the whole
    text before ``start`` is looked at.
    """
    two = r"((?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D]*+$"
    whole = F.regexp_extract(F.substring(text, F.lit(1), start.cast("int")), two, 1)
    near = bound(F.regexp_extract(lead, r"[\x20\x09-\x0D]" + two, 1), lambda n: F.when(n != "", n).otherwise(whole))
    out = F.when(start <= REACH, F.regexp_extract(lead, two, 1)).otherwise(near)
    return F.regexp_replace(F.regexp_replace(F.lower(out), r"[\x20\x09-\x0D]+", " "), "[0-9]", "0")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, more): spans of the fixed formats; pattern and instance of these and of other candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), text.alias("text")).withColumn("base", _seen(F.col("text")))
    d = d.withColumn("cand", S.apart(S.found(F.col("text"), CANDIDATE, "context", 4, None, REACH), F.col("base"), led=True))
    told = lambda seed: lambda s: F.struct(bounded(context(F.col("text"), s["start"], s["lead"])).alias("pattern"), bounded(F.lower(s["text"])).alias("instance"), F.lit(seed).alias("seed"), s["start"].alias("start"), s["end"].alias("end"))
    more = F.concat(F.transform("base", told(True)), F.transform("cand", told(False)))
    plain = F.transform("base", lambda s: s.dropFields("lead"))
    return d.select("doc_id", "th", plain.alias("base"), F.when((F.size("base") > 0) | (F.size("cand") > 0), F.filter(more, lambda m: m["pattern"] != "")).alias("more"))


def patterns(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, support) after ``rounds`` rounds over the distinct (pattern, instance) pairs of ``found``."""
    since = mark()
    edges = stored(found.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    by_pattern, by_instance = Hot(edges, "pattern"), Hot(edges, "instance")
    instances = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    out = None
    for _ in range(rounds):
        weight = F.log1p("n")
        sums = by_instance.join(edges, instances).groupBy("pattern").agg(F.sum(weight * F.col("score")).alias("got"), F.sum(weight).alias("all"), F.count(F.when(F.col("score") >= SCORE, 1)).alias("support"))
        out = stored(sums.select("pattern", (F.col("got") / (F.col("all") + F.lit(DAMP))).alias("score"), "support"))
        by = by_pattern.join(edges, out.select("pattern", F.col("score").alias("by")))
        instances = by.groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(F.col("by"))).alias("score"))
    release(edges.sparkSession, since, out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row of ``docs``."""
    m = stored(marked(docs))
    found = m.where(F.size("more") > 0).select("doc_id", "th", F.explode("more").alias("e")).select("doc_id", "th", "e.*")
    good = patterns(found).where((F.col("score") >= SCORE) & (F.col("support") >= SUPPORT)).select("pattern")
    new = found.where(~F.col("seed"))
    new = Hot(new, "pattern").join(new, good)
    span = F.struct(F.col("start"), F.lit(4).alias("ord"), F.col("end"), F.lit("context").alias("kind"), F.lit("").alias("text"))
    extra = new.groupBy(F.col("doc_id").alias("x_id"), F.col("th").alias("x_th")).agg(F.collect_set(span).alias("extra"))
    d = m.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("th") == F.col("x_th")), "left")
    return d.select("doc_id", "base", F.concat("base", F.coalesce("extra", S.none())).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row."""
    of = lambda kind: S.count_of(F.filter("base", lambda s: s["kind"] == kind))
    return scan(docs).select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(S.joined(F.col("base")), 256).alias("base_sha256"),
        S.joined(F.col("spans")).alias("spans"),
    )
