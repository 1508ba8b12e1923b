"""Regular-expression spans in code points, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import bound

#: Matches whose spans are gathered at a time.
BLOCK = 128
SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,text:string>>"
LED = "array<struct<start:bigint,ord:int,end:bigint,kind:string,text:string,lead:string>>"


def none(led: bool = False) -> Column:
    return F.from_json(F.lit("[]"), LED if led else SPAN)


def found(text: Column, pattern: str, kind: str, order: int, probe: str | None = None, reach: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of spans.

    The pieces between the matches (``split``) and the matches themselves
    (``regexp_extract_all``) give every start as a running sum of lengths.
    Texts in which ``probe`` (the pattern itself by default) is not found
    skip that work.  With ``reach``, a span has the ``reach`` characters
    before it as ``lead``, kept along the way, so none is sought from the
    start of a long text.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(pieces, hits, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), lambda x: x["m"].isNotNull())
    empty = none(reach > 0)
    last = lambda c: F.right(c, F.lit(reach)) if reach else F.lit("")
    state = lambda at, tail, out: F.struct(at.alias("at"), tail.alias("tail"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])

        def with_lead(lead: Column) -> Column:
            one = [start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text")]
            one = F.struct(*one, lead.alias("lead")) if reach else F.struct(*one)
            return state(end, last(F.concat(lead, x["m"])) if reach else lead, F.concat(acc["out"], F.array(one)))

        return bound(last(F.concat(acc["tail"], x["p"])), with_lead) if reach else with_lead(F.lit(""))

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, state(acc["at"], acc["tail"], empty), step, lambda o: state(o["at"], o["tail"], F.concat(acc["out"], F.array(o["out"]))))

    zero = state(F.lit(0).cast("bigint"), F.lit(""), _nested(reach > 0))
    spans = bound(pairs, lambda pairs: F.when(F.size(pairs) == 0, empty).otherwise(F.aggregate(_blocks(pairs), zero, block, lambda acc: F.flatten(acc["out"]))))
    return F.when(text.rlike(probe or pattern), spans).otherwise(empty)


def apart(some: Column, base: Column, led: bool = False) -> Column:
    """The spans of ``some`` (ascending, none overlapping another) that overlap none of ``base``.

    One pass over both in the order of their starts, so a text with very many
    spans costs their sorting: the furthest end of the base spans so far
    decides about what begins before it, and a span waits for the next base
    span to begin behind it.
    """
    as_item = lambda mine: lambda s: F.struct(s["start"].alias("start"), F.lit(mine).alias("mine"), s.alias("span"))
    items = F.array_sort(F.concat(F.transform(base, as_item(0)), F.transform(some, as_item(1))))
    empty = none(led)
    nothing = F.get(empty, F.lit(0))
    state = lambda far, wait, out: F.struct(far.alias("far"), wait.alias("wait"), out.alias("out"))
    ready = lambda acc: F.when(acc["wait"].isNotNull(), F.array(acc["wait"])).otherwise(empty)

    def step(acc: Column, x: Column) -> Column:
        s, mine = x["span"], x["mine"] == 1
        far = F.when(mine, acc["far"]).otherwise(F.greatest(acc["far"], s["end"]))
        wait = F.when(mine & (s["start"] >= acc["far"]), s).otherwise(nothing)
        cut = ~mine & (acc["wait"]["end"] > s["start"])
        return state(far, wait, F.when(F.coalesce(cut, F.lit(False)), acc["out"]).otherwise(F.concat(acc["out"], ready(acc))))

    def block(acc: Column, some: Column) -> Column:
        return F.aggregate(some, state(acc["far"], acc["wait"], empty), step, lambda o: state(o["far"], o["wait"], F.concat(acc["out"], F.array(o["out"]))))

    zero = state(F.lit(0).cast("bigint"), nothing, _nested(led))
    ended = lambda acc: F.concat(F.flatten(acc["out"]), ready(acc))
    return F.when((F.size(some) == 0) | (F.size(base) == 0), some).otherwise(bound(items, lambda all_: F.aggregate(_blocks(all_), zero, block, ended)))


def _nested(led: bool) -> Column:
    return F.from_json(F.lit("[]"), f"array<{LED if led else SPAN}>")


def _blocks(items: Column) -> Column:
    """A non-empty array in slices of BLOCK.

    What a fold makes of a block is gathered apart, and the blocks are flattened
    at the end, so nothing is copied more than BLOCK times.
    """
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK)), lambda j: F.slice(items, (j * BLOCK + 1).cast("int"), F.lit(BLOCK)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then the kinds' order, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column) -> Column:
    return F.size(spans).cast("bigint")


def masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with every span replaced by ``mark``; overlapping spans count as one."""
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        lead = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], lead, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        )

    end = F.aggregate(F.array_sort(spans), zero, step)
    tail = F.substring(text, end["at"].cast("int") + 1, 2147483647)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(end["out"], tail))
