"""Spans of regular expressions, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,match:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


#: Items that one inner pass of :func:`scan` appends to its array.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], result: str) -> Column:
    """What ``step`` gives for each item in turn: it takes state and item and returns the next state and an array.

    ``result`` is the type of the arrays. Results are gathered by chunks, so
    that the work for n items grows with n and not with its square.
    """
    ends = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    chunks = F.transform(ends, lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))
    nothing, none = F.array().cast(result), F.array().cast(f"array<{result}>")

    def one(acc: Column, item: Column) -> Column:
        state, found = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["found"], found).alias("found"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), nothing.alias("found")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["parts"], F.array(r["found"])).alias("parts")))

    all_ = F.aggregate(chunks, F.struct(start.alias("state"), none.alias("parts")), chunk)["parts"]
    return F.when(F.size(items) > 0, F.flatten(all_)).otherwise(nothing)


def matches(text: Column, pattern: str, kind: int, maybe: Column | None = None) -> Column:
    """Leftmost non-overlapping matches with their places in code points.

    The text between matches and the matches themselves alternate, so their
    lengths add up to the places. ``maybe`` is a cheap condition without
    which there is no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("match"))

    def place(at: Column, pair: Column) -> tuple[Column, Column]:
        begin = at + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        return end, F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["match"].alias("match")))

    seen = F.regexp_like(text, F.lit(pattern))
    return F.when(seen if maybe is None else maybe & seen, let(pairs, lambda p: scan(p, F.lit(0), place, SPAN))).otherwise(no_spans())


def valid(spans: Column, test: Callable[[Column], Column]) -> Column:
    """The spans whose matched text passes ``test``."""
    return F.filter(spans, lambda s: test(s["match"]))


def listing(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def beside(spans: Column, base: Column) -> Column:
    """Each of ``spans`` with the furthest reaching span of ``base`` that begins before its end: start, end, match, near.

    They overlap if ``near`` ends after the start. Both are gone through in
    one order, base spans by their starts, the others by their ends.
    """
    plain = "struct<start:int,kind:int,end:int,match:string>"
    event = lambda key, own, s: F.struct(key.alias("key"), F.lit(own).alias("own"), s.cast(plain).alias("span"))
    events = F.sort_array(F.concat(F.transform(spans, lambda s: event(s["end"], 0, s)), F.transform(base, lambda s: event(s["start"], 1, s))))

    def meet(near: Column, e: Column) -> tuple[Column, Column]:
        span = e["span"]
        further = (e["own"] == 1) & (near["end"].isNull() | (span["end"] > near["end"]))
        row = F.struct(span["start"].alias("start"), span["end"].alias("end"), span["match"].alias("match"), near.alias("near"))
        return F.when(further, span).otherwise(near), F.when(e["own"] == 0, F.array(row)).otherwise(F.array().cast(f"array<{result}>"))

    result = f"struct<start:int,end:int,match:string,near:{plain}>"
    return let(events, lambda all_: scan(all_, F.lit(None).cast(plain), meet, f"array<{result}>"))


def apart(spans: Column, base: Column, kind: int) -> Column:
    """The spans that no base span overlaps."""
    free = F.filter(beside(spans, base), lambda s: s["near"]["end"].isNull() | (s["near"]["end"] <= s["start"]))
    return F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["match"].alias("match")))


def masked(text: Column, spans: Column, kinds: tuple[str, ...]) -> Column:
    """The text with each span, or run of overlapping ones, replaced by <kind>.

    Spans are taken by chunks, each with its part of the text, since cutting
    from a long text costs its length.
    """
    names = F.array(*[F.lit(k) for k in kinds])
    ordered = F.sort_array(spans)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / CHUNK).cast("int")), lambda k: F.slice(ordered, k * CHUNK + 1, F.lit(CHUNK)))
    none = F.array().cast("array<string>")

    def chunk(acc: Column, part: Column) -> Column:
        base, end = acc["at"], F.array_max(F.transform(part, lambda s: s["end"]))
        piece = F.substring(text, base + 1, F.greatest(end - base, F.lit(0)))

        def replace(own: Column) -> Column:
            def add(state: Column, s: Column) -> Column:
                new = F.array(F.substring(own, state["at"] - base + 1, s["start"] - state["at"]), F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">")))
                return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["parts"], new)).otherwise(state["parts"]).alias("parts"))

            return F.aggregate(part, F.struct(base.alias("at"), none.alias("parts")), add)

        return let(let(piece, replace), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(r["parts"], ""))).alias("parts")))

    def whole(end: Column) -> Column:
        return F.concat(F.array_join(end["parts"], ""), F.substring(text, end["at"] + 1, F.length(text)))

    changed = let(F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("parts")), chunk), whole)
    return F.when(F.size(spans) > 0, changed).otherwise(text)
