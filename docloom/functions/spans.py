"""Spans of regular expressions and identifier matches, as Column expressions.

Positions are code points from 0, half open.  A match is
``struct<start int, end int, entity string, text string, confidence float, source string>``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import NARROW, RULES, SEPARATORS, WIDE, Rule

SPAN = "array<struct<start:int,end:int,text:string>>"
MATCH = "array<struct<start:int,end:int,entity:string,text:string,confidence:float,source:string>>"
APPLIED = "array<struct<start:int,end:int,entity:string,original:string,token:string,source:string>>"
FOUND = f"struct<matches:{MATCH},n:int>"
MOST_MATCHES = 4096


def hits(text: Column, pattern: str) -> Column:
    """Leftmost hits of a pattern with positions.

    The pieces between hits (``split``) and the hits themselves, added up in turn, give the
    positions without leaving the JVM.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["piece"])
        end = start + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text")))).alias("out"))

    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda h, p: F.struct(p.alias("piece"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, empty, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def squeezed(value: Column) -> Column:
    """Separators taken out and full-width characters folded."""
    return F.translate(F.regexp_replace(value, "[" + SEPARATORS.replace("-", r"\-") + "]", ""), WIDE, NARROW)


def longest_first(matches: Column) -> Column:
    """Greedy choice without overlap: longest, then leftmost, then by code; by position."""
    keyed = F.array_sort(F.transform(matches, lambda m, i: F.struct((m["start"] - m["end"]).alias("l"), m["start"].alias("start"), m["entity"].alias("entity"), i.alias("i"), m.alias("m"))))
    ordered = F.transform(keyed, lambda k: k["m"])
    over = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    kept = F.aggregate(ordered, F.array().cast(MATCH), lambda acc, m: F.when(F.exists(acc, lambda k: over(k, m)), acc).otherwise(F.concat(acc, F.array(m))))
    return F.array_sort(kept)


def rules_for(codes: Iterable[str] | None) -> tuple[Rule, ...]:
    return RULES if codes is None else tuple(r for r in RULES if r.code in set(codes))
