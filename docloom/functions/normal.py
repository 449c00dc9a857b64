"""Text without separators, with a map back to where each character stood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .entities import NARROW, SEPARATORS, WIDE
from .spans import SPAN, hits


def stripped(text: Column) -> Column:
    """(text, at): separators taken out, full-width letters and digits narrowed, and each character's place before.

    Null for null.
    """
    chars = F.filter(F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: (x["c"] != "") & ~F.lit(SEPARATORS).contains(x["c"]))
    kept = F.translate(F.array_join(F.transform(chars, lambda x: x["c"]), ""), WIDE, NARROW)
    return F.when(text.isNotNull(), F.struct(kept.alias("text"), F.transform(chars, lambda x: x["i"]).alias("at")))


def hits_within(normal: Column, text: Column, pattern: str) -> Column:
    """Hits of a pattern in the ``stripped`` text, as spans (start, end, text) of the text itself."""

    def back(h: Column) -> Column:
        start, end = F.get(normal["at"], h["start"]), F.get(normal["at"], h["end"] - 1) + 1
        return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("text"))

    return F.transform(hits(normal["text"], pattern), back).cast(SPAN)
