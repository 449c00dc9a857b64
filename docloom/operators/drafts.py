"""Office drafts: tracked changes, numbering, upload formats, and windows of long texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .govern import format_of

#: Numbers up to ten as documents have them, one form for those beyond, and formats that are turned away.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")
BEYOND = "xi"
LEGACY = ("doc", "xls", "ppt", "wps", "odt", "ods", "odp", "msg")


def accept_changes(xml: Column) -> Column:
    """A document part with its tracked changes accepted: deletions go, insertions stay without their mark.

    A deletion that is never closed stays as it is.
    """
    kept = F.regexp_replace(xml, r"(?s)<w:del(?=[\s/>])(?:[^>]*/>|[^>]*>.*?</w:del>)", "")
    return F.regexp_replace(kept, r"<w:ins(?=[\s/>])[^>]*+>|</w:ins>", "")


def legal_number(depth: Column, n: Column) -> Column:
    """The number of a clause (from 1) by depth: 1.  1.1  (a)  (i)  (A)."""
    letter = lambda first: F.char(F.lit(first) + (n - 1) % 26)
    roman = F.coalesce(F.get(F.array(*map(F.lit, ROMAN)), (n - 1).cast("int")), F.lit(BEYOND))
    text = lambda c: c.cast("string")
    plain = F.when(depth == 0, F.concat(text(n), F.lit(". "))).when(depth == 1, F.concat(text(F.floor(n / 10) + 1), F.lit("."), text(n), F.lit("  ")))
    inner = F.when(depth == 2, letter(97)).when(depth == 3, roman).otherwise(letter(65))
    return F.coalesce(plain, F.concat(F.lit("("), inner, F.lit(")  ")))


def upload_format(name: Column) -> Column:
    """(format, refused): the format by extension, or why there is none."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    known = format_of(name)
    why = F.when(ext == "", "no extension").when(ext.isin(*LEGACY), F.concat(F.lit("."), ext, F.lit(" is a legacy or unsupported format; save it as docx, xlsx or pptx"))).otherwise(F.concat(F.lit("."), ext, F.lit(" is not read")))
    return F.struct(known.alias("format"), F.when(known.isNull(), why).alias("refused"))


def windows(text: Column, most: int, overlap: int) -> Column:
    """Windows (start, end) of at most ``most`` characters by halving, each reaching ``overlap`` to its left.

    Pieces of a halving differ by one character at most, so one number of halvings does for all but
    pieces that are short enough one halving earlier; those are not cut again.
    """
    n = F.length(text)
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def halved(spans: Column) -> Column:
        def cut(s: Column) -> Column:
            middle = (s["start"] + F.floor((s["end"] - s["start"]) / 2)).cast("int")
            return F.when(s["end"] - s["start"] <= most, F.array(s)).otherwise(F.array(F.struct(s["start"].alias("start"), middle.alias("end")), F.struct(middle.alias("start"), s["end"].alias("end"))))

        return F.flatten(F.transform(spans, cut))

    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(n, F.lit(1)) / most)).cast("int") + 1))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))).cast("array<struct<start:int,end:int>>")
    made = F.aggregate(rounds, whole, lambda acc, _: halved(acc).cast("array<struct<start:int,end:int>>"))
    return F.when(n > 0, F.transform(made, lambda s: F.struct(F.greatest(s["start"] - overlap, F.lit(0)).alias("start"), s["end"].alias("end")))).otherwise(empty)


def united(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): spans of equal keys that overlap, put together.

    ``keys`` are the text and the entity.  Spans that only touch stay apart.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    behind = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") < behind, 0).otherwise(1)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_new", new).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def by_windows(docs: DataFrame, id_col: str, text_col: str, most: int, overlap: int, find) -> DataFrame:
    """(id, entity, start, end) of ``find(windows, "content")`` run on windows of each text.

    ``find`` adds ``matches`` to a table of windows, as ``detect`` does.  Near the edge of a window
    it lacks the text beside it, so a match counts where both sides of its start have half the
    ``overlap``; what several windows find is put together.  An identifier longer than that may be cut.
    """
    half = overlap // 2
    cut = docs.select(id_col, F.col(text_col).alias("_text"), F.explode(windows(F.col(text_col), most, overlap)).alias("w"))
    last = F.col("w.end") == F.length("_text")
    rows = cut.select(
        id_col, F.col("w.start").alias("_from"), F.when(F.col("w.start") > 0, half).otherwise(0).alias("_least"), F.when(~last, F.col("w.end") - F.col("w.start") - half).alias("_most"),
        F.substring(F.col("_text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("content"),
    )
    each = find(rows, "content").select(id_col, "_from", "_least", "_most", F.explode_outer("matches").alias("m")).where("m is not null")
    each = each.where((F.col("m.start") >= F.col("_least")) & (F.col("_most").isNull() | (F.col("m.start") < F.col("_most"))))
    return united(each.select(id_col, F.col("m.entity").alias("entity"), (F.col("_from") + F.col("m.start")).alias("start"), (F.col("_from") + F.col("m.end")).alias("end")), [id_col, "entity"])
