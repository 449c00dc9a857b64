"""Citations: extraction, verification against bodies, and gate outcomes; text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SCHEMA = "array<struct<ref:int,document_id:string,page:int,verbatim:string>>"


def folded(text: Column) -> Column:
    """No white space, full-width marks narrowed, lower case."""
    return F.lower(F.translate(F.regexp_replace(text, r"(?U)\s+", ""), _WIDE, _NARROW))


def extract(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """(turn_id, ref, document_id, page, verbatim) from the list between CITATIONS tags.

    A malformed list gives nothing; an entry without a document uuid is left out.
    """
    body = F.regexp_extract(text_col, r"(?s)<CITATIONS>(.*?)</CITATIONS>", 1)
    rows = turns.select("turn_id", F.explode(F.from_json(body, SCHEMA)).alias("c")).select("turn_id", "c.*")
    return rows.where(F.col("document_id").rlike(UUID))


def verify(citations: DataFrame, bodies: DataFrame) -> DataFrame:
    """Adds ``outcome``: found, not_found or source_unavailable."""
    joined = citations.join(bodies.select("document_id", "body"), "document_id", "left")
    quote = folded(F.coalesce("verbatim", F.lit("")))
    found = (quote != "") & folded(F.col("body")).contains(quote)
    return joined.withColumn("outcome", F.when(F.col("body").isNull(), "source_unavailable").when(found, "found").otherwise("not_found")).drop("body")


def gates(turns: DataFrame, verified: DataFrame) -> DataFrame:
    """Per turn: satisfied when every citation was found (or there is none), else violated."""
    bad = verified.groupBy("turn_id").agg(F.count("*").alias("citations"), F.count_if(F.col("outcome") != "found").alias("unverified"))
    out = turns.select("turn_id").join(bad, "turn_id", "left").na.fill(0, ["citations", "unverified"])
    return out.withColumn("gate", F.when(F.col("unverified") > 0, "violated").otherwise("satisfied"))


def find_lines(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text", most: int = 40) -> DataFrame:
    """(id, line from 1, text) of lines with the needle, case folded; the first ``most`` per document."""
    lines = docs.select(F.col(id_col), F.posexplode(F.split(text_col, "\n")).alias("i", "raw"))
    hit = lines.where(F.lower("raw").contains(needle.lower())).select(id_col, (F.col("i") + 1).alias("line"), F.trim("raw").alias("text"))
    return hit.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("line"))).where(F.col("_n") <= most).drop("_n")


def find_pages(docs: DataFrame, needle: str, id_col: str = "doc_id", text_col: str = "text", page_lines: int = 40, around: int = 100) -> DataFrame:
    """(id, page, start, context): hits of the needle, ASCII case folded, page by page.

    A page is 40 lines; a hit across pages is not found.  The context has up to 100
    characters on both sides within the page.
    """
    import re

    from ..functions.spans import hits

    lines = F.split(text_col, "\n")
    n = F.ceil(F.size(lines) / page_lines).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * page_lines + 1, F.lit(page_lines)), "\n"))
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.posexplode(pages).alias("p", "page_text"))
    rows = rows.select(id_col, (F.col("p") + 1).alias("page"), "page_text", F.explode(hits(F.col("page_text"), f"(?i){re.escape(needle)}")).alias("h"))
    lo = F.greatest(F.col("h.start") - around, F.lit(0))
    return rows.select(id_col, "page", F.col("h.start").alias("start"), F.substring(F.col("page_text"), lo + 1, F.col("h.end") + around - lo).alias("context"))


def cjk_dominant(text: Column, least: float = 0.30) -> Column:
    cjk = F.regexp_count(text, F.lit("[㐀-䶿一-鿿぀-ヿ가-힯豈-﫿]"))
    return F.coalesce(F.try_divide(cjk, F.regexp_count(text, F.lit(r"\p{L}"))), F.lit(0.0)) >= least
