"""Text of uploaded files: plain, HTML and OOXML, with completeness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.govern import format_of
from .packages import Package

#: part prefix -> element names whose text counts, in the order in which they are read
PARTS = {"word/": ("w:t", "w:delText", "w:instrText", "w:delInstrText"), "xl/": ("t",), "ppt/": ("a:t", "a:fld")}
MAIN = {"word/": "word/document.xml", "xl/": "xl/workbook.xml", "ppt/": "ppt/presentation.xml"}
PROPERTIES = ("title", "subject", "creator", "keywords", "description", "lastModifiedBy", "category", "contentStatus", "Company", "Manager")


#: Noncharacters that stand for markup between two passes; where a page has them they count as markup.
_OPEN, _SHUT = "\ufdd0", "\ufdd1"
_RAW = "(?:script|style)"


def html_text(html: Column) -> Column:
    """Visible text: each tag, comment and declaration is one blank; bodies of script and style go.

    Every ``<`` starts markup.  A quoted ``>`` does not end a tag, and markup that is never closed
    runs to the end.  Inside script and style only the markup counts, until a closing tag of either.
    Entities stay as they are.  All loops are possessive, so long pages need no stack, and each
    character is read once by each pass.
    """
    tag = r"""[^'">]*+(?:(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))[^'">]*+)*+(?:>|\z)"""
    any_ = rf"(?is)<(?:!--.*?(?:-->|\z)|![^>]*+(?:>|\z)|(?:(/*{_RAW})(?![\p{{L}}\p{{N}}:\-]))?+{tag})"
    marked = F.regexp_replace(html, any_, f"{_OPEN}$1{_SHUT}")
    body = rf"(?i)^{_RAW}{_SHUT}[^{_OPEN}]*+(?:{_OPEN}(?!/+{_RAW}{_SHUT})[^{_OPEN}]*+)*+"
    parts = F.split(marked, f"(?i){_OPEN}(?={_RAW}{_SHUT})")

    def visible(part: Column, i: Column) -> Column:
        code = F.regexp_replace(F.regexp_extract(part, body, 0), f"[^{_OPEN}]++", "")
        return F.when(i == 0, part).otherwise(F.concat(F.lit(_OPEN), code, F.regexp_replace(part, body, "")))

    return F.regexp_replace(F.array_join(F.transform(parts, visible), ""), f"(?i){_OPEN}(?:(?:/*{_RAW})?{_SHUT})?", " ")


def plain_text(content: Column) -> tuple[Column, Column]:
    """(text, incomplete): bytes that are no UTF-8, or hold a NUL, are incomplete."""
    text = F.decode(F.when(F.is_valid_utf8(content.cast("string")), content), "UTF-8")
    bad = text.isNull() | (F.instr(text, "\0") > 0)
    return F.when(~bad, text), bad


def _decoded(s: str) -> str:
    names = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

    def one(m: re.Match) -> str:
        body = m[1]
        if body[0] != "#":
            return names.get(body, m[0])
        code = int(body[2:], 16) if body[1] in "xX" else int(body[1:])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[a-z]+);", one, s)


def _joined(pieces: list[str]) -> str:
    """Pieces one after the other, a blank between two that would grow into one word."""
    out = ""
    for p in filter(None, pieces):
        seam = out and out[-1].isascii() and out[-1].isalnum() and p[0].isascii() and p[0].isalnum()
        out += (" " if seam else "") + p
    return out


def office_text(data: bytes) -> tuple[str, bool]:
    """(text, incomplete) of a docx, xlsx or pptx, part by part and element by element.

    Whatever is damaged, hidden from the directory or too large once inflated makes the text
    incomplete; metadata too.
    """
    box, pieces = Package(data), []
    used = [p for p in PARTS if any(n.startswith(p) for n in box.names)]
    if not used:
        return "", True
    for prefix in used:
        box.incomplete |= MAIN[prefix] not in box.names
        for name in sorted(n for n in box.names if n.startswith(prefix) and n.endswith(".xml")):
            xml = (box.read(name) or b"").decode("utf-8", "replace")
            for element in PARTS[prefix]:
                for m in re.finditer(rf"<{element}(?:\s[^>]*)?(?<!/)>(.*?)</{element}>", xml, re.S):
                    pieces.append(_decoded(re.sub(r"<[^>]*>", "", m[1])))
    text = _joined(pieces)
    for name in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
        if name in box.names:
            text += _properties((box.read(name) or b"").decode("utf-8", "replace"), name.endswith("custom.xml"))
    return text, box.incomplete or not text.strip()


def _properties(xml: str, custom: bool) -> str:
    if custom:
        found = re.findall(r'<property[^>]*\bname="([^"]*)"[^>]*>\s*<[^>]+>(.*?)</', xml, re.S)
    else:
        found = [(p, v) for p in PROPERTIES for v in re.findall(rf"<(?:\w+:)?{p}(?:\s[^>]*)?>(.*?)</", xml, re.S | re.I)]
    return "".join(f"\n{k}: {_decoded(v)}" for k, v in found if v.strip())


def simple_docx(data: bytes) -> str:
    """The other reader: every tag of the main part taken out, entities left as they are."""
    return re.sub(r"<[^>]*>", "", (Package(data).read("word/document.xml") or b"").decode("utf-8", "replace"))


def _office(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text, bad = office_text(content.as_py() or b"")
            yield pa.RecordBatch.from_pylist([{"path": path, "text": text, "incomplete": bad}], pa.schema([("path", pa.string()), ("text", pa.string()), ("incomplete", pa.bool_())]))


def extract(files: DataFrame) -> DataFrame:
    """(path, format, text, incomplete, error) of rows (path, content).

    Formats without a reader here (pdf and images, which need OCR) and unknown ones have an
    error and no text; nothing incomplete is to be served.
    """
    rows = files.select("path", "content", format_of(F.col("path")).alias("format"))
    text, bad = plain_text(F.col("content"))
    plain = rows.where("format in ('txt', 'markdown')").select("path", "format", text.alias("text"), bad.alias("incomplete"), F.lit(None).cast("string").alias("error"))
    html = rows.where("format = 'html'").select("path", "format", html_text(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"), F.lit(False).alias("incomplete"), F.lit(None).cast("string").alias("error"))
    office = rows.where("format in ('docx', 'xlsx', 'pptx')")
    office = office.select("path", "content").mapInArrow(_office, "path string, text string, incomplete boolean").select("path", format_of(F.col("path")).alias("format"), "text", "incomplete", F.lit(None).cast("string").alias("error"))
    rest = rows.where("format is null or format in ('pdf', 'png', 'jpeg', 'tiff', 'bmp', 'webp')")
    rest = rest.select("path", "format", F.lit(None).cast("string").alias("text"), F.lit(True).alias("incomplete"), F.when(F.col("format").isNull(), "unsupported").otherwise("needs_ocr").alias("error"))
    return plain.unionByName(html).unionByName(office).unionByName(rest)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder as (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def seed_corpus(spark: SparkSession, path: str, names: tuple[str, ...] = ("README.md", "LICENSE.md"), suffixes: tuple[str, ...] = (".lock.md",)) -> DataFrame:
    """Text and markdown files below a folder but for denied names and endings."""
    base = F.element_at(F.split("path", "/"), -1)
    rows = read_files(spark, path).where(F.lower("path").rlike(r"\.(md|txt)$")).where(~base.isin(*names))
    for s in suffixes:
        rows = rows.where(~F.col("path").endswith(s))
    return rows


def boxes(lines: DataFrame) -> DataFrame:
    """Upright boxes of four-point polygons (``box`` array of [x, y])."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    return lines.select("*", F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("width"), (F.array_max(ys) - F.array_min(ys)).alias("height"))


def telemetry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and torn ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def served(content: Column, type_: Column) -> Column:
    """Text as it is for text and JSON content types, else base64."""
    text = F.lower(type_).rlike("^text/|json") & F.is_valid_utf8(content.cast("string"))
    return F.when(text, F.decode(content, "UTF-8")).otherwise(F.regexp_replace(F.base64(content), "[\r\n]", ""))
