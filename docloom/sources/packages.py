"""Office packages: a guarded reader, tracked edits and their acceptance, and a writer.

The per-package work is small and runs in Arrow tasks: one package is one row.  Writing is a
Spark data source (``docx``): tasks write below a hidden folder, and the commit moves what they
wrote into place, so a job that fails leaves nothing behind.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DOCUMENT = "word/document.xml"
MOST_BYTES = 256 << 20  # of a part, inflated
BAD = (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError, ValueError, EOFError, KeyError, zlib.error)


# --- reading


@dataclass
class Package:
    """The parts of a package that can be read, and whether that is all there is.

    ``incomplete`` is set by a file that is no zip, by members that the directory does not list or
    lists twice, by local headers that name another member than the directory does, and by parts
    that are damaged or inflate to more than ``most`` bytes.  None of these raises.
    """

    data: bytes
    most: int = MOST_BYTES
    incomplete: bool = False

    def __post_init__(self):
        self.box, self.names = None, []
        try:
            self.box = zipfile.ZipFile(io.BytesIO(self.data))
            self.names = self.box.namelist()
            self.incomplete |= len(set(self.names)) < len(self.names) or self._hidden()
        except BAD:
            self.incomplete = True

    def _hidden(self) -> bool:
        """Whether a local header stands where the directory lists no member, or says another name."""
        inside = []
        for m in self.box.infolist():
            head = self.data[m.header_offset : m.header_offset + 30]
            if len(head) < 30 or head[:4] != b"PK\x03\x04":
                return True
            name, extra = int.from_bytes(head[26:28], "little"), int.from_bytes(head[28:30], "little")
            if self.data[m.header_offset + 30 : m.header_offset + 30 + name] != m.orig_filename.encode("utf-8" if m.flag_bits & 0x800 else "cp437"):
                return True
            start = m.header_offset + 30 + name + extra
            inside.append((m.header_offset, start + m.compress_size))
        inside.sort()
        if any(b[0] < a[1] for a, b in zip(inside, inside[1:], strict=False)):
            return True
        at = 0
        for lo, hi in [*inside, (self.box.start_dir, len(self.data))]:
            if self.data.find(b"PK\x03\x04", at, lo) >= 0:
                return True
            at = max(at, hi)
        return False

    def read(self, name: str) -> bytes | None:
        """A part, or None where it cannot be read whole."""
        try:
            with self.box.open(name) as part:
                out = part.read(self.most + 1)
                if len(out) <= self.most:
                    return out
        except (*BAD, AttributeError):
            pass
        self.incomplete = True
        return None


# --- tracked edits


def differences(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Runs of ("=", "-" or "+", text) of a shortest edit script between two word lists (Myers)."""
    trail, best, n, m = [], {1: 0}, len(old), len(new)
    for d in range(n + m + 1):
        trail.append(dict(best))
        for k in range(-d, d + 1, 2):
            x = best[k + 1] if k == -d or (k != d and best[k - 1] < best[k + 1]) else best[k - 1] + 1
            while x < n and x - k < m and old[x] == new[x - k]:
                x += 1
            best[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    steps, x, y = [], n, m
    for d in range(len(trail) - 1, -1, -1):
        seen, k = trail[d], x - y
        down = k == -d or (k != d and seen[k - 1] < seen[k + 1])
        px = seen[k + 1] if down else seen[k - 1]
        py = px - (k + 1 if down else k - 1)
        while x > px and y > py and x > 0 and y > 0:
            x, y = x - 1, y - 1
            steps.append(("=", old[x]))
            if x == px + (not down) and y == py + down:
                break
        if d:
            steps.append(("+", new[py]) if down else ("-", old[px]))
            x, y = px, py
    # deletions before insertions in each changed stretch, neighbours of a kind as one run
    out: list[tuple[str, str]] = []
    gone, come = [], []

    def flush() -> None:
        out.extend((k, "".join(v)) for k, v in (("-", gone), ("+", come)) if v)
        gone.clear(), come.clear()

    for kind, word in reversed(steps):
        if kind == "=":
            flush()
            out[-1:] = [("=", out[-1][1] + word)] if out and out[-1][0] == "=" else [*out[-1:], ("=", word)]
        else:
            (gone if kind == "-" else come).append(word)
    flush()
    return out


_TEXT, _RUN = re.compile(r"<w:t(?=[\s/>])[^>]*>"), re.compile(r"<w:r(?=[\s/>])")


def tracked_edit(xml: str, find: str, replace: str, before: str | None = None, after: str | None = None, author: str = "docloom", date: str = "2025-01-01T00:00:00Z") -> tuple[str, str | None]:
    """(xml, why not): the first ``find`` changed to ``replace`` word by word, as tracked changes.

    With both contexts the match must stand between them.  It has to lie in one text node; its run
    is split, so the marks are peers of runs and the run's properties stay on every piece.  Ids go
    on from the largest in the part.  What cannot be done leaves the part as it is.
    """
    wanted = escape(find)
    if not find:
        return xml, "nothing to find"
    context = before is not None and after is not None
    at = xml.find(escape(before) + wanted + escape(after)) if context else xml.find(wanted)
    if at < 0:
        return xml, "not found in this context" if context and wanted in xml else "not found"
    at += len(escape(before)) if context else 0
    end = at + len(wanted)
    opened = [m for m in _TEXT.finditer(xml, 0, at) if not m[0].endswith("/>")]
    close = xml.find("</w:t>", opened[-1].end()) if opened else -1
    if not opened or close < at:
        return xml, "not inside a text node"
    if end > close:
        return xml, "runs over the end of a text node"
    run = [m.start() for m in _RUN.finditer(xml, 0, opened[-1].start())]
    if not run or "</w:r>" in xml[run[-1] : opened[-1].start()]:
        return xml, "text node without a run"
    head = xml[run[-1] : opened[-1].start()]  # the run's tag and properties
    number = max([0, *(int(i) for i in re.findall(r'<w:(?:del|ins)(?=[\s/>])[^>]*?\bw:id="([0-9]+)"', xml))])

    def piece(text: str, tag: str = "w:t") -> str:
        return f'{head}<{tag} xml:space="preserve">{text}</{tag}></w:r>' if text else ""

    marks = []
    words = lambda s: re.findall(r"\s+|\S+", s)
    for kind, text in differences(words(find), words(replace)):
        if kind == "=":
            marks.append(piece(escape(text)))
        else:
            number += 1
            tag, inner = ("w:del", "w:delText") if kind == "-" else ("w:ins", "w:t")
            marks.append(f'<{tag} w:id="{number}" w:author="{escape(author, {chr(34): "&quot;"})}" w:date="{date}">{piece(escape(text), inner)}</{tag}>')
    tail = xml[close + len("</w:t>") :]
    body = piece(xml[opened[-1].end() : at]) + "".join(marks) + piece(xml[end:close])
    rest = re.match(r"\s*</w:r>", tail)
    return xml[: run[-1]] + body + (tail[rest.end() :] if rest else head + tail), None


def accepted(xml: str) -> str:
    """A part with its tracked changes accepted, and text nodes with markup inside made plain text again."""
    xml = re.sub(r"(?s)<w:del(?=[\s/>])(?:[^>]*/>|[^>]*>.*?</w:del>)", "", xml)
    xml = re.sub(r"<w:ins(?=[\s/>])[^>]*>|</w:ins>", "", xml)
    out, at, depth, opened = [], 0, 0, 0
    for m in re.finditer(r"<w:t(?=[\s/>])[^>]*>|</w:t>", xml):
        if m[0].endswith("/>"):
            continue
        if m[0] != "</w:t>":
            if not depth:
                out.append(xml[at : m.end()])
                opened = at = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                out.append(re.sub(r"<[^>]*>", "", xml[opened : m.start()]) + m[0])
                at = m.end()
    return "".join(out) + xml[at:]


def rewritten(data: bytes, change: Callable[[str], str]) -> bytes | None:
    """The package with its main part changed and every other part as it was; None where it is not whole."""
    package = Package(data)
    parts = {n: package.read(n) for n in package.names}
    if package.incomplete or DOCUMENT not in parts:
        return None
    try:
        parts[DOCUMENT] = change(parts[DOCUMENT].decode()).encode()
    except UnicodeDecodeError:
        return None
    return zipped(parts)


def zipped(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, data in parts.items():
            box.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


AT_ONCE = 256  # rows whose edited texts a task holds before it hands them on


def editor(used: list[str]):
    """Arrow batches with (xml, find, replace, context) columns to batches of at most AT_ONCE rows with the edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, AT_ONCE):
                batch, made = whole.slice(lo, AT_ONCE), []
                for x, f, r, *context in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                    made.append(tracked_edit(x, f, r, *context) if None not in (x, f, r) else (x, "null"))
                edited, refused = [m[0] for m in made], [m[1] for m in made]
                plain = [accepted(e) if e is not None else None for e in edited]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.string()) for c in (edited, refused, plain)]], [*batch.schema.names, "edited", "refused", "accepted"])

    return run


def edit_texts(rows: DataFrame, xml: str, find: str, replace: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """``rows`` with ``edited``, ``refused`` and ``accepted`` of parts in a text column; the others name columns too."""
    schema = StructType(list(rows.schema.fields))
    for name in ("edited", "refused", "accepted"):
        schema = schema.add(name, "string")
    return rows.mapInArrow(editor([xml, find, replace, *[c for c in (before, after) if c]]), schema)


# --- writing

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x")


def _number(depth: int, n: int) -> str:
    roman = lambda k: ROMAN[k - 1] if k <= len(ROMAN) else "xi"
    forms = (lambda: f"{n}. ", lambda: f"{n // 10 + 1}.{n}  ", lambda: f"({chr(97 + (n - 1) % 26)})  ", lambda: f"({roman(n)})  ", lambda: f"({chr(65 + (n - 1) % 26)})  ")
    return forms[min(depth, 4)]()


def paragraph(text: str, style: str | None = None, extra: str = "") -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
    return f'<w:p>{f"<w:pPr>{props}</w:pPr>" if props else ""}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'


def section(s: dict) -> str:
    """Markup of one section: heading, paragraph, numbered_list, bullet_list, table, page_break, recital, signature_page."""
    kind = s.get("type")
    if kind == "heading":
        return paragraph(s["text"], f"Heading{min(max(int(s.get('level', 1)), 1), 6)}")
    if kind == "paragraph":
        return paragraph(s["text"])
    if kind == "recital":
        return paragraph(s["text"], "Recital", '<w:ind w:left="720"/>')
    if kind == "numbered_list":
        depth = int(s.get("depth", 0))
        return "".join(paragraph(_number(depth, i) + x, None, f'<w:ind w:left="{360 * (depth + 1)}"/>') for i, x in enumerate(s["items"], 1))
    if kind == "bullet_list":
        return "".join(paragraph(f"• {x}", None, '<w:ind w:left="360"/>') for x in s["items"])
    if kind == "table":
        cell = lambda x: f"<w:tc>{paragraph(x)}</w:tc>"
        row = lambda cells: f"<w:tr>{''.join(map(cell, cells))}</w:tr>"
        return f"<w:tbl><w:tblPr/>{row(s['headers'])}{''.join(map(row, s['rows']))}</w:tbl>"
    if kind == "page_break":
        return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
    if kind == "signature_page":
        lines = [line for p in s["parties"] for line in (p["name"], f"By: {'_' * 30}", f"Name: {p['name']}", f"Role: {p['role']}", *([f"Title: {p['title']}"] if p.get("title") else []), "Date: " + "_" * 20)]
        return '<w:p><w:r><w:br w:type="page"/></w:r></w:p>' + "".join(map(paragraph, lines))
    raise ValueError(f"unknown section {kind!r}")


def build(structure: dict) -> bytes:
    """A docx of {"title", "landscape", "sections"}; sections are as ``section`` takes them."""
    title = structure.get("title") or "Untitled"
    body = (paragraph(title, "Heading1") if title != "Untitled" else "") + "".join(map(section, structure["sections"]))
    page = '<w:pgSz w:w="16838" w:h="11906" w:orient="landscape"/>' if structure.get("landscape") else '<w:pgSz w:w="11906" w:h="16838"/>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:rPr><w:b/></w:rPr></w:style>' for i in range(1, 7)) + '<w:style w:type="paragraph" w:styleId="Recital"><w:name w:val="Recital"/></w:style>'
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/{DOCUMENT}" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/>'
    package = "http://schemas.openxmlformats.org/package/2006"
    rel = lambda what, target: f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{_REL}/{what}" Target="{target}"/></Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types">{types}</Types>', "_rels/.rels": rel("officeDocument", DOCUMENT), "word/_rels/document.xml.rels": rel("styles", "styles.xml"),
        "word/styles.xml": f"<w:styles {_W}>{styles}</w:styles>", DOCUMENT: f"<w:document {_W}><w:body>{body}<w:sectPr>{page}</w:sectPr></w:body></w:document>",
    }
    return zipped({k: (_HEAD + v).encode() for k, v in parts.items()})


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class DocxWriter(DataSourceArrowWriter):
    """Rows (name, structure as JSON) to one file each; all at the commit, or none."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.draft = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    @staticmethod
    def files(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, where = self.files(self.draft)
        mine, names = f"{where}/{TaskContext.get().taskAttemptId()}", []
        store.create_dir(mine, recursive=True)
        for batch in batches:
            for name, structure in zip(batch.column("name").to_pylist(), batch.column("structure").to_pylist(), strict=True):
                if not re.fullmatch(r"[^/\\\x00]+\.docx", name or "") or name in names:
                    raise ValueError(f"{name!r} is no file name, or comes twice")
                with store.open_output_stream(f"{mine}/{name}") as out:
                    out.write(build(json.loads(structure)))
                names.append(name)
        return Written([f"{mine}/{n}" for n in names])

    def commit(self, messages: list[Written | None]) -> None:
        store, where = self.files(self.path)
        drafts = [f for m in messages if m for f in m.names]
        names = [f.rsplit("/", 1)[1] for f in drafts]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        from pyarrow.fs import FileSelector, FileType

        if self.overwrite:
            for f in store.get_file_info(FileSelector(where, allow_not_found=True)):
                if f.type == FileType.File and f.base_name.endswith(".docx") and f.base_name not in names:
                    store.delete_file(f.path)
        for f, name in zip(drafts, names, strict=True):
            store.move(f, f"{where}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, where = self.files(self.draft)
        store.delete_dir_contents(where, missing_dir_ok=True)
        if store.get_file_info(where).type.name == "Directory":
            store.delete_dir(where)


class DocxSource(DataSource):
    """``df.write.format("docx").save(path)`` of rows (name, structure)."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return "name string, structure string"

    def writer(self, schema, overwrite: bool) -> DocxWriter:
        if {"name", "structure"} - set(schema.names):
            raise ValueError("docx takes the columns name and structure")
        return DocxWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocxSource)


def accept_packages(files: DataFrame) -> DataFrame:
    """(path, content) of packages with tracked changes accepted; null content where one is not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = rewritten(data.as_py() or b"", accepted)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([made], pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")
