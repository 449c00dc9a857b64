"""WARC archives: a writer over Spark's text sink and a salvaging reader.

A WARC record ends with two line breaks, so records are the "lines" of a text sink whose
separator is CR LF CR LF: files are written by Spark's own commit protocol to any store.

The reader takes whole files (plain, or with one or more records to a gzip member).  At each
place it expects a gzip member or a version line.  When a check fails there (member, header,
length, end mark, digest) it searches for the next place where a whole record passes and
goes on; the bytes between are reported as a gap with the reason of the first failure.  It
searches the bytes inside a member alike, as far as they can be decompressed; such records
and gaps lie at the member's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import SMALL_ROWS, Scratch, spread_join

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
END = b"\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OUT = "file string, start long, end long, gap string, record_type string, record_id string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary"


class Broken(ValueError):
    """A check failed at the place where a record was expected."""


@dataclass
class Record:
    """A record, or a gap when ``gap`` gives a reason."""

    start: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_bytes: int = 0
    gap: str | None = None


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _plain(data: bytes, at: int) -> Record:
    m = VERSION.match(data, at)
    if not m:
        raise Broken("version")
    stop = data.find(END, m.end())
    if stop < 0:
        raise Broken("header")
    head = _fields(data[m.end() : stop])
    length = head.get("content-length", "")
    if not length.isdigit():
        raise Broken("length")
    first, last = stop + 4, stop + 4 + int(length)
    if last + 4 > len(data):
        raise Broken("truncated")
    if data[last : last + 4] != END:
        raise Broken("end mark")
    block = data[first:last]
    digest = head.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1(block):
        raise Broken("block digest")
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(END)
        size = len(payload)
        if head.get("warc-type") == "revisit":
            given = _fields(http.partition(b"\r\n")[2]).get("content-length", "")
            size = int(given) if given.isdigit() else 0
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") != "revisit" and digest.startswith("sha1:") and digest[5:] != sha1(payload):
        raise Broken("payload digest")
    return Record(at, last + 4, head, payload, size)


def _inflated(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, str | None]:
    """(bytes of the gzip member, its end, None), or what came out before a failure, 0 and its reason."""
    box, view, out, pos = zlib.decompressobj(31), memoryview(data), [], at
    while pos < len(data) and not box.eof:
        before = box.copy()
        try:
            out.append(box.decompress(view[pos : pos + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), 0, "gzip"
            box, step = before, max(1, step // 8)  # in ever smaller steps to the damage
            continue
        pos += len(view[pos : pos + step])
    if not box.eof:
        return b"".join(out), 0, "truncated"
    return b"".join(out), pos - len(box.unused_data), None


def _used(data: bytes, at: int, good: int, step: int = 1 << 12) -> int:
    """Where the bytes end that give the first ``good`` bytes of the member at ``at``."""
    box, view, pos, out = zlib.decompressobj(31), memoryview(data), at, 0
    while out < good:
        out += len(box.decompress(view[pos : pos + step], good - out))
        pos += len(view[pos : pos + step]) - len(box.unconsumed_tail)
    return min(pos, len(data) - 1)


def _member(data: bytes, at: int) -> tuple[list[Record], int, str | None]:
    """(records and gaps of one gzip member, where reading goes on, why the stream broke off).

    Records that pass are kept wherever a version line starts one, also of a stream that broke
    off; where its bytes may be wrong (not only cut short), a record needs a digest to pass.
    All lie at the member's bytes as far as they were of use.
    """
    inner, end, broken = _inflated(data, at)
    found, pos, bad, reason, good, first = [], 0, None, "", 0, ""
    while pos < len(inner):
        try:
            got = _plain(inner, pos)
            if broken == "gzip" and not any(got.headers.get(f"warc-{x}-digest", "").startswith("sha1:") for x in ("block", "payload")):
                raise Broken("gzip")
        except Broken as e:
            if bad is None:
                bad, reason = pos, str(e)
                first = first or reason
            nxt = VERSION.search(inner, pos + 1)
            pos = nxt.start() if nxt else len(inner)
            continue
        if bad is not None:
            found.append(Record(at, at, gap=reason))
            bad = None
        found.append(got)
        pos = good = got.end
    if not good:
        raise Broken(broken or first or "empty member")
    if bad is not None and not broken:
        found.append(Record(at, at, gap=reason))
    if broken:
        end = _used(data, at, good)
    return [Record(at, end, r.headers, r.payload, r.payload_bytes, r.gap) for r in found], end, broken


def salvage(data: bytes) -> Iterator[Record]:
    """Records and gaps of a file, in order; together they cover every byte."""
    pos, bad, reason = 0, None, ""
    while pos < len(data):
        try:
            if data[pos : pos + 2] == b"\x1f\x8b":
                got, after, broken = _member(data, pos)
            else:
                got, broken = [_plain(data, pos)], None
                after = got[0].end
        except Broken as e:
            if bad is None:
                bad, reason = pos, str(e)
            nxt = START.search(data, pos + 1)
            pos = nxt.start() if nxt else len(data)
            continue
        if bad is not None:
            yield Record(bad, pos, gap=reason)
            bad = None
        yield from got
        pos = after
        if broken:
            bad, reason = pos, broken
            nxt = START.search(data, pos)
            pos = nxt.start() if nxt else len(data)
    if bad is not None:
        yield Record(bad, len(data), gap=reason)


def parser(with_payload: bool):
    """Arrow batches of (path, content) to the columns OUT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SCHEMA
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for r in salvage(content.as_py() or b""):
                    h = r.headers
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or (None if r.gap else sha1(r.payload))
                    rows.append((path, r.start, r.end, r.gap, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), None if r.gap else r.payload_bytes, digest, r.payload if with_payload and not r.gap else None))
                    held += len(r.payload) if with_payload else 200
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in rows], schema)

    return run


_SCHEMA = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
    ("target", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and gaps (``gap`` not null) of all archives below a path.

    Empty files have no rows; a file without a valid record is one gap.  A file is read whole
    by one task, so archives should be of some 100 MB at most.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parser(with_payload), OUT)


def base32(hexed: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits."""
    out = []
    for g in range(4):
        v = F.conv(F.substring(hexed, 1 + 10 * g, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(v, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*out)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 0, file_bytes: int = 64 << 20) -> None:
    """One record per row, payload the text in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are
    responses and the others revisit it; rows with a null id revisit whenever there is one
    with an id.  White space and control characters in a url are taken out of its header.
    Files roll at as many records as ``file_bytes`` hold at their measured mean size.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("n"))
    mean, total = base.agg(F.avg("n"), F.count("*")).first()
    per_file = max(1, min(1_000_000, int(file_bytes / ((mean or 0.0) + 500))))
    same = base.where(F.col("n") >= least).groupBy("sha").agg(F.max("id").alias("last"), F.count("*").alias("c")).where("c > 1 and last is not null")
    same = scratch.table(same, "same")
    # beyond a list that all tasks can hold, a payload that very many pages share is still looked up, not shuffled
    known = base.join(F.broadcast(same), "sha", "left") if same.count() <= SMALL_ROWS else spread_join(base, same, ["sha"], "c", total, "left")
    revisit = (F.col("n") >= least) & F.col("last").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("last")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = "\r\n"
    known = known.withColumn("again", F.coalesce(revisit, F.lit(False)))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}Content-Length: "), F.col("n").cast("string"), F.lit(line + line))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("text")))
    size = F.octet_length(http) + F.when(F.col("again"), F.lit(0)).otherwise(F.col("n"))
    record = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit(f"{line}WARC-Record-ID: "), urn(F.col("id")),
        F.lit(f"{line}WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", ""),
        F.lit(f"{line}WARC-Date: 1970-01-01T00:00:00Z{line}WARC-Payload-Digest: sha1:"), base32(F.col("sha")),
        F.when(F.col("again"), F.concat(F.lit(f"{line}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{line}WARC-Refers-To: "), urn(F.col("last")))).otherwise(""),
        F.lit(f"{line}Content-Type: application/http; msgtype=response{line}Content-Length: "), size.cast("string"), F.lit(line + line), block,
    )
    known.select(record.alias("value")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes all pages as archives and reads them back.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to.  Bytes and digest
    are of the full payload, for revisits too.  Damage found on reading is an error here.
    """
    scratch = Scratch(pages.sparkSession, "archive")
    folder = scratch.folder("warc")
    write_archives(pages, folder, least=least)
    back = read_archives(pages.sparkSession, folder, with_payload=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")
    whole = F.when(F.col("gap").isNotNull(), F.raise_error(F.concat(F.lit("archive damaged: "), "gap")).cast("string")).otherwise(F.col("record_type"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", whole.alias("record_type"), number("refers_to").alias("refers_to"))
