"""Repeated passages across documents, found with a log-structured fingerprint index.

Documents arrive in batches.  For each batch:

1. One scan fingerprints every window of ``width`` words and keeps, of each window, its
   smallest inner fingerprint (its *anchor*).  Equal windows have equal anchors, and
   neighbouring windows mostly share theirs, so about one fingerprint in ``width / 3`` words
   has to be stored and nothing is missed.  The scan's result holds texts too, in files that
   are numbered (``part``).
2. The batch's anchors are merge-joined with the immutable runs of history: sorted, bucketed
   tables of postings (anchor, id, part), which are not shuffled again.
3. Only documents of history with a posting of a shared anchor are fetched, from the parts that
   hold them.  They and the batch's documents with a shared anchor are verified: windows are
   compared by two independent 64-bit fingerprints of all their words.
4. The batch's postings become a new run of level 0.  ``fanout`` runs of one level are compacted
   into one of the next, so a posting is rewritten once a level, not once a batch.

The index is a folder: ``manifest`` names the runs and texts that make it up, and a new version
of it is written when a batch is done, so a folder can be opened by a later session and a batch
that broke off leaves the version before it as it was.

Windows of documents with a shared anchor are filtered by a bit table of at most ``2**filter_bits``
bits before they are shuffled.  It errs on one side only and changes no result.

Documents of equal words form a class; only the first of them is compared window by window.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import SMALL_ROWS, Scratch, delete, small_or_not, spread_join
from .words import U, Block, blocks, mix, rolled, runs


def whole_prints(block: Block, hashes: np.ndarray, seed: int) -> np.ndarray:
    """A fingerprint of the word sequence of each text."""
    first = block.first
    place = np.arange(len(hashes)) - np.repeat(first[:-1], block.n_words)
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + place.astype(np.uint64) * U(0x9E3779B97F4A7C15)), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + U(77 + seed)) ^ block.n_words.astype(np.uint64)


def anchors(block: Block, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window, anchor of each window)."""
    k = max(1, width // 3)
    span = width - k + 1
    at = runs(block.first[:-1], np.maximum(block.n_words - (width - 1), 0))
    if not len(at):
        return at, np.zeros(0, np.uint64)
    low = rolled(hashes, k, 60)
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return at, np.minimum(low[at], low[at + span - size])


def scanner(width: int):
    """Arrow batches of (id, text) to (id, text, n_words, doc_a, doc_b, anchors, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, block in blocks(batch.column(1)):
                hashes = block.hashes()
                at, low = anchors(block, hashes, width)
                cut = np.searchsorted(at, block.first)
                own = [np.unique(low[x:y]).view(np.int64) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                flat = np.concatenate(own) if own else np.zeros(0, np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                a, b = whole_prints(block, hashes, 0), whole_prints(block, block.hashes(seed=1), 1)
                made = [pa.array(block.n_words), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(np.full(hi - lo, part, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), *made], ["id", "text", "n_words", "doc_a", "doc_b", "anchors", "part"])

    return run


def verifier(width: int, table, bits: int, fresh: bool):
    """Arrow batches of (id, text) to the windows whose anchor the bit table knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _hi, block in blocks(batch.column(1)):
                hashes = block.hashes()
                at, low = anchors(block, hashes, width)
                bit = low & U((1 << bits) - 1)
                hit = (known[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1
                if not hit.any():
                    continue
                other = block.hashes(seed=1)
                _, a = block.windows(hashes, width)
                _, b = block.windows(other, width, seed=1)
                text = block.text_of_word()[at[hit]]
                tag = whole_prints(block, hashes, 0)[text].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[hit].view(np.int64)), pa.array(b[hit].view(np.int64)), pa.array(ids[lo + text].astype(np.int64)), pa.array(tag.astype(np.int32)), pa.array((at[hit] - block.first[text]).astype(np.int32)), pa.array(np.full(len(text), fresh))], ["a", "b", "id", "tag", "pos", "fresh"])

    return run


def to_spans(width: int):
    """Arrow batches of (id, tag, array of window starts) to merged word ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = [], []
            for starts in batch.column(2):
                p = np.sort(starts.values.to_numpy())
                new = np.flatnonzero(np.concatenate([[True], p[1:] > p[:-1] + width]))
                lo.append(p[new])
                hi.append(p[np.concatenate([new[1:] - 1, [len(p) - 1]])] + width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lo, pa.list_(pa.int32())), pa.array(hi, pa.list_(pa.int32()))], ["id", "tag", "lo", "hi"])

    return run


RUNS = {"postings": ("h long, id long, part int, batch int", ["h"]), "whole": ("doc_a long, doc_b long", ["doc_a", "doc_b"])}


class FingerprintIndex:
    """Runs of postings and texts of earlier batches; ``ingest`` judges a batch and adds it.

    ``FingerprintIndex(spark, path)`` opens the index of a folder, or starts one there; the folder
    must be one that driver and executors share.  Runs have ``buckets`` files, by default as many
    as shuffles have partitions when the index is started, so that joins move the batch alone.
    """

    def __init__(self, spark: SparkSession, path: str, width: int = 50, fanout: int = 3, filter_bits: int = 27, buckets: int | None = None):
        self.spark, self.path, self.scratch = spark, path.rstrip("/"), Scratch(spark, "substring")
        self.width, self.fanout, self.bits = width, fanout, filter_bits
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.runs, self.texts = 0, {"postings": [], "whole": []}, []  # (level, folder); folders
        self.names: dict[str, str] = {}
        self.fetched: DataFrame | None = None  # ids of history read by the last batch
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            told = max((json.loads(r.value) for r in spark.read.text(f"{self.path}/manifest/*").collect()), key=lambda m: m["version"])
            if told["width"] != width:
                raise ValueError(f"the index was made with width {told['width']}")
            self.version, self.texts, self.buckets = told["version"], told["texts"], told["buckets"]
            self.runs = {k: [tuple(x) for x in v] for k, v in told["runs"].items()}

    def _commit(self) -> None:
        self.version += 1
        told = json.dumps({"version": self.version, "width": self.width, "buckets": self.buckets, "runs": self.runs, "texts": self.texts})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{self.version:06d}")

    def _read(self, kind: str, folder: str) -> DataFrame:
        """A run as a bucketed table, known to this session by a name of its own."""
        if folder not in self.names:
            columns, keys = RUNS[kind]
            self.names[folder] = f"docloom_{uuid.uuid4().hex}"
            by = ", ".join(keys)
            self.spark.sql(f"create table {self.names[folder]} ({columns}) using parquet clustered by ({by}) sorted by ({by}) into {self.buckets} buckets location '{folder}'")
        return self.spark.table(self.names[folder])

    def _write(self, kind: str, rows: DataFrame) -> str:
        columns, keys = RUNS[kind]
        folder, name = f"{self.path}/{kind}/{uuid.uuid4().hex[:12]}", f"docloom_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *keys).write.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(name)
        self.names[folder] = name
        return folder

    def _add(self, kind: str, rows: DataFrame) -> list[str]:
        """Adds a run; gives the folders that compaction left without use."""
        kept, old = self.runs[kind], []
        kept.append((0, self._write(kind, rows)))
        while len(same := [x for x in kept if x[0] == kept[-1][0]]) >= self.fanout:
            merged = self._read(kind, same[0][1])
            for _, folder in same[1:]:
                merged = merged.union(self._read(kind, folder))
            full = (same[0][0] + 1, self._write(kind, merged))
            old += [folder for _, folder in same]
            kept[:] = [x for x in kept if x not in same] + [full]
        return old

    def close(self) -> None:
        """Takes the names of runs out of the session; the folder stays."""
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")
        self.names = {}

    def _matching(self, kind: str, keys: DataFrame) -> DataFrame | None:
        """Rows of all runs whose key is among ``keys`` (distinct)."""
        out = None
        for _, folder in self.runs[kind]:
            found = self._read(kind, folder).join(keys.hint("merge"), RUNS[kind][1])
            out = found if out is None else out.union(found)
        return out

    def _bit_table(self, shared: DataFrame, n: int) -> tuple[np.ndarray, int]:
        """(bits, logarithm of their number): sixteen for each anchor, but not more than asked."""
        bits = min(self.bits, max(6, (16 * n).bit_length()))
        at, bit = f"shiftright(h & {(1 << bits) - 1}L, 5)", "shiftleft(1L, cast(h & 31 as int))"
        words = shared.groupBy(F.expr(at).alias("at")).agg(F.expr(f"bit_or({bit})").alias("bits")).toArrow()
        table = np.zeros(1 << (bits - 5), np.uint32)
        table[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
        return table.view(np.uint8), bits

    def _fetch(self, wanted: DataFrame) -> DataFrame:
        """(id, text) of history for written (batch, part, id), from the files that hold them."""
        out = self.spark.createDataFrame([], "id long, text string")
        parts: dict[int, list[int]] = {}
        for r in wanted.select("batch", "part").distinct().toArrow().to_pylist():  # no more than there are files
            parts.setdefault(r["batch"], []).append(r["part"])
        for batch, some in sorted(parts.items()):
            texts = self.spark.read.parquet(self.texts[batch]).where(F.col("part").isin(some)).select("id", "text")
            out = out.union(texts.join(small_or_not(wanted.where(F.col("batch") == batch).select("id").distinct()), "id", "left_semi"))
        return out

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Word ranges to remove of (id, text) rows: (id, tag, lo, hi); tag tells texts of one id apart.

        A window goes when it occurs in an earlier batch, or in this one under a smaller id.
        """
        table, batch = self.scratch.table, len(self.texts)
        folder = f"{self.path}/texts/{uuid.uuid4().hex[:12]}"
        docs.mapInArrow(scanner(self.width), "id long, text string, n_words long, doc_a long, doc_b long, anchors array<long>, part int").write.partitionBy("part").parquet(folder)
        scan = self.spark.read.schema("id long, text string, n_words long, doc_a long, doc_b long, anchors array<long>, part int").parquet(folder)
        prints = ["doc_a", "doc_b"]
        first = scan.groupBy(*prints).agg(F.min("id").alias("first"))
        old = self._matching("whole", first.select(*prints))
        seen = first.withColumn("old", F.lit(False)) if old is None else first.join(old.distinct().withColumn("old", F.lit(True)), prints, "left").fillna(False, ["old"])
        again = table(seen.join(scan.groupBy(*prints).agg(F.count("*").alias("n")), prints).where("old or n > 1").drop("n"), "again")
        # the few classes with copies are looked up; other documents are their own
        judged = scan.select("id", "n_words", *prints, "part").join(small_or_not(again), prints, "left")
        judged = table(judged.select("id", "n_words", *prints, "part", F.coalesce(F.col("old") | (F.col("id") > F.col("first")), F.lit(False)).alias("copy")), "judged")

        long_ = judged.where(f"n_words >= {self.width}")
        entire = long_.where("copy").select("id", F.expr("cast(shiftright(shiftleft(doc_a, 32), 32) as int)").alias("tag"), F.array(F.lit(0)).alias("lo"), F.array(F.col("n_words").cast("int")).alias("hi"))
        # an id is left out of the window scan when all its texts are copies
        copies = small_or_not(table(judged.groupBy("id").agg(F.min("copy").alias("copy")).where("copy").select("id"), "copies"))
        fresh = table(scan.join(copies, "id", "left_anti").select(F.explode("anchors").alias("h"), "id", "part"), "fresh")

        counted = table(fresh.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")), "counted")
        found = self._matching("postings", counted.select("h"))
        found = table(found.select("h", "id", "part", "batch"), "found") if found is not None else None
        shared = counted.where("lo < hi").select("h")
        shared = table(shared.union(found.select("h")).distinct() if found is not None else shared, "shared")
        bits, size = self._bit_table(shared, shared.count())
        bits = self.spark.sparkContext.broadcast(bits)
        schema = "a long, b long, id long, tag int, pos int, fresh boolean"
        touched = table(fresh.join(small_or_not(shared), "h", "left_semi").select("id").distinct(), "touched")
        mine = scan.select("id", "text").join(small_or_not(touched), "id", "left_semi")
        windows = mine.mapInArrow(verifier(self.width, bits, size, True), schema)
        if found is not None:
            self.fetched = table(found.select("id", "part", "batch").distinct(), "fetched")
            windows = windows.union(self._fetch(self.fetched).mapInArrow(verifier(self.width, bits, size, False), schema))
        windows = table(windows, "windows")
        owner = table(windows.groupBy("a", "b").agg(F.min(F.struct("fresh", "id")).alias("owner"), F.count("*").alias("n")).where("n > 1"), "owner")
        hit = spread_join(windows.where("fresh"), owner, ["a", "b"], "n", windows.count()).where("not owner.fresh or owner.id < id")
        spans = hit.groupBy("id", "tag").agg(F.collect_list("pos").alias("pos")).mapInArrow(to_spans(self.width), "id long, tag int, lo array<int>, hi array<int>")
        spans = table(spans, "spans").union(entire)
        self.scratch.free(windows, owner, counted, shared, touched)

        self.texts.append(folder)
        done = self._add("postings", fresh.select("h", "id", "part", F.lit(batch).alias("batch")).distinct())
        done += self._add("whole", judged.where("not copy").select(*prints).distinct())
        self._commit()
        self.scratch.free(fresh)
        for unused in done:
            if unused in self.names:
                self.spark.sql(f"drop table if exists {self.names.pop(unused)}")
            delete(self.spark, unused)
        return spans


def remover(width: int):
    """Arrow batches of (id, text, spans, ...) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            spans = batch.column("spans").to_pylist()
            words, gone, digest, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            for lo, _hi, block in blocks(batch.column("text")):
                tags = None
                for i in range(block.n_texts):
                    x, y = block.first[i], block.first[i + 1]
                    words[lo + i] = y - x
                    start, end = block.start[x:y], block.end[x:y]
                    if spans[lo + i]:
                        if tags is None:
                            tags = whole_prints(block, block.hashes(), 0).view(np.int64).astype(np.int32)
                        keep = np.ones(y - x, bool)
                        for s in spans[lo + i]:
                            if s["tag"] == tags[i]:
                                for p, q in zip(s["lo"], s["hi"], strict=True):
                                    keep[p:q] = False
                        gone[lo + i] = len(keep) - keep.sum()
                        start, end = start[keep], end[keep]
                    text = _joined(block.data, start, end)
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(_runs_of(block.data, start, end, np.flatnonzero(keep)) if gone[lo + i] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words), pa.array(gone), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], [*batch.schema.names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space each."""
    if not len(start):
        return b""
    size = end - start + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    put = runs(np.cumsum(size) - size, size - 1)
    out[put] = data[runs(start, size - 1)]
    return out[:-1].tobytes()


def _runs_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, index: np.ndarray) -> bytes:
    """Kept words with the white space between neighbours; a line break where words went."""
    cut = np.flatnonzero(np.diff(index) > 1)
    lo, hi = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(index) - 1]])
    return b"\n".join(data[start[i] : end[j]].tobytes() for i, j in zip(lo, hi, strict=True)) if len(index) else b""


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, batches: int = 3, fanout: int = 2, filter_bits: int = 27, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, kept_sha256 and kept_text.

    A word goes when a window of ``width`` consecutive words covers it whose words also start
    a window in a document with a smaller id.  Words are ``[^\\x20\\x09-\\x0D]+`` unchanged;
    windows are judged on the input.  ``kept_sha256`` is of the kept words joined by one space;
    ``kept_text`` is null where nothing was removed (the text is as it was), else what is left
    of the text, with its own white space and a line break at each gap.

    Null texts have no words.  Rows with a null id are neither removed from nor compared with.
    Rows that repeat an id are one document: they do not remove words from each other.  Texts
    shorter than a window lose nothing.  Result columns replace input columns of their names.

    The rows are ingested in ``batches`` ranges of ids.  ``path`` keeps the index there and takes
    what it already holds for earlier documents; without it the index goes when the ranges are
    found.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(docs.sparkSession, path or scratch.folder("index"), width, fanout, filter_bits)
    parts = [i / batches for i in range(1, batches)]
    bounds = sorted(set(plain.where("id is not null").approxQuantile("id", parts, 0.01))) if parts else []
    edges = [None, *map(int, bounds), None]
    spans = None
    try:
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = plain.where("id is not null")
            part = part.where(F.col("id") > lo) if lo is not None else part
            part = part.where(F.col("id") <= hi) if hi is not None else part
            found = index.ingest(part)
            spans = found if spans is None else spans.union(found)
        spans = scratch.table(spans.groupBy("id").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("spans")), "ranges")
    finally:
        index.close()
    if path is None:
        delete(docs.sparkSession, index.path)
    size = spans.select(F.sum(1 + F.aggregate("spans", F.lit(0), lambda n, s: n + 1 + F.size(s["lo"])))).first()[0] or 0
    made = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    rest = [c for c in docs.columns if c not in (text_col, *made)]
    base = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    joined = base.join(F.broadcast(spans) if size <= SMALL_ROWS else spans, "id", "left").select("text", "spans", "rest")
    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
    schema = T.StructType([*joined.schema.fields, *more])
    out = joined.mapInArrow(remover(width), schema)
    return out.select(*[F.col(f"rest.`{c}`") for c in rest], *([] if text_col in made else [F.col("text").alias(text_col)]), *made)
