"""Pages of findings, guarded memory, revisions, vault entries and listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import ENTITIES
from .detect import detect

MANDATORY = ("00", "01", "02")
MEMORY_BYTES = 64 * 1024
VAULT_VERSION = 1
VAULT = "struct<version:int,entries:map<string,struct<entity:string,original:string>>>"


def rescan_page(chunks: DataFrame, documents: DataFrame, codes: Iterable[str] | None = None, number: int = 0, size: int = 2000, most: int = 5000, after: tuple[int, int] | None = None) -> DataFrame:
    """One row: what a page of open chunks still holds.

    A page is ``size`` chunks in the order of documents and chunk numbers, the ``number``-th from the
    start or from behind the chunk ``after`` (document, chunk), which skips nothing but by a filter;
    ``last_document`` and ``last_chunk`` (with ``after``) name the chunk to go on from.  ``findings`` are
    matches, at most ``most``; ``chunks_offending`` and ``documents_offending`` have at least one;
    ``already_sanitised`` of those documents are in that state.  ``truncated`` tells that chunks
    are left behind the page or matches behind the most.
    """
    order = ["document_id", "chunk_index"]
    if after is not None:
        chunks = chunks.where((F.col("document_id") > after[0]) | ((F.col("document_id") == after[0]) & (F.col("chunk_index") > after[1])))
    ahead = chunks.orderBy(*order).offset(number * size).limit(size + 1)
    ranked = ahead.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # a page and one more
    found = detect(ranked, "content", codes=codes, most=None).withColumn("_k", F.when(F.col("_n") <= size, F.size("matches")).otherwise(0))
    state = documents.select("document_id", F.col("sanitization_state").alias("_state"))
    hits = F.col("_k") > 0
    one = lambda c: F.when(hits & c, F.col("document_id"))
    within = F.when(F.col("_n") <= size, F.struct("document_id", "chunk_index"))
    end = [F.max(within)["document_id"].alias("last_document"), F.max(within)["chunk_index"].alias("last_chunk")] if after is not None else []
    return found.drop("sanitization_state").join(state, "document_id", "left").agg(
        F.count_if(F.col("_n") <= size).alias("chunks_scanned"), F.least(F.coalesce(F.sum("_k"), F.lit(0)), F.lit(most)).alias("findings"), F.count_if(hits).alias("chunks_offending"),
        F.countDistinct(one(F.lit(True))).alias("documents_offending"), F.countDistinct(one(F.col("_state") == "sanitized")).alias("already_sanitised"),
        ((F.count("*") > size) | (F.coalesce(F.sum("_k"), F.lit(0)) > most)).alias("truncated"), *end,
    )


def affected(chunks: DataFrame, documents: DataFrame, codes: Iterable[str] | None = None) -> DataFrame:
    """The documents, once each, of chunks that hold an identifier."""
    bad = detect(chunks, "content", codes=codes, most=None).where(F.size("matches") > 0).select("document_id")
    return documents.join(bad, "document_id", "left_semi")


def guard_memory(rows: DataFrame, text_col: str, codes: Iterable[str] | None = None) -> DataFrame:
    """Adds ``verdict`` (accept, too_large, identifiers), ``found`` and ``first`` (the entity of the first).

    A note of more than 64 KiB is refused before it is looked at.
    """
    large = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) > MEMORY_BYTES
    out = detect(rows.withColumn("_note", F.when(~large, F.coalesce(F.col(text_col), F.lit("")))), "_note", "_hits", codes, most=None)
    found = F.when(large, F.lit(0)).otherwise(F.size("_hits"))
    out = out.withColumn("found", found).withColumn("first", F.when(F.col("found") > 0, F.get("_hits", F.lit(0))["entity"]))
    return out.withColumn("verdict", F.when(large, "too_large").when(F.col("found") > 0, "identifiers").otherwise("accept")).drop("_note", "_hits")


def revise(current: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """(key, outcome, revision) of edits (key, expected) against rows (key, revision).

    ``written`` gives the next revision, ``conflict`` the one that stands; a key without a row is
    ``created`` as 1 unless the edit expected one.  A null ``expected`` asks for no check.  Of
    several edits of a key the one with the smallest ``at`` is judged; the rest conflict.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy("at")) == 1
    rows = edits.withColumn("_first", first).join(current, key, "left")
    fits = F.col("_first") & (F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("revision")))
    outcome = F.when(fits & F.col("revision").isNull(), "created").when(fits, "written").otherwise("conflict")
    stands = F.coalesce(F.col("revision"), F.lit(0))
    return rows.select(key, "at", outcome.alias("outcome"), F.when(outcome == "conflict", stands).otherwise(stands + 1).alias("revision"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of spans, ledger entries, jobs or audit rows."""
    rows.write.mode("append").parquet(path)


def packed_vault(entries: Column) -> Column:
    """A vault entry (token to entity and original) as JSON with its version."""
    return F.to_json(F.struct(F.lit(VAULT_VERSION).alias("version"), entries.alias("entries")))


def opened_vault(raw: Column) -> Column:
    """The entries of a vault's JSON; null for another version, an unknown entity or no JSON."""
    vault = F.from_json(raw, VAULT)
    known = F.forall(F.map_values(vault["entries"]), lambda v: v["entity"].isNotNull() & v["entity"].isin(*ENTITIES) & v["original"].isNotNull())
    return F.when((vault["version"] == VAULT_VERSION) & known, vault["entries"])


def reading_order(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``place`` from 0: by page, then from top to bottom, then from left to right."""
    return spans.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("page", "y", "x")) - 1).cast("long"))


def newest_first(rows: DataFrame, keys: list[str], stamp: str, tie: str) -> DataFrame:
    """Adds ``place`` from 0 in a listing: the newest first, ties by ``tie``."""
    return rows.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(stamp), F.col(tie))) - 1).cast("long"))


def mandatory(directory: Column) -> Column:
    """Whether an archive directory has to be there."""
    return directory.isin(*MANDATORY)


def copies_allowed(count: Column) -> Column:
    """Copies of a document in one call: 1 to 20."""
    return F.coalesce(count.between(1, 20), F.lit(False))


def tagged(chunks: DataFrame, extracted: bool = False) -> DataFrame:
    """Chunks at ingestion: given tags or the path's defaults, always pending.

    Text that was uploaded gets international, model_inference and T2 where nothing is given;
    extracted text is china_mainland, auxiliary_db and T3 whatever is given.
    """
    plain = {"jurisdiction": "international", "source_level": "model_inference", "data_level": "T2"}
    fixed = {"jurisdiction": "china_mainland", "source_level": "auxiliary_db", "data_level": "T3"}
    given = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    tags = {c: F.lit(v) for c, v in fixed.items()} if extracted else {c: F.coalesce(given(c), F.lit(v)) for c, v in plain.items()}
    return chunks.withColumns({**tags, "sanitization_state": F.lit("pending")})


def truncation(truncated: Column, read: Column, dropped: Column) -> Column:
    """What to tell of an answer that was given on a part of a clause; null when all was read."""
    note = F.struct(F.lit(True).alias("partial"), dropped.alias("tokens_dropped"), read.alias("tokens_read"))
    return F.when(F.coalesce(truncated, F.lit(False)), note)


def pressure(total: Column, trigger: Column, window: Column, band: float) -> Column:
    """Percent of the binding limit (the smaller of trigger and window) once ``band`` of it is used."""
    limit = F.least(F.when(trigger > 0, trigger), F.when(window > 0, window))
    return F.when(total >= limit * band, F.floor(total / limit * 100).cast("int"))


def distinct_in_order(values: Column, most: int, longest: int) -> Column:
    """Trimmed values in their order, once each, none empty, each and all of them cut to a length."""
    clean = F.filter(F.transform(values, lambda v: F.substring(F.trim(v), 1, longest)), lambda v: v.isNotNull() & (v != ""))
    return F.slice(F.array_distinct(clean), 1, most)
