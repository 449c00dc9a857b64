"""Tenant- and matter-scoped state: gates, transitions, roll-ups and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admission(state: Column) -> Column:
    """What may leave for a document in a state."""
    return F.when(state == "sanitized", "redacted").when(state == "never", "original").otherwise("refuse")


def download(state: Column, format_: Column, chunks: Column) -> Column:
    """The body that a download gets."""
    text = format_.isin("txt", "markdown", "html")
    return F.when(state == "never", "original").when(state != "sanitized", "refuse").when(chunks == 0, "conflict").when(text, "redacted_text").otherwise("redacted_attachment")


def scope_mismatch(tenant: Column, matter: Column, want_tenant: Column, want_matter: Column) -> Column:
    """Which scope is not met, the tenant first; null when both are."""
    return F.when(~tenant.eqNullSafe(want_tenant), "tenant").when(want_matter.isNotNull() & ~matter.eqNullSafe(want_matter), "matter")


def format_of(name: Column) -> Column:
    """Document format by extension; legacy office and unknown ones are null."""
    known = {"docx": "docx", "pdf": "pdf", "txt": "txt", "md": "markdown", "markdown": "markdown", "xlsx": "xlsx", "pptx": "pptx", "html": "html", "htm": "html", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "webp": "webp"}
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), ext)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the order; ties have to be ordered by the caller."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def next_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """Both tables with one row per key, the newest; of equal stamps the new table's."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    return latest(both, keys, F.desc(stamp), F.desc("_side")).drop("_side")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Redacted chunks in place of a document's pending and sanitized ones; blocked ones stay."""
    done = new.select("document_id").distinct()
    open_ = F.col("sanitization_state").isin("pending", "sanitized")
    return old.where(~open_).unionByName(old.where(open_).join(done, "document_id", "left_anti")).unionByName(new)


#: (state, event) -> state; every other pair is refused.
TRANSITIONS = {
    ("pending", "pass"): "sanitized", ("pending", "block"): "blocked", ("pending", "hold"): "pending", ("pending", "approve"): "sanitized",
    ("sanitized", "pass"): "sanitized", ("sanitized", "block"): "blocked", ("sanitized", "reset"): "pending", ("blocked", "reopen"): "pending", ("blocked", "block"): "blocked",
}


def next_state(state: Column, event: Column, held: Column, role: Column) -> Column:
    """State after an event, null when refused.

    Reset and approve need the role admin or partner; approve needs a passing ledger row too.
    """
    out = None
    for (s, e), to in TRANSITIONS.items():
        ok = (state == s) & (event == e)
        ok = ok & role.isin("admin", "partner") if e in ("reset", "approve") else ok
        ok = ok & held if e == "approve" else ok
        out = F.when(ok, to) if out is None else out.when(ok, to)
    return out


def held_for_review(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    return docs.where("sanitization_state = 'pending'").join(ledger.where("verdict = 'pass'").select("document_id"), "document_id", "left_semi")


def rollup(chunks: DataFrame) -> DataFrame:
    """Chunks and distinct states per document."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.array_join(F.array_sort(F.collect_set("sanitization_state")), ",").alias("states"))


def histogram(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def body(chunks: DataFrame, sep: str = "", only_open: bool = False) -> DataFrame:
    """A document's chunks in order as one text."""
    rows = chunks.where(F.col("sanitization_state").isin("sanitized", "never")) if only_open else chunks
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["content"]), sep).alias("body"))


def index_state(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per matter: documents, searchable ones and those with pending chunks."""
    states = chunks.groupBy("document_id").agg(F.max(F.col("sanitization_state").isin("sanitized", "never")).alias("open"), F.max(F.col("sanitization_state") == "pending").alias("waits"))
    return docs.join(states, "document_id", "left").groupBy("matter_id").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("open", F.lit(False))).alias("searchable"), F.count_if(F.coalesce("waits", F.lit(False))).alias("pending"))


def page_cap(rows: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """Documents up to and with the one that reaches the cap of pages; failed ones add none."""
    spent = F.sum(F.when(F.col("ok"), F.col("pages")).otherwise(0)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("spent", F.coalesce(spent, F.lit(0)).cast("long")).where(F.col("spent") < cap)


def merge_by_id(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All of the first and what the second adds."""
    return first.unionByName(second.join(first.select(key), key, "left_anti").select(*first.columns))


def workflows(rows: DataFrame, category: str | None = None, text: str | None = None) -> DataFrame:
    out = rows.where(F.col("category") == category) if category else rows
    if text:
        hit = lambda c: F.lower(F.col(c)).contains(text.lower())
        out = out.where(hit("name") | hit("description"))
    return out


def match_scopes(scopes: DataFrame, matters: DataFrame) -> DataFrame:
    """Each scope's first matter by listing order: same id, or external key equal to its channel
    id, or, without a channel id, name equal to its channel name; null means to create one."""
    on = {"id": F.col("scope_matter"), "external_key": F.col("channel_id"), "name": F.when(F.col("channel_id").isNull(), F.col("channel_name"))}
    legs = [scopes.withColumn("_k", k).join(matters.select(F.col(c).alias("_k"), F.col("id").alias("matter_id"), "listing"), "_k").select("scope_id", "matter_id", "listing") for c, k in on.items()]
    hit = legs[0].union(legs[1]).union(legs[2]).groupBy("scope_id").agg(F.min_by("matter_id", "listing").alias("matter_id"))
    return scopes.select("scope_id").join(hit, "scope_id", "left")
