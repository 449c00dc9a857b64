"""Registered queries of findings pages, guarded memory, revisions, vaults, hashes and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drafts, evaluate, records
from ..streaming import loops
from .catalog import ORACLES, QUERIES, line_chunks, query
from .scope import scoped, table

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query(
    "rescan_page",
    """
    with c as (select *, row_number() over (order by document_id, chunk_index) as n from ({CHUNKS}) where sanitization_state in ('sanitized', 'never')),
    p as (select *, len(regexp_extract_all(content, 'EMAIL')) as k from c where n > 2000 and n <= 4000)
    select count(*)::bigint as chunks_scanned, least(coalesce(sum(k), 0), 5000)::bigint as findings, count(*) filter (k > 0)::bigint as chunks_offending,
        count(distinct document_id) filter (k > 0)::bigint as documents_offending, count(distinct document_id) filter (k > 0 and sanitization_state = 'sanitized')::bigint as already_sanitised,
        (select count(*) from c) > 4000 or coalesce(sum(k), 0) > 5000 as truncated from p
    """.replace("EMAIL", _EMAIL),
)
def rescan_page(spark, sf_dir):
    """The second page of open chunks."""
    chunks = line_chunks(spark, sf_dir).where("sanitization_state in ('sanitized', 'never')")
    return records.rescan_page(chunks, scoped(spark, sf_dir).select("document_id", "sanitization_state"), codes=["EMAIL"], number=1)


@query(
    "rescan_keyset",
    """
    with c as (select *, row_number() over (order by document_id, chunk_index) as n from ({CHUNKS}) where sanitization_state in ('sanitized', 'never') and (document_id, chunk_index) > (70, 1)),
    p as (select *, len(regexp_extract_all(content, 'EMAIL')) as k from c where n <= 2000)
    select count(*)::bigint as chunks_scanned, least(coalesce(sum(k), 0), 5000)::bigint as findings, count(*) filter (k > 0)::bigint as chunks_offending,
        count(distinct document_id) filter (k > 0)::bigint as documents_offending, count(distinct document_id) filter (k > 0 and sanitization_state = 'sanitized')::bigint as already_sanitised,
        (select count(*) from c) > 2000 or coalesce(sum(k), 0) > 5000 as truncated, arg_max(document_id, n) as last_document, arg_max(chunk_index, n) as last_chunk from p
    """.replace("EMAIL", _EMAIL),
)
def rescan_keyset(spark, sf_dir):
    """The page of open chunks behind chunk 1 of document 70, with the chunk that the next page goes on from."""
    chunks = line_chunks(spark, sf_dir).where("sanitization_state in ('sanitized', 'never')")
    return records.rescan_page(chunks, scoped(spark, sf_dir).select("document_id", "sanitization_state"), codes=["EMAIL"], after=(70, 1))


@query("affected_documents", f"select document_id, tenant_id from ({{SCOPE}}) where document_id in (select document_id from ({{CHUNKS}}) where regexp_matches(content, '{_EMAIL}'))")
def affected_documents(spark, sf_dir):
    return records.affected(line_chunks(spark, sf_dir).select("document_id", "content"), scoped(spark, sf_dir).select("document_id", "tenant_id"), codes=["EMAIL"])


@query(
    "memory_guard",
    f"""
    with n as (select doc_id, case when doc_id % 10 = 0 then repeat(text, 40) else text end as t from documents),
    k as (select doc_id, strlen(coalesce(t, '')) > 65536 as large, len(regexp_extract_all(coalesce(t, ''), '{_EMAIL}')) as k from n)
    select doc_id, case when large then 'too_large' when k > 0 then 'identifiers' else 'accept' end as verdict, (case when large then 0 else k end)::bigint as found, case when not large and k > 0 then 'EMAIL' end as first from k
    """,
)
def memory_guard(spark, sf_dir):
    text = F.when(F.col("doc_id") % 10 == 0, F.repeat("text", 40)).otherwise(F.col("text"))
    rows = records.guard_memory(table(spark, sf_dir, "documents").select("doc_id", text.alias("t")), "t", codes=["EMAIL"])
    return rows.select("doc_id", "verdict", F.col("found").cast("long").alias("found"), "first")


@query(
    "revision_check",
    """
    with c as (select o_orderkey as k, 1 + o_orderkey % 5 as revision from orders where o_orderkey % 4 != 0),
    e as (select o_orderkey as k, turn, case when (o_orderkey + turn) % 3 = 0 then null when (o_orderkey + turn) % 3 = 1 then 1 + o_orderkey % 5 else 99 end as expected from orders, (values (1), (2)) as t(turn)),
    j as (select e.k, turn, expected, revision, turn = 1 and (expected is null or expected is not distinct from revision) as fits from e left join c on e.k = c.k)
    select k, turn::bigint as "at", case when fits and revision is null then 'created' when fits then 'written' else 'conflict' end as outcome, (coalesce(revision, 0) + case when fits then 1 else 0 end)::bigint as revision from j
    """,
)
def revision_check(spark, sf_dir):
    k = F.col("o_orderkey")
    current = table(spark, sf_dir, "orders").where(k % 4 != 0).select(k.alias("k"), (1 + k % 5).alias("revision"))
    edits = table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(F.array(F.lit(1), F.lit(2))).alias("at"))
    turn = (F.col("k") + F.col("at")) % 3
    edits = edits.withColumn("expected", F.when(turn == 0, None).when(turn == 1, 1 + F.col("k") % 5).otherwise(99))
    return records.revise(current, edits, "k").select("k", F.col("at").cast("long").alias("at"), "outcome", F.col("revision").cast("long").alias("revision"))


@query(
    "vault_round_trip",
    """
    select doc_id, '{"version":' || (1 + doc_id % 3) || ',"entries":{"[EMAIL_' || doc_id || ']":{"entity":"' || case when doc_id % 5 = 0 then 'SHOE_SIZE' else 'EMAIL' end || '","original":"' || source || '@x.org"}}}' as raw,
        case when doc_id % 3 = 0 and doc_id % 5 != 0 then source || '@x.org' end as original from documents
    """,
)
def vault_round_trip(spark, sf_dir):
    """Vault entries as JSON and back; other versions and unknown entities are refused."""
    token = F.concat(F.lit("[EMAIL_"), F.col("doc_id").cast("string"), F.lit("]"))
    entry = F.struct(F.when(F.col("doc_id") % 5 == 0, "SHOE_SIZE").otherwise("EMAIL").alias("entity"), F.concat("source", F.lit("@x.org")).alias("original"))
    raw = F.replace(records.packed_vault(F.create_map(token, entry)), F.lit('{"version":1'), F.concat(F.lit('{"version":'), (1 + F.col("doc_id") % 3).cast("string")))
    rows = table(spark, sf_dir, "documents").select("doc_id", token.alias("token"), raw.alias("raw"))
    return rows.select("doc_id", "raw", F.element_at(records.opened_vault(F.col("raw")), F.col("token"))["original"].alias("original"))


@query("reading_order", "select l_orderkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber % 3, l_quantity, l_linenumber) - 1)::bigint as place from lineitem")
def reading_order(spark, sf_dir):
    n = F.col("l_linenumber")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (n % 3).alias("page"), F.col("l_quantity").alias("y"), n.alias("x"))
    return records.reading_order(spans, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "place")


@query("listing_order", "select document_id, (row_number() over (partition by tenant_id order by version desc, document_id) - 1)::bigint as place from ({SCOPE})")
def listing_order(spark, sf_dir):
    return records.newest_first(scoped(spark, sf_dir), ["tenant_id"], "version", "document_id").select("document_id", "place")


@query(
    "ingest_tags",
    """
    select document_id, case when document_id % 2 = 0 then 'international' else 'hong_kong' end as jurisdiction, 'model_inference' as source_level, coalesce(case when document_id % 3 > 0 then data_level end, 'T2') as data_level,
        'pending' as sanitization_state, lpad((document_id % 5)::varchar, 2, '0') in ('00', '01', '02') as mandatory, document_id % 30 between 1 and 20 as copies from ({SCOPE})
    """,
)
def ingest_tags(spark, sf_dir):
    d = F.col("document_id")
    rows = scoped(spark, sf_dir).select("document_id", F.when(d % 2 != 0, "hong_kong").alias("jurisdiction"), F.when(d % 3 > 0, F.col("data_level")).alias("data_level"))
    return records.tagged(rows).withColumns({"mandatory": records.mandatory(F.lpad((d % 5).cast("string"), 2, "0")), "copies": records.copies_allowed(d % 30)})


@query(
    "context_pressure",
    """
    with r as (select o_orderkey, o_orderkey % 40000 as total, case when o_orderkey % 3 > 0 then 36000 end as trigger, case when o_orderkey % 2 = 0 then 30000 end as win from orders),
    l as (select *, least(coalesce(trigger, win), coalesce(win, trigger)) as lim from r)
    select o_orderkey, case when total >= lim * 0.8 then floor(total::double / lim * 100)::int end as percent from l
    """,
)
def context_pressure(spark, sf_dir):
    k = F.col("o_orderkey")
    hint = records.pressure(k % 40000, F.when(k % 3 > 0, 36000), F.when(k % 2 == 0, 30000), 0.8)
    return table(spark, sf_dir, "orders").select("o_orderkey", hint.alias("percent"))


@query(
    "stable_call_hash",
    r"""
    with c as (select event_id, case when event_id % 2 = 0 then 'read_file:' || event_type || ':' || (greatest(least(event_id % 1000, event_id % 700), 1) - 1) // 200 || '-' || (greatest(event_id % 1000, event_id % 700, 1) - 1) // 200
            else 'search:{"path": "' || event_type || '", "query": "a\"b"}' end as a, 'write_file:{"path": "p", "text": "' || user_id || '"}' as b from events)
    select event_id, substring(md5('["' || replace(replace(least(a, b), '\', '\\'), '"', '\"') || '", "' || replace(replace(greatest(a, b), '\', '\\'), '"', '\"') || '"]'), 1, 12) as hash from c
    """.replace(r'"a\"b"', r'"a\"b"'),
)
def stable_call_hash(spark, sf_dir):
    e = F.col("event_id")
    args = F.when(e % 2 == 0, F.create_map(F.lit("path"), F.col("event_type"), F.lit("start_line"), (e % 1000).cast("string"), F.lit("end_line"), (e % 700).cast("string")))
    args = args.otherwise(F.create_map(F.lit("query"), F.lit('a"b'), F.lit("path"), F.col("event_type"), F.lit("noise"), e.cast("string")))
    one = F.struct(F.when(e % 2 == 0, "read_file").otherwise("search").alias("name"), args.alias("args"))
    two = F.struct(F.lit("write_file").alias("name"), F.create_map(F.lit("text"), F.col("user_id").cast("string"), F.lit("path"), F.lit("p")).alias("args"))
    return table(spark, sf_dir, "events").select("event_id", loops.stable_hash(F.array(two, one)).alias("hash"))


@query(
    "eval_binary",
    """
    with r as (select quality as y, n_chars % 97 / 97.0::double as s from labels join documents using (doc_id)),
    a as (select round(sum(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end)::double / count(*), 6) as auc from r p, r n where p.y = 1 and n.y = 0)
    select round(count(*) filter (s >= 0.5 and y = 1)::double / count(*) filter (s >= 0.5), 6) as precision, round(count(*) filter (s >= 0.5 and y = 1)::double / count(*) filter (y = 1), 6) as recall,
        round(2.0 * count(*) filter (s >= 0.5 and y = 1) / (count(*) filter (s >= 0.5) + count(*) filter (y = 1)), 6)::double as f1, max(auc) as auc, max(auc) > 0.55 as passes from r, a
    """,
)
def eval_binary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97 / F.lit(97.0)).alias("s")), "doc_id")
    return evaluate.binary_metrics(rows, "quality", "s")


@query(
    "distinct_in_order",
    """
    with v as (select event_id, [event_type, ' ' || event_type || ' ', user_id::varchar, '', 'a longer value', event_type, 'x'] as v from events),
    c as (select event_id, list_filter(list_transform(v, lambda x: substring(trim(x, ' '), 1, 8)), lambda x: x != '') as c from v)
    select event_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:3], '|') as kept from c
    """,
)
def distinct_in_order(spark, sf_dir):
    e = F.col("event_type")
    values = F.array(e, F.concat(F.lit(" "), e, F.lit(" ")), F.col("user_id").cast("string"), F.lit(""), F.lit("a longer value"), e, F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(records.distinct_in_order(values, 3, 8), "|").alias("kept"))


@query(
    "accepted_changes",
    """
    select doc_id, '<w:p><w:r><w:t>' || source || '</w:t></w:r>' || case when doc_id % 2 = 0 then '<w:r><w:t>new ' || lang || '</w:t></w:r>' else '' end || '</w:p>' as xml from documents
    """,
)
def accepted_changes(spark, sf_dir):
    """Parts with an insertion in every second and a deletion in every one."""
    run = lambda c, tag: F.concat(F.lit(f"<w:r><w:{tag}>"), c, F.lit(f"</w:{tag}></w:r>"))
    added = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<w:ins w:id="1" w:author="a">'), run(F.concat(F.lit("new "), "lang"), "t"), F.lit("</w:ins>"))).otherwise("")
    gone = F.concat(F.lit('<w:del w:id="2">'), run(F.substring("text", 1, 5), "delText"), F.lit('</w:del><w:del w:id="3"/>'))
    xml = F.concat(F.lit("<w:p>"), run(F.col("source"), "t"), gone, added, F.lit("</w:p>"))
    return table(spark, sf_dir, "documents").select("doc_id", drafts.accept_changes(xml).alias("xml"))


@query(
    "legal_numbers",
    """
    with o as (select o_orderkey, o_orderkey % 5 as depth, 1 + o_orderkey % 13 as n from orders)
    select o_orderkey, case depth when 0 then n || '. ' when 1 then (n // 10 + 1) || '.' || n || '  ' when 2 then '(' || chr((96 + n)::int) || ')  '
        when 3 then '(' || coalesce((['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'])[n], 'xi') || ')  ' else '(' || chr((64 + n)::int) || ')  ' end as number from o
    """,
)
def legal_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", drafts.legal_number(k % 5, 1 + k % 13).alias("number"))


@query(
    "upload_formats",
    """
    with n as (select page_id, 'file' || page_id || (['.docx', '.PDF', '.doc', '.zip', '', '.tar.md'])[(page_id % 6 + 1)::int] as name from pages)
    select page_id, (['docx', 'pdf', null, null, null, 'markdown'])[(page_id % 6 + 1)::int] as format,
        ([null, null, '.doc is a legacy or unsupported format; save it as docx, xlsx or pptx', '.zip is not read', 'no extension', null])[(page_id % 6 + 1)::int] as refused from n
    """,
)
def upload_formats(spark, sf_dir):
    p = F.col("page_id")
    name = F.concat(F.lit("file"), p.cast("string"), F.element_at(F.array(*map(F.lit, [".docx", ".PDF", ".doc", ".zip", "", ".tar.md"])), (p % 6 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", drafts.upload_format(name).alias("f")).select("page_id", "f.format", "f.refused")


@query(
    "text_windows",
    """
    with recursive w(doc_id, s, e) as (
        select doc_id, 0::bigint, length(text)::bigint from documents where length(text) > 0
        union all select doc_id, case when half = 0 then s else s + (e - s) // 2 end, case when half = 0 then s + (e - s) // 2 else e end from w, (values (0), (1)) as h(half) where e - s > 600)
    select doc_id, greatest(s - 40, 0)::int as "start", e::int as "end" from w where e - s <= 600
    """,
)
def text_windows(spark, sf_dir):
    spans = drafts.windows(F.col("text"), 600, 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(spans).alias("w")).select("doc_id", "w.start", "w.end")


__all__ = ["ORACLES", "QUERIES"]
