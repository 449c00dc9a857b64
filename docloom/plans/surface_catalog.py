"""Registered queries of normalised text, windows, sources, precedence unions and filters, all over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import checksums as C
from ..functions.normal import hits_within, stripped
from ..functions.sqlfunctions import register
from ..operators import cite, drafts, evaluate, federate, govern, records, retrieve
from ..operators.detect import detect
from ..sources import extract
from ..sources.markdown import markdown
from .catalog import ORACLES, QUERIES, line_chunks, query
from .rules_sql import _hits
from .scope import SCOPE_SQL, scoped, table

_DOCS = "p as (select doc_id as id, text from documents where text is not null)"
_CARD = "[0-9０-９](?:[ \t－–—　·-]*[0-9０-９]){11,18}"
_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query("mapped_numbers", f"with recursive {_DOCS}, {_hits('h', 'p', _CARD, False)} select id as doc_id, place::int as \"start\", (place + length(hit))::int as \"end\", hit as value from h")
def mapped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 to 19 digits found on the text without separators, at their places in the text."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").rlike(_CARD)).select("doc_id", "text", stripped(F.col("text")).alias("normal"))
    return rows.select("doc_id", F.explode_outer(hits_within(F.col("normal"), F.col("text"), "[0-9]{12,19}")).alias("h")).where("h is not null").select("doc_id", "h.start", "h.end", F.col("h.text").alias("value"))


@query("windowed_emails", f"with recursive {_DOCS}, {_hits('h', 'p', _EMAIL, False)} select id as doc_id, 'EMAIL' as entity, place::int as \"start\", (place + length(hit))::int as \"end\" from h")
def windowed_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses found window by window and put together, which are those of the whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drafts.by_windows(docs, "doc_id", "text", 600, 120, lambda rows, c: detect(rows, c, codes=["EMAIL"], most=None))


@query(
    "credit_codes",
    f"""
    with v as (select c_custkey, '91350100M000' || lpad((c_custkey % 10000)::varchar, 4, '0') || 'Y' || substring('{C.CODE_ALPHABET}', (1 + c_custkey % 31)::int, 1) as code from customer),
    s as (select *, list_sum(list_transform(range(1, 18), lambda i: (instr('{C.CODE_ALPHABET}', substring(code, i, 1)) - 1) * ({list(C.CODE_WEIGHTS)})[i])) % 31 as r from v)
    select c_custkey, code, regexp_matches(code, '^[{C.CODE_AUTHORITIES}][{C.CODE_ALPHABET}][0-9]{{6}}[{C.CODE_ALPHABET}]{{10}}$') as shape, substring(code, 18, 1) = substring('{C.CODE_ALPHABET}', ((31 - r) % 31)::int + 1, 1) as valid from s
    """,
)
def credit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.lit("91350100M000"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("Y"), F.substring(F.lit(C.CODE_ALPHABET), (1 + k % 31).cast("int"), F.lit(1)))
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).select("*", C.credit_code_shape(F.col("code")).alias("shape"), C.credit_code_valid(F.col("code")).alias("valid"))


@query(
    "workflow_precedence",
    """
    with y as (select p_partkey as id, p_name as name, p_type as description, p_brand as category from part where p_partkey % 3 > 0), b as (select p_partkey as id, p_name, 'built in', p_type from part where p_partkey % 2 = 0),
    m as (select * from y union all select * from b where id not in (select id from y))
    select category, count(*)::bigint as n, count(*) filter (contains(lower(name), 're') or contains(lower(description), 're'))::bigint as hits from m group by 1
    """,
)
def workflow_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of workflows, the first before the second, counted by category, and those that a search finds."""
    p = table(spark, sf_dir, "part")
    first = p.where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"))
    second = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("built in").alias("description"), F.col("p_type").alias("category"))
    merged = govern.merge_by_id(first, second)
    found = govern.histogram(govern.workflows(merged, text="re"), "category").withColumnRenamed("n", "hits")
    return govern.histogram(merged, "category").join(found, "category", "left").select("category", "n", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def _bodies(page: str, url: str) -> dict[str, str]:
    """SQL that makes each connector's response, one result of it without a title, from a page's number and url."""
    t, c = f"'\"t' || {page} || '\"'", f"'\"c' || {page} || '\"'"
    u = f"'\"' || {url} || '\"'"
    return {
        "yuandian": f"""'{{"data": [{{"ftmc": ' || {t} || ', "fgmc": ' || {c} || ', "url": ' || {u} || '}}, {{"fgmc": "x"}}]}}'""",
        "pkulaw": f"""'{{"result": {{"content": [{{"title": ' || {t} || ', "citation": ' || {c} || ', "url": ' || {u} || '}}]}}}}'""",
        "qcc": f"""'{{"result": {{"content": [{{"企业名称": ' || {t} || ', "creditCode": ' || {c} || ', "url": ' || {u} || '}}]}}}}'""",
        "fyopen": f"""'{{"data": [{{"title": ' || {t} || ', "citation": ' || {c} || ', "url": ' || {u} || '}}]}}'""",
        "courtlistener": f"""'{{"results": [{{"snippet": "none"}}, {{"caseName": ' || {t} || ', "citation": [{{"cite": ' || {c} || '}}], "absolute_url": ' || {u} || '}}]}}'""",
        "sec_edgar": f"""'{{"hits": {{"hits": [{{"_source": {{"display_names": [' || {t} || '], "adsh": ' || {c} || '}}, "url": ' || {u} || '}}]}}}}'""",
        "gleif": f"""'{{"data": [{{"id": ' || {c} || ', "attributes": {{"entity": {{"legalName": {{"name": ' || {t} || '}}, "legalAddress": {{"country": "united_states"}}}}}}, "url": ' || {u} || '}}]}}'""",
        "firecrawl": f"""'{{"success": true, "data": [{{"title": ' || {t} || ', "url": ' || {u} || '}}]}}'""",
        "vaquill": f"""'{{"results": [{{"title": ' || {t} || ', "id": ' || {c} || ', "link": ' || {u} || '}}]}}'""",
        "eur_lex": f"""'{{"results": {{"bindings": [{{"title": {{"value": ' || {t} || '}}, "celex": {{"value": ' || {c} || '}}, "url": ' || {u} || '}}]}}}}'""",
        "opencorporates": f"""'{{"results": {{"companies": [{{"company": {{"name": ' || {t} || ', "company_number": ' || {c} || ', "jurisdiction_code": "gb"}}, "url": ' || {u} || '}}]}}}}'""",
    }


_PLACE = "case when source_name in ('yuandian', 'pkulaw', 'qcc', 'fyopen') then 'china_mainland' when source_name in ('courtlistener', 'sec_edgar', 'gleif', 'vaquill') then 'united_states' when source_name = 'eur_lex' then 'european_union' when source_name = 'opencorporates' then 'gb' else 'asked' end"
_NAMES = list(federate.CONNECTORS)


@query(
    "connector_results",
    f"""
    with s as (select unnest({_NAMES}) as source_name, unnest(range({len(_NAMES)})) as o),
    r as (select page_id, source_name, o, case when source_name = 'eur_lex' then 0 else 1 end as level from pages, s where (page_id + o) % 5 != 0)
    select source_name, 't' || page_id as title, case when source_name != 'firecrawl' then 'c' || page_id end as citation, 'u' || page_id as url, {_PLACE} as jurisdiction,
        (row_number() over (partition by page_id order by level, o) - 1)::bigint as place from r
    """,
)
def connector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of every connector made for each page (a fifth are no JSON), mapped, united and ranked by page."""
    pages = table(spark, sf_dir, "pages").select("page_id")
    parts = []
    for i, (name, sql) in enumerate(_bodies("page_id", "concat('u', page_id)").items()):
        raw = pages.select(F.expr(f"case when (page_id + {i}) % 5 != 0 then {sql} else 'no json' end").alias("body"))
        parts.append(federate.parsed(raw, name, asked="asked").withColumn("source_order", F.lit(_NAMES.index(name))))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.withColumn("level_rank", federate.level_rank(F.col("source_level")))
    order = Window.partitionBy("title").orderBy("level_rank", "source_order", "pos")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select("source_name", "title", "citation", "url", "jurisdiction", "place")


@query(
    "gate_filters",
    """
    with d as (select *, (['china_mainland', 'hong_kong', 'international'])[(document_id % 3 + 1)::int] as jurisdiction, (['authority_verified', 'auxiliary_db'])[(document_id % 2 + 1)::int] as source_level from ({SCOPE})),
    c(asked, top) as (values (' t2 ', 'T2'), ('T4', 'T4'), (null, 'T3'))
    select coalesce(asked, 'default') as asked, document_id from d, c where sanitization_state in ('sanitized', 'never') and tenant_id = 1 and data_level <= top and jurisdiction = 'hong_kong' and source_level = 'auxiliary_db'
    """,
)
def gate_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a jurisdiction, a source level and ceilings as users write them."""
    d = F.col("document_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (d % n + 1).cast("int"))
    rows = scoped(spark, sf_dir).withColumns({"jurisdiction": pick(("china_mainland", "hong_kong", "international"), 3), "source_level": pick(("authority_verified", "auxiliary_db"), 2)})
    each = [retrieve.gated(rows, 1, top=top, jurisdiction="hong_kong", source_level="auxiliary_db").select(F.lit(top or "default").alias("asked"), "document_id") for top in (" t2 ", "T4", None)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    "citations_in_turns",
    """
    with t as (select conv_id, turn, text, conv_id * 100 + turn as turn_id from conversations)
    select turn_id, (turn % 7)::int as ref, '00000000-0000-0000-0000-' || lpad(conv_id::varchar, 12, '0') as document_id, 2 as page, role as verbatim from (select t.*, c.role from t join conversations c using (conv_id, turn)) where turn % 3 != 2
    """,
)
def citations_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations taken out of turns; every third turn has a broken list, and each list an entry without a document."""
    t = table(spark, sf_dir, "conversations")
    entry = F.format_string('{"ref": %d, "document_id": "00000000-0000-0000-0000-%012d", "page": 2, "verbatim": "%s"}, {"ref": 9, "document_id": "none"}', F.col("turn") % 7, F.col("conv_id"), F.col("role"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" <CITATIONS>["), entry, F.when(F.col("turn") % 3 == 2, ", {").otherwise("]"), F.lit("</CITATIONS> more"))
    return cite.extract(t.select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), text.alias("text")))


@query(
    "plain_extracts",
    """
    select doc_id, doc_id % 3 > 0 or text is null as incomplete, case when doc_id % 3 = 0 then md5(text) end as md5, md5(case doc_id % 3 when 1 then base64(encode(text) || from_hex('FF')) when 2 then text || chr(0) else text end) as served from documents
    """,
)
def plain_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the text, the text with a byte that is no UTF-8, and with a NUL: what is read and how it is served."""
    more = F.when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FF"))).when(F.col("doc_id") % 3 == 2, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.encode("text", "UTF-8"), more).alias("content"))
    text, bad = extract.plain_text(F.col("content"))
    out = extract.served(F.col("content"), F.lit("text/plain"))
    return rows.select("doc_id", F.coalesce(bad, F.lit(True)).alias("incomplete"), F.md5(text).alias("md5"), F.md5(out).alias("served"))


@query(
    "truncation_notes",
    "select l_orderkey, l_linenumber, case when l_linenumber % 3 = 0 then l_partkey end as dropped, case when l_linenumber % 3 = 0 then l_suppkey end as read from lineitem",
)
def truncation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = records.truncation(F.col("l_linenumber") % 3 == 0, F.col("l_suppkey"), F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", note.alias("n")).select("l_orderkey", "l_linenumber", F.col("n.tokens_dropped").alias("dropped"), F.col("n.tokens_read").alias("read"))


@query("upright_boxes", "select l_orderkey, l_linenumber, least(l_partkey, l_suppkey) as x, l_linenumber as y, abs(l_partkey - l_suppkey) as width, 5::bigint as height from lineitem")
def upright_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, n = F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long"), F.col("l_linenumber").cast("long")
    box = F.array(F.array(p, n), F.array(s, n), F.array(s, n + 5), F.array(p, n + 5))
    return extract.boxes(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))).select("l_orderkey", "l_linenumber", "x", F.col("y").cast(dict(table(spark, sf_dir, "lineitem").dtypes)["l_linenumber"]).alias("y"), "width", "height")


@query(
    "registry_filters",
    "select s_suppkey from supplier where s_nationkey % 3 = 1 and s_suppkey % 2 = 0 and not (s_suppkey % 4 = 0) and s_suppkey % 5 != 0",
)
def registry_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a region that are not built yet and need credentials."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("region"), (k % 2).alias("priority"), (k % 4 == 0).alias("implemented"), F.when(k % 5 == 0, "free").otherwise("key").alias("auth"))
    return federate.registry(rows, region=1, priority=0, needs_credentials=True).select("s_suppkey")


@query(
    "eval_auc_ranges",
    """
    with r as (select row_number() over () as i, quality as y, ((doc_id * 7919) % 100003 + n_chars * 0.001)::double as s from labels join documents using (doc_id))
    select count(distinct p.i)::bigint as positives, count(distinct n.i)::bigint as negatives, round(sum(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end)::double / count(*), 6) as auc from r p, r n where p.y = 1 and n.y = 0
    """,
)
def eval_auc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of a score with almost as many values as rows."""
    score = (F.col("doc_id") * 7919 % 100003 + F.col("n_chars") * F.lit(0.001)).cast("double")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", score.alias("s")), "doc_id")
    return evaluate.auc(rows, "quality", "s")


@query(
    "chunk_join",
    "select c.document_id, chunk_index, name, version, length(content)::int as chars from ({CHUNKS}) c join ({SCOPE}) d on d.document_id = c.document_id where c.sanitization_state in ('sanitized', 'never') and c.tenant_id = 2 and c.data_level <= 'T3'",
)
def chunk_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open chunks with the name and version of their documents."""
    docs = scoped(spark, sf_dir).select("document_id", "name", "version")
    return retrieve.gated(line_chunks(spark, sf_dir), 2).join(docs, "document_id").select("document_id", "chunk_index", "name", "version", F.length("content").alias("chars"))


@query(
    "pages_markdown",
    r"""
    with t as (select page_id, coalesce(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') as t, html from pages),
    d as (select *, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as plain from t)
    select page_id, '# ' || trim(regexp_replace(regexp_replace(plain, '([\\*_\[\]`])', '\\\1', 'g'), '[ \t\n\r\f]+', ' ', 'g')) as heading, len(regexp_extract_all(html, '<li><a href='))::int as links from d
    """,
)
def pages_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading and the number of linked list items of every page's Markdown."""
    rows = markdown(table(spark, sf_dir, "pages"), "page_id", "html")
    heading = F.regexp_extract("markdown", r"(?m)^# .*$", 0)
    return rows.select("page_id", heading.alias("heading"), F.size(F.regexp_extract_all("markdown", F.lit(r"(?m)^- \[.*?\]\("), F.lit(0))).alias("links"))


@query(
    "sql_functions",
    """
    with t as (select document_id, sanitization_state, translate(substring(text, 1, 30), 'eta', '的一是') as s from ({SCOPE})),
    k as (select *, list_filter(regexp_split_to_array(regexp_replace(lower(s), '([一-鿿])', ' \\1 ', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x != '') as t from t)
    select document_id, array_to_string(t, ' <-> ') as phrase, len(t)::int as tokens, case sanitization_state when 'sanitized' then 'redacted' when 'never' then 'original' else 'refuse' end as egress from k
    """,
)
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered functions used from SQL over the documents."""
    register(spark)
    rows = scoped(spark, sf_dir).select("document_id", "sanitization_state", F.translate(F.substring("text", 1, 30), "eta", "的一是").alias("s"))
    return spark.sql("select document_id, cjk_tsquery(s) as phrase, size(cjk_tokens(s)) as tokens, egress_admission(sanitization_state) as egress from {rows}", rows=rows)


@query(
    "sql_identifiers",
    f"with recursive {_DOCS}, {_hits('h', 'p', _EMAIL, False)} select id as doc_id, place::int as \"start\", hit as value from h",
)
def sql_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of all documents through the table function."""
    register(spark)
    return spark.sql("select doc_id, m.start, m.value from {docs} as d, lateral identifiers(text) as m where m.entity = 'EMAIL'", docs=table(spark, sf_dir, "documents"))


_BARE = lambda x: f"regexp_replace({x}, '^[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+|[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+$', '', 'g')"

#: Chunks as a fold over pieces: paragraphs, and the sentences of those of more than 1,500 bytes.
_CHUNKED = f"""
    para as (
        select doc_id, i as para, {_BARE("parts[i]")} as p from (select doc_id, string_split(text, chr(10) || chr(10)) as parts from documents where text is not null), unnest(range(1, len(parts) + 1)) as t(i)),
    solid as (select *, strlen(p) > 1500 as big from para where p != ''),
    ends as (select doc_id, para, p, list_filter(list_transform(range(1, length(p) + 1), lambda i: case when contains('.?!', substring(p, i::int, 1)) then {{'pos': i::int, 'b': strlen(substring(p, 1, i::int))}} end), lambda e: e is not null) as e from solid where big),
    cut(doc_id, para, p, e, n, lo, lo_b, piece) as (
        select doc_id, para, p, e, 0, 0, 0::bigint, '' from ends
        union all select doc_id, para, p, list_filter(e, lambda x: x.pos > hit), n + 1, hit, hit_b, substring(p, lo + 1, hit - lo)
        from (select *, coalesce(f.pos, length(p)::int) as hit, coalesce(f.b, strlen(p)) as hit_b from (select *, list_filter(e, lambda x: x.b - lo_b > 50)[1] as f from cut where lo < length(p)))),
    pieces as (
        select doc_id, para, 0 as n, p as piece, false as big from solid where not big
        union all select doc_id, para, n, {_BARE("piece")}, true from cut where n > 0 and {_BARE("piece")} != ''),
    numbered as (
        select *, row_number() over (partition by doc_id order by para, n) as i, row_number() over (partition by doc_id, para order by n) = 1 as first, row_number() over (partition by doc_id, para order by n desc) = 1 as last, strlen(piece) as bytes from pieces),
    fold(doc_id, i, chunk, size, fresh) as (
        select doc_id, 0::bigint, 0::bigint, 0::bigint, true from (select distinct doc_id from numbered)
        union all select doc_id, i, chunk, case when last and size >= 500 then 0 else size end, fresh from (
            select f.doc_id, p.i, p.last, f.size = 0 or flush as fresh, case when f.size = 0 or flush then f.chunk + 1 else f.chunk end as chunk,
                case when f.size = 0 or flush then bytes else f.size + bytes + case when big then 1 else 2 end end as size
            from fold f join (select * from numbered) p on p.doc_id = f.doc_id and p.i = f.i + 1, lateral (select f.size > 0 and (f.size + bytes > 1500 or (big and first)) as flush))),
    joined as (select doc_id, (chunk - 1)::int as chunk_index, string_agg(case when fresh then piece when big then ' ' || piece else chr(10) || chr(10) || piece end, '' order by i) as content from fold join numbered using (doc_id, i) group by 1, 2)
"""
ORACLES["chunk_documents"] = f"with recursive {_CHUNKED} select doc_id, chunk_index, strlen(content)::int as bytes, md5(content) as md5 from joined"

_OPEN = f"(select document_id as doc_id, text from ({SCOPE_SQL}) where sanitization_state in ('sanitized', 'never') and tenant_id = 1 and data_level <= 'T3')"
ORACLES["hybrid_topk"] = f"""
    with recursive {_CHUNKED.replace("from documents where", f"from {_OPEN} where")},
    q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 50 = 0 and embedding is not null),
    v as (select vec_id as doc_id, embedding::double[] as e from embeddings where embedding is not null),
    near as (
        select query_id, doc_id, round(list_cosine_similarity(e, q), 6) as score from q, v where doc_id in (select doc_id from joined where chunk_index = 0)
        qualify row_number() over (partition by query_id order by round(list_cosine_similarity(e, q), 6) desc, doc_id) <= 10),
    sem as (select query_id, doc_id, chunk_index, content, score from near join joined using (doc_id) qualify row_number() over (partition by query_id order by score desc, doc_id, chunk_index) <= 10),
    padded as (select *, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t != ''), '  ') || ' ' as w from joined),
    lex as (select doc_id, chunk_index, content, round(n / (n + 1.0), 6)::double as score from (select *, len(regexp_extract_all(w, ' of  the ')) as n from padded) where n > 0 order by score desc, doc_id, chunk_index limit 10),
    legs as (select query_id, doc_id, chunk_index, content, score * 0.6::double as score, 0 as leg from sem union all select query_id, doc_id, chunk_index, content, score * 0.4::double, 1 from q, lex),
    both_legs as (select query_id, content, round(sum(score), 6) as score, min({{'leg': leg, 'doc_id': doc_id, 'chunk_index': chunk_index}}) as spot from legs group by 1, 2),
    top as (select query_id, spot.doc_id as document_id, spot.chunk_index as chunk_index, content, score, row_number() over (partition by query_id order by score desc, spot.doc_id, spot.chunk_index) as position from both_legs qualify position <= 10),
    spent as (select *, coalesce(sum(length(content)) over (partition by query_id order by position rows between unbounded preceding and 1 preceding), 0)::bigint as used from top),
    kept as (select *, left(content, greatest(3000 - used, 0)) as shown from spent where 3000 - used > 0),
    marked as (select *, contains(lower(shown), 'the') as matched from kept)
    select query_id, document_id, chunk_index, (row_number() over (partition by query_id order by matched desc, position))::int as rank, score, matched, length(shown)::int as chars
    from marked where query_id in (select query_id from marked where matched)
"""

__all__ = ["ORACLES", "QUERIES"]
