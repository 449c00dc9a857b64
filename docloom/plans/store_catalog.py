"""Registered queries of versioned tables and posting lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieve
from ..operators.postings import REACH, SQUARES, WEIGHT, PostingIndex
from ..operators.vectors import VectorIndex, recall
from ..sources.extract import extract, read_files
from ..sources.packages import edit_texts, register
from ..sources.shared import new_folder
from ..sources.versioned import VersionedTable
from .catalog import ORACLES, QUERIES, line_chunks, query
from .scope import scoped, table

_CHUNK = "document_id long, chunk_index long, content string, sanitization_state string"


@query(
    "sink_chunks",
    """
    select document_id, chunk_index, content, sanitization_state from ({CHUNKS}) where not (sanitization_state in ('pending', 'sanitized') and document_id % 4 = 1)
    union all select document_id, 0, 'redacted ' || document_id, 'sanitized' from ({SCOPE}) where document_id % 4 = 1
    union all select document_id, 1000000, source, 'pending' from ({SCOPE}) where document_id % 5 = 2
    """,
)
def sink_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk table after an append, replaced documents and one more append, read back."""
    store = VersionedTable.create(spark, new_folder(spark, "chunks"), _CHUNK, ["document_id"], parts=32)
    docs = scoped(spark, sf_dir)
    store.append(line_chunks(spark, sf_dir))
    fresh = docs.where("document_id % 4 = 1").select("document_id", F.lit(0).alias("chunk_index"), F.concat(F.lit("redacted "), "document_id").alias("content"), F.lit("sanitized").alias("sanitization_state"))
    store.replace_chunks(fresh)
    store.append(docs.where("document_id % 5 = 2").select("document_id", F.lit(1_000_000).alias("chunk_index"), F.col("source").alias("content"), F.lit("pending").alias("sanitization_state")))
    return store.read()


@query(
    "sink_upsert",
    """
    with o as (select o_orderkey, o_custkey, o_orderstatus as status, 1 as stamp from orders),
    n as (select o_orderkey, o_custkey, 'upserted', case when o_orderkey % 2 = 0 then 2 else 0 end from orders where o_orderkey % 3 = 0
        union all select -o_orderkey, o_custkey, 'new', 5 from orders where o_orderkey % 7 = 0)
    select * from (select * from o union all select * from n) qualify row_number() over (partition by o_orderkey order by stamp desc) = 1
    """,
)
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after an upsert with newer, older and new rows, read back."""
    store = VersionedTable.create(spark, new_folder(spark, "orders"), "o_orderkey long, o_custkey long, status string, stamp int", ["o_orderkey"], parts=32)
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    store.append(orders.select(k, "o_custkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("stamp")))
    changed = orders.where(k % 3 == 0).select(k, "o_custkey", F.lit("upserted").alias("status"), F.when(k % 2 == 0, 2).otherwise(0).alias("stamp"))
    store.upsert(changed.unionByName(orders.where(k % 7 == 0).select((-k).alias("o_orderkey"), "o_custkey", F.lit("new").alias("status"), F.lit(5).alias("stamp"))), "stamp")
    return store.read()


@query("sink_revisions", "select o_orderkey as k, case when o_orderkey % 3 = 1 then 'second' else 'first' end as body, (case when o_orderkey % 3 = 1 then 2 else 1 end)::bigint as revision from orders")
def sink_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a revision after edits of which a third expects the right one, a third a wrong one."""
    store = VersionedTable.create(spark, new_folder(spark, "notes"), "k long, body string, revision long", ["k"], parts=32)
    k = F.col("k")
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    store.revise(keys.select("k", F.lit("first").alias("body"), F.lit(1).alias("at"), F.lit(None).cast("long").alias("expected")))
    store.revise(keys.where(k % 3 < 2).select("k", F.lit("second").alias("body"), F.lit(1).alias("at"), F.when(k % 3 == 1, 1).otherwise(9).cast("long").alias("expected")))
    return store.read()


_LETTERS, _HAN = "etaoin", "的一是不了人"


def _rank_sql(content: str) -> str:
    token = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(lower({c}), '([一-鿿])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x != '')"
    return f"""
    with c as (select document_id, chunk_index, {token(content)} as t, sanitization_state in ('sanitized', 'never') and tenant_id = 1 and data_level <= 'T3' as open from ({{CHUNKS}})),
    d as (select document_id, {token(content.replace("content", "text"))} as t from ({{SCOPE}}) where document_id % 50 = 0),
    asked as (select 2 * document_id as query_id, t[3:3] as q from d union all select 2 * document_id + 1, t[4:5] from d union all select -1 - document_id, t[2:4] from d),
    qs as (select query_id, q, len(q) as n, len(list_distinct(q)) as kinds from asked where len(q) > 0),
    w as (select document_id, chunk_index, unnest(t) as term, unnest(range(1, len(t) + 1)) as pos from c where open),
    qt as (select query_id, n, unnest(q) as term, unnest(range(0, n)) as place from qs),
    starts as (select query_id, document_id, chunk_index from w join qt using (term) group by query_id, document_id, chunk_index, pos - place, n having count(*) = n),
    hit as (select distinct * from starts),
    spots as (select distinct query_id, document_id, chunk_index, kinds, term, pos from hit join qs using (query_id) join (select distinct query_id, term from qt) using (query_id) join w using (document_id, chunk_index, term)),
    one as (select query_id, document_id, chunk_index, {WEIGHT} * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::double / (j * j))) / {SQUARES} as score from spots where kinds = 1 group by all),
    many as (
        select a.query_id, a.document_id, a.chunk_index, 1 - exp(sum(ln(1 - sqrt({WEIGHT} * {WEIGHT}::double / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5::double - 2)))))) as score
        from spots a join spots b on a.query_id = b.query_id and a.document_id = b.document_id and a.chunk_index = b.chunk_index and a.term < b.term and abs(a.pos - b.pos) between 1 and {REACH} group by all),
    s as (select query_id, document_id, chunk_index, round(score, 6)::double as score from (select * from one union all select * from many))
    select * from s qualify row_number() over (partition by query_id order by score desc, document_id, chunk_index) <= 10
    """


def _posting_search(spark: SparkSession, sf_dir: str, alter) -> DataFrame:
    index = PostingIndex.create(spark, new_folder(spark, "postings"))
    index.add(line_chunks(spark, sf_dir).withColumn("content", alter("content")))
    t = retrieve.tokens(alter("text"))
    d = scoped(spark, sf_dir).where("document_id % 50 = 0").select("document_id", t.alias("t"))
    pick = lambda number, lo, n: F.struct(number.alias("query_id"), F.array_join(F.slice("t", lo, n), " ").alias("query"))
    i = F.col("document_id")
    asked = d.select(F.explode(F.array(pick(2 * i, 3, 1), pick(2 * i + 1, 4, 2), pick(-1 - i, 2, 3))).alias("q")).select("q.*")
    return index.search(asked, 10, retrieve.gated(scoped(spark, sf_dir), 1))


@query("lexical_index_topk", _rank_sql("content"))
def lexical_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word, two and three words of every document whose id is divisible by 50, against all lines, ranked."""
    return _posting_search(spark, sf_dir, lambda c: F.col(c))


@query("lexical_index_cjk", _rank_sql(f"translate(content, '{_LETTERS}', '{_HAN}')"))
def lexical_index_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the commonest letters written as Han characters, each a token."""
    return _posting_search(spark, sf_dir, lambda c: F.translate(c, _LETTERS, _HAN))


def _vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """All vectors of the table, half of them added after the index was made."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    index = VectorIndex.create(rows.where("document_id % 2 = 0"), new_folder(spark, "vectors"))
    index.add(rows.where("document_id % 2 = 0"))
    index.add(rows.where("document_id % 2 = 1"))
    return index


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query("semantic_index_topk")
def semantic_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty near vectors of every vector whose id is divisible by 50, and how many rows each search looked at."""
    index = _vector_index(spark, sf_dir)
    hits, touched = index.search(_vector_queries(spark, sf_dir), 20, index.tune(20))
    return hits.join(touched, "query_id").select("query_id", "document_id", "score", F.col("rows").alias("rows_touched"))


@query("semantic_index_recall", "select count(*)::bigint as queries, true as recalled, true as fewer_rows from embeddings where vec_id % 50 = 0 and embedding is not null")
def semantic_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether nine tenths of the exact neighbours are found, looking at less than the whole table."""
    index, asked = _vector_index(spark, sf_dir), _vector_queries(spark, sf_dir)
    hits, touched = index.search(asked, 20, index.tune(20))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    got = recall(hits, retrieve.semantic_each(rows, asked, 20))
    mean = touched.agg(F.avg("rows").alias("mean"))
    return got.join(mean).join(rows.agg(F.count("*").alias("all"))).select("queries", (F.col("recall") >= 0.9).alias("recalled"), (F.col("mean") < F.col("all")).alias("fewer_rows"))


_ESC = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "tracked_edits",
    f"""
    with d as (select doc_id, text, source, substring(text, 11, 20) as f from documents where length(text) >= 40),
    e as (select *, translate(f, 'aeiou', 'AEIOU') || ' and ' || source as r, instr(text, f) as i from d)
    select doc_id, cast(null as varchar) as refused, md5({_ESC("substring(text, 1, (i - 1)::int) || r || substring(text, (i + 20)::int)")}) as md5, length({_ESC("f")})::int as gone from e
    """,
)
def tracked_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty characters of each document changed as tracked words: what acceptance shows, and what the marks and equal words hold of the old text."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    docs = table(spark, sf_dir, "documents").where("length(text) >= 40").select("doc_id", "text", F.substring("text", 11, 20).alias("f"), "source")
    rows = docs.select("doc_id", "text", "f", F.concat(F.translate("f", "aeiou", "AEIOU"), F.lit(" and "), "source").alias("r"), F.concat(F.lit('<w:p><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">'), escaped(F.col("text")), F.lit("</w:t></w:r></w:p>")).alias("xml"))
    done = edit_texts(rows, "xml", "f", "r")
    visible = F.regexp_replace("accepted", "<[^>]*>", "")
    # without its insertions the edited part holds the old text: so much of it is not outside of what was found
    old = F.regexp_replace(F.regexp_replace("edited", "(?s)<w:ins .*?</w:ins>", ""), "<[^>]*>", "")
    same = F.when(old == escaped(F.col("text")), F.length(escaped(F.col("f"))))
    return done.select("doc_id", "refused", F.md5(visible).alias("md5"), same.alias("gone"))


@query(
    "docx_round_trip",
    """
    select s_suppkey, 'docx' as format, false as incomplete, 'Deed of ' || s_name || '(' || s_nationkey || ')' || '(a)  first & last(b)  <second>• point' || '[head]' || '[' || round(s_acctbal, 2)::decimal(12, 2) || ']' || '"end"' as text from supplier
    """,
)
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A package written for every supplier with the docx sink, and its text read back."""
    register(spark)
    folder, s = new_folder(spark, "deeds"), table(spark, sf_dir, "supplier")
    part = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[v.alias(k) for k, v in more.items()])
    none = {"text": F.lit(None).cast("string"), "items": F.lit(None).cast("array<string>"), "headers": F.lit(None).cast("array<string>"), "rows": F.lit(None).cast("array<array<string>>"), "depth": F.lit(2)}
    one = lambda kind, **more: part(kind, **{**none, **more})
    sections = F.array(
        one("paragraph", text=F.concat(F.lit("("), F.col("s_nationkey").cast("string"), F.lit(")"))), one("numbered_list", items=F.array(F.lit("first & last"), F.lit("<second>"))), one("bullet_list", items=F.array(F.lit("point"))),
        one("table", headers=F.array(F.lit("[head]")), rows=F.array(F.array(F.concat(F.lit("["), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit("]"))))), one("page_break"), one("recital", text=F.lit('"end"')),
    )
    structure = F.to_json(F.struct(F.concat(F.lit("Deed of "), "s_name").alias("title"), sections.alias("sections")))
    s.select(F.concat(F.lit("s"), "s_suppkey", F.lit(".docx")).alias("name"), structure.alias("structure")).write.format("docx").mode("append").save(folder)
    key = F.regexp_extract("path", r"s([0-9]+)\.docx$", 1).cast("long").alias("s_suppkey")
    return extract(read_files(spark, folder)).select(key, "format", "incomplete", "text")


__all__ = ["ORACLES", "QUERIES"]
