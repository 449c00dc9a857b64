"""Registered queries of the training-data operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .licenses import TEMPLATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query(
    "op5_minhash_near_dedup",
    r"""
    with recursive words as (
        select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as w
        from documents),
    sh as (
        select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[]
            when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s
        from words),
    n as (select doc_id, count(*) as n from sh group by doc_id),
    rare as (select *, count(*) over (partition by s) as f from sh),
    ranked as (select doc_id, s, row_number() over (partition by doc_id order by f, s) as k from rare),
    prefix as (select r.doc_id, r.s from ranked r join n using (doc_id) where r.k <= n.n - ceil(n.n * 0.85) + 1),
    cand as (select distinct x.doc_id as a, y.doc_id as b from prefix x join prefix y on x.s = y.s and x.doc_id < y.doc_id),
    inter as (select a, b, count(*) as i from cand join sh x on x.doc_id = a join sh y on y.doc_id = b and y.s = x.s group by a, b),
    links as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
    both_ways as (select a, b from links union select b, a from links),
    reach(x, y) as (select doc_id, doc_id from documents union select r.x, e.b from reach r join both_ways e on r.y = e.a),
    comp as (select x as doc_id, min(y) as component_id from reach group by x)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, d.doc_id = c.component_id as kept
    from documents d join comp c using (doc_id) left join n using (doc_id)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query(
    "op9_substring_dedup",
    r"""
    with words as (
        select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as w from documents),
    win as (
        select doc_id, unnest(range(1, len(w) - 48)) as p, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i : i + 49], ' ')))) as h
        from words where len(w) >= 50),
    firsts as (select h, min(doc_id) as d from win group by h),
    gone as (select distinct doc_id, unnest(range(p, p + 50)) as p from win join firsts using (h) where firsts.d < win.doc_id),
    all_words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from words),
    kept as (
        select doc_id, string_agg(x, ' ' order by a.p) as t, count(*) as n
        from all_words a anti join gone g on a.doc_id = g.doc_id and a.p = g.p group by doc_id)
    select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from words left join kept using (doc_id)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import best_fit

    return best_fit(read(spark, sf_dir, "documents"))


@query("op6_mixing_ipf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents"), with_text=False, with_off=True).select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled", "off")


@query("op8_language_mixture")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    return identify(read(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query(
    "op10_cover_tree_embeddings",
    r"""
    with recursive v as (
        select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
        where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
          and len(list_filter(embedding, lambda x: x != 0)) > 0),
    links as (
        select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id
        where list_cosine_similarity(x.e, y.e) >= 0.93),
    both_ways as (select a, b from links union all select b, a from links),
    reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, e.b from reach r join both_ways e on r.y = e.a),
    comp as (select x as vec_id, min(y) as component_id from reach group by x),
    n as (select a as vec_id, count(*) as n from both_ways group by a)
    select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
    from embeddings e join comp c using (vec_id) left join n using (vec_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .covertree import near_embeddings

    return near_embeddings(read(spark, sf_dir, "embeddings"))


@query(
    "op3_warc_salvage",
    r"""
    with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
    o as (select *, max(page_id) over (partition by t) as last from p)
    select page_id, strlen(t)::bigint as payload_bytes,
        array_to_string(list_transform(range(32), lambda k: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            (((('0x' || substring(h, (1 + 10 * (k // 8))::int, 10))::ubigint >> (35 - 5 * (k % 8))::ubigint) & 31) + 1)::int, 1)), '') as payload_digest,
        case when page_id < last then 'revisit' else 'response' end as record_type,
        case when page_id < last then last end as refers_to
    from o
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(read(spark, sf_dir, "pages"))


@query("op4_url_association_rules")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlrules import judge

    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


@query("op1_pitman_yor_scores")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pitmanyor import score

    return score(read(spark, sf_dir, "documents"))


@query(
    "op11_quantised_ranking",
    r"""
    with t as (select 'd' as side, doc_id as id, text from documents union all select 'q', item_id, text from benchmark),
    terms as (select side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from t),
    tf as (select id as doc_id, term, count(*) as tf from terms where side = 'd' group by all),
    doc as (select doc_id, sum(tf)::bigint as n from tf group by doc_id),
    total as (select count(*) as docs, sum(n)::bigint as l from doc),
    df as (select term, count(*) as df from tf group by term),
    w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from df, total),
    asked as (select id as item_id, term, count(*) as times from terms where side = 'q' group by all),
    s as (
        select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::bigint as score
        from asked join w using (term) join tf using (term) join doc using (doc_id), total group by all),
    r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
    select item_id, rank::int as rank, doc_id, score from r where rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rankindex import rank

    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(
    "op12_filter_lattice_audit",
    r"""
    with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
    w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x != '') as w, min(doc_id) over (partition by t) as first from t),
    l as (select doc_id, max(quality) as good, max(toxic) as bad from labels group by doc_id),
    m as (
        select doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] as f,
            coalesce(good, 0) = 1 as good, coalesce(bad, 0) = 1 as bad
        from w left join l using (doc_id)),
    x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
    o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s as (select o as filter_order, step, ascii(o[step]) - 64 as i, list_transform(range(1, step), lambda j: ascii(o[j]) - 64) as before from o, range(1, 6) as r(step)),
    e as (select part, filter_order, step, i, f[i] as fails, len(list_filter(before, lambda j: f[j])) > 0 as gone, len(list_filter(f, lambda y: y)) = 1 as one, good, bad from m, s),
    a as (
        select part, filter_order, step::int as step, i, count(*) filter (not fails and not gone) as kept, count(*) filter (fails and not gone) as removed, count(*) filter (fails and gone) as redundant,
            count(*) filter (fails and one) as unique_fails, count(*) filter (fails and not gone and good) as good_lost, count(*) filter (fails and not gone and bad) as toxic_lost
        from e group by all)
    select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, i))::bigint as shapley from a
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import audit

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query(
    "op13_license_diagonals",
    r"""
    with t(template, label, body) as (values TEMPLATES),
    low as (
        select 1 as kind, template as id, body as text from t
        union all select 0, doc_id, text from documents),
    w as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
    word_at as (select kind, id, len(w) as n, unnest(range(0, len(w))) as pos, unnest(w) as a, unnest(list_append(w[2:], null)) as b, unnest(list_concat(w[3:], [null, null])[:len(w)]) as c, unnest(list_concat(w[4:], [null, null, null])[:len(w)]) as d from w where len(w) > 0),
    base as (
        select id, case when a = 'gnu' and b = 'general' and c = 'public' and d = 'license' then 'gpl' when a = 'apache' and b = 'license' then 'apache' when a = 'cc' and b = 'by' then 'cc-by' when a = 'mit' and b = 'license' then 'mit' end as label, pos
        from word_at where kind = 0 and (a, b) in (('gnu', 'general'), ('apache', 'license'), ('cc', 'by'), ('mit', 'license'))),
    found as (select id as doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list(distinct label) as labels from base where label is not null group by id),
    votes as (select d.id as doc_id, p.id as template, d.pos - p.pos as diagonal, d.pos, p.pos as place from word_at d join word_at p using (a, b, c) where d.kind = 0 and p.kind = 1),
    dia as (select doc_id, template, diagonal, min(pos) as first, max(pos) as last from votes group by all),
    size as (select id as template, n from word_at where kind = 1 group by all),
    step as (
        select *, case when diagonal - lag(diagonal) over o <= 3 and first - lag(last) over o <= n and lag(first) over o - last <= n then 0 else 1 end as new
        from dia join size using (template) window o as (partition by doc_id, template order by diagonal)),
    isle as (select *, sum(new) over (partition by doc_id, template order by diagonal rows unbounded preceding) as island from step),
    ends as (select doc_id, template, island, n, min(first) as first, max(last) + 2 as last from isle group by all),
    words as (select distinct doc_id, template, island, place + unnest([0, 1, 2]) as place, pos + unnest([0, 1, 2]) as pos from isle join votes using (doc_id, template, diagonal)),
    cover as (select doc_id, template, island, count(distinct place) as places, count(distinct pos) as spots from words group by all),
    sure as (select doc_id, label, places::double / n as score from ends join cover using (doc_id, template, island) join t using (template) where places::double / n >= 0.7 and spots::double / (last - first + 1) >= 0.7),
    more as (select doc_id, list(distinct label) as labels, max(score) as score from sure group by doc_id)
    select d.id as doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word, coalesce(array_to_string(list_sort(f.labels), ','), '') as base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(f.labels, []), coalesce(m.labels, [])))), ','), '') as labels, case when n_base > 0 then 1.0::double else coalesce(m.score, 0.0::double) end as score
    from w d left join found f on f.doc_id = d.id left join more m on m.doc_id = d.id where d.kind = 0
    """.replace("TEMPLATES", ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))),
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(read(spark, sf_dir, "documents")).drop("spans")
