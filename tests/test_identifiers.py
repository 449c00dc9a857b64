from __future__ import annotations

import hashlib
import hmac
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import spans as S
from docloom.operators import redact
from docloom.operators.detect import detect

KEY = redact.scoped_key("s", "t", "m")
HITS = [
    ("身份证11010519491231002X", "CN_ID", "11010519491231002X", "checksum"),
    ("号码110105199003074512。", "CN_ID", "110105199003074512", "pattern"),
    ("代码91350100M000100Y43", "USCC", "91350100M000100Y43", "checksum"),
    ("手机13812345678号", "CN_MOBILE", "13812345678", "checksum"),
    ("手机138 1234 5678", "CN_MOBILE", "138 1234 5678", "checksum"),
    ("卡号4111-1111-1111-1111", "BANK_CARD", "4111-1111-1111-1111", "checksum"),
    ("卡号４１１１１１１１１１１１１１１１", "BANK_CARD", "４１１１１１１１１１１１１１１１", "checksum"),
    ("write a@b.com", "EMAIL", "a@b.com", "pattern"),
    ("host 192.168.1.1.", "IP", "192.168.1.1", "pattern"),
    ("电话010-12345678", "LANDLINE", "010-12345678", "pattern"),
    ("护照 PE1234567", "PASSPORT", "PE1234567", "context"),
    ("护照E12345678", "PASSPORT", "E12345678", "context"),
    ("TaxID 3101401176368", "TH_TAXID", "3101401176368", "context"),
    ("卖方JuristicID0115565002108", "TH_JURISTIC", "0115565002108", "context"),
    ("军字第1234567号", "MILITARY_ID", "军字第1234567号", "context"),
    ("H1234567890", "HK_MO_PERMIT", "H1234567890", "pattern"),
    ("入境许可证：HK1234567", "HK_MO_PERMIT", "HK1234567", "context"),
    ("台胞证号码12345678", "TW_PERMIT", "12345678", "pattern"),
    ("旧身份证110105491231002", "LEGACY_ID", "110105491231002", "context"),
    ("律师执业证11101200010123456", "LAWYER_NO", "11101200010123456", "context"),
    ("粤B12345", "PLATE", "粤B12345", "pattern"),
    ("纳税人识别号：9135010012345678", "CN_TAX_ID", "9135010012345678", "context"),
    ("NPWP: 01.234.567.8-901.234", "CN_TAX_ID", "01.234.567.8-901.234", "context"),
    ("账号 6217900123456789010", "BANK_ACCOUNT", "6217900123456789010", "context"),
    ("微信号: abc_def9", "WECHAT", "abc_def9", "context"),
    ("A123456(7)", "HK_ID", "A123456(7)", "pattern"),
    ("S1234567D", "SG_NRIC", "S1234567D", "pattern"),
    ("900101-14-5678", "MY_ID", "900101-14-5678", "pattern"),
    ("北京市朝阳区建国路88号", "ADDRESS", "北京市朝阳区建国路88号", "pattern"),
]
MISSES = ["编号020123456789", "编号010123456789", "1.2.3.4.5", "900231-14-5678", "plain words", "", "[EMAIL_AB12CD34EF567890]", "CN_ID_0123456789ABCDEF"]


@pytest.fixture(scope="module")
def found(spark):
    rows = spark.createDataFrame([(t,) for t in [h[0] for h in HITS] + MISSES], "text string")
    return {r.text: r.matches for r in detect(rows).collect()}


def test_hits(found):
    for text, code, value, source in HITS:
        got = [(m.entity, m.text, m.source) for m in found[text]]
        assert (code, value, source) in got, (text, got)
        m = next(m for m in found[text] if m.entity == code and m.text == value)
        assert text[m.start : m.end] == value


def test_misses(found):
    for text in MISSES:
        assert found[text] == [], text


def test_null_text(spark):
    assert detect(spark.createDataFrame([(None,)], "text string"), codes=["EMAIL"]).first().matches is None


def test_longest_first(spark):
    rows = [(0, 5, "A"), (3, 14, "B"), (13, 16, "C"), (20, 22, "D")]
    matches = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(c).alias("entity"), F.lit("x").alias("text"), F.lit(0.9).alias("confidence"), F.lit("pattern").alias("source")) for s, e, c in rows]).cast(S.MATCH)
    got = spark.range(1).select(S.longest_first(matches).alias("m")).first().m
    assert [(m.start, m.end) for m in got] == [(3, 14), (20, 22)]


def _done(spark, texts, key=KEY):
    return redact.redact(detect(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), codes=["EMAIL", "IP", "BANK_CARD", "CN_MOBILE"]), key)


def test_redaction_properties(spark):
    texts = ["mail a@b.com, card 4111 1111 1111 1111 and 4111-1111-1111-1111", "no identifiers", "a@b.com"]
    done = _done(spark, texts).withColumn("vault", redact.mapping(F.col("applied"))).withColumn("back", redact.restore(F.col("redacted"), F.col("vault")))
    rows = {r.i: r for r in done.collect()}
    tokens = [a.token for a in rows[0].applied]
    assert tokens[1] == tokens[2]  # separators do not matter
    assert tokens[0] == rows[2].applied[0].token == rows[2].redacted
    want = hmac.new(KEY, b"EMAIL\0a@b.com", hashlib.sha256).hexdigest()[:16].upper()
    assert tokens[0] == f"[EMAIL_{want}]"
    assert rows[1].redacted == rows[1].back == texts[1] and rows[2].back == texts[2]
    other = _done(spark, texts, redact.scoped_key("s", "t", "other")).where("i = 2").first()
    assert other.redacted != rows[2].redacted
    again = _done(spark, [rows[0].redacted]).first()
    assert again.redacted == rows[0].redacted  # idempotent


def test_restore_refuses_unknown_tokens(spark):
    vault = F.create_map(F.lit("[EMAIL_00]"), F.struct(F.lit("EMAIL").alias("entity"), F.lit("a@b.com").alias("original")))
    r = spark.range(1).select(redact.restore(F.lit("x [EMAIL_00]"), vault).alias("a"), redact.restore(F.lit("x [EMAIL_01]"), vault).alias("b")).first()
    assert (r.a, r.b) == ("x a@b.com", None)


def test_verify_blocks_what_is_left(spark):
    rows = spark.createDataFrame([(0, "keep a@b.com"), (1, "clean")], "i int, text string")
    left = rows.withColumn("applied", F.array().cast(redact.APPLIED)).withColumn("redacted", F.col("text"))
    assert {r.i: r.verdict for r in redact.verify(left, ["EMAIL"]).collect()} == {0: "block", 1: "pass"}
    sane = {r.i: (r.verdict, r.state) for r in redact.sanitize(rows, KEY, codes=["EMAIL"]).collect()}
    assert sane == {0: ("pass", "sanitized"), 1: ("pass", "sanitized")}


def test_key_is_not_in_the_plan(spark):
    done = _done(spark, ["a@b.com"], b"very-secret-key")
    assert "very-secret-key" not in done._jdf.queryExecution().toString()


def test_many_matches_are_counted_and_refused_by_name(spark):
    from docloom.plans import catalog

    docs = spark.createDataFrame([(1, "s", "a@b.com " * 4200), (2, "s", "a@b.com")], "doc_id long, source string, text string")
    assert [len(r.matches) for r in detect(docs, codes=["EMAIL"], most=None).orderBy("doc_id").collect()] == [4200, 1]
    got = {r.entity: (r.found, r.residual) for r in catalog.audit(docs, ["EMAIL"]).collect()}
    assert got == {"EMAIL": (4201, 4200), "REFUSED": (1, 1)}


def test_a_text_of_many_identifiers_goes_and_comes_back_soon(spark):
    text = " ".join(f"user{i}@mail{i % 97}.org" for i in range(4000))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(4)], "i int, text string")
    _done(spark, ["a@b.com"]).collect()
    start = time.time()
    done = redact.redact(detect(docs, codes=["EMAIL"]), KEY).withColumn("vault", redact.mapping(F.col("applied")))
    rows = done.select("text", "redacted", F.size("vault").alias("n"), redact.restore(F.col("redacted"), F.col("vault")).alias("back")).collect()
    assert all(r.n == 4000 and r.back == r.text and "@" not in r.redacted for r in rows)
    assert time.time() - start < 8


def test_what_stays_in_the_text_and_which_of_two_goes(spark):
    text = "EPA and Ministry of X met A; (2020)京01号 and 京02号 by Jo at 5:00"
    at = lambda v, code, source="model", sure=0.9: (text.index(v), text.index(v) + len(v), code, v, sure, source)
    found = [at("EPA", "ORG"), at("Ministry of X", "ORG"), at("A;", "ORG")[:1] + (text.index("A;") + 1, "PERSON", "A", 0.9, "model"), at("京01号", "CASE_NO"), at("京02号", "CASE_NO"), at("Jo", "PERSON", sure=0.5), at("Jo at", "PERSON", sure=0.6), at("Jo", "LOCATION", "pattern", 0.1), at("5:00", "CREDENTIAL", "pattern")]
    docs = spark.createDataFrame([(text, found), (text, None), (text, [])], f"text string, matches {S.MATCH}")
    rows = redact.redact(docs, KEY, public=["EPA"], vendors=["Ministry"]).collect()
    assert [(a.original, a.entity) for a in rows[0].applied] == [("京02号", "CASE_NO"), ("Jo at", "PERSON"), ("5:00", "CREDENTIAL")]
    assert rows[0].redacted == text.replace("京02号", rows[0].applied[0].token).replace("Jo at", rows[0].applied[1].token).replace("5:00", "") and rows[0].applied[2].token == ""
    assert (rows[1].applied, rows[1].redacted) == (None, None) and (rows[2].applied, rows[2].redacted) == ([], text)


def test_originals_that_hold_tokens_are_restored_in_order(spark):
    cases = [
        ("a [AA] [B]", {"[AA]": "x [B]", "[B]": "y"}, "a x y y"),  # longer ones first, and what they bring in
        ("a [B] [AA]", {"[AA]": "x", "[B]": "[AA]"}, "a [AA] x"),  # but not what comes too late
        ("[A[B]C]", {"[B]": "x", "[AxC]": "y"}, "[AxC]"), ("[A[BBB]C]", {"[BBB]": "", "[AC]": "y"}, "y"),
        ("foo [B]", {"foo": "[B]", "[B]": "b"}, "[B] b"), ("[B]", {"[B]": "[B]"}, "[B]"), ("[B]", {"[B]": None}, None), ("[B]", {}, None), ("none", {}, "none"), ("x", None, None), (None, {}, None),
    ]
    rows = spark.createDataFrame([(i, t, v and {k: ("E", o) for k, o in v.items()} if v is not None else None) for i, (t, v, _) in enumerate(cases)], f"i int, text string, vault {redact.VAULT}")
    got = {r.i: r.back for r in rows.select("i", redact.restore(F.col("text"), F.col("vault")).alias("back")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for *_, want in cases]


def test_one_function_gives_what_the_three_steps_give(spark):
    texts = [None if i % 7 == 0 else "a@b.com " * 4200 if i == 300 else f"mail u{i}@b.com and 10.0.0.{i % 256} 4111 1111 1111 {i % 10000:04d}" for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").coalesce(1)
    steps = redact.verify(redact.redact(detect(docs), KEY))
    whole = redact.detect_and_redact(docs, KEY, whole="every")
    assert whole.drop("every").columns == steps.columns
    assert whole.drop("every").orderBy("n").collect() == steps.orderBy("n").collect()
    refused = whole.where("n = 300").first()
    assert len(refused.every) == 4200 and (refused.matches, refused.applied, refused.redacted, refused.residue, refused.verdict) == (None, None, None, None, "block")
    assert redact.detect_and_redact(docs.limit(0), KEY).collect() == []


def test_matches_of_few_rows_are_held_at_once():
    import tracemalloc

    import pyarrow as pa

    from docloom.functions.redactor import chain

    texts = pa.array([" ".join(f"u{i}k{k}@b.com" for k in range(40)) for i in range(6000)])
    run = chain(S.rules_for(["EMAIL"]), KEY, None, 4096)
    tracemalloc.start()
    out = run(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 6000 and peak < 60_000_000
