"""The rules in Arrow tasks against their SQL on odd texts, and on texts that took very long."""

from __future__ import annotations

import random
import time

import pytest

from docloom.operators.detect import detect
from docloom.plans.classes_catalog import PLANTS
from docloom.plans.rules_sql import matches


def odd_texts(n: int) -> list[str]:
    """Pieces of the planted line, cut and joined anew with blanks, breaks, wide signs and halves of tokens."""
    r = random.Random(7)
    line = PLANTS.replace("~~~~~~", "123456").replace("^^^^", "7890")
    glue = ["", " ", "\n", "\v", "\x1f", "-", "．", "(", ")", "[", "]", "@", "_", "é", "０", "x", "EMAIL_", "[CN_ID_", "护照", "́", "　", "MST\v", "Tax ID\v", "NPWP\f", "入境许可证", "越南税号", "银行账号", "8 6 "]
    return ["".join(line[(a := r.randrange(len(line))) : a + r.randrange(1, 40)] + r.choice(glue) for _ in range(r.randrange(1, 25))) for _ in range(n)] + ["", "Tax ID\v0107123456000 end", "EMAIL_\n0123456789ab12"]


def test_odd_texts_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    texts = odd_texts(150)
    con = duckdb.connect()
    con.register("p", pa.table({"id": range(len(texts)), "text": texts}))
    want = sorted(con.sql(f"with recursive {matches('a', 'p')} select id, s, e, entity, v, source from am").fetchall())
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), most=None).collect()
    assert sorted((r.id, m.start, m.end, m.entity, m.text, m.source) for r in rows for m in r.matches) == want and len(want) > 300


def test_a_long_word_and_many_planted_texts_are_gone_through_once(spark):
    line = PLANTS.replace("~~~~~~", "123456").replace("^^^^", "7890")
    texts = ["a" * 400_000 + " x@y.org", *[line] * 400]
    detect(spark.createDataFrame([("x",)], "text string")).collect()
    start = time.time()
    rows = detect(spark.createDataFrame([(t,) for t in texts], "text string"), most=None).selectExpr("size(matches) as n").collect()
    assert rows[0].n == 1 and {r.n for r in rows[1:]} == {rows[1].n} and rows[1].n > 40
    assert time.time() - start < 15


def test_a_card_glued_to_an_address_is_redacted_with_it(spark):
    from docloom.plans.catalog import audit

    docs = spark.createDataFrame([("a", "host 71.129.171.132 4815819516090933 end"), ("b", "71.129.171.132 4815819516090933 now x@y.org")], "source string, text string")
    left = lambda **how: {(r.source, r.entity): (r.found, r.residual) for r in audit(docs, **how).collect()}
    assert left()["a", "BANK_CARD"] == (0, 1)
    assert {k: v[1] for k, v in left(again=3).items() if v[1]} == {}
    assert left(again=3)["b", "EMAIL"] == (1, 0)


def test_hits_at_the_ends_of_the_parts_that_are_searched_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import pyarrow as pa

    far = "x. " * 60
    address = "一" * 8 + "特别行政区" + "一" * 10 + "自治州" + "一" * 20 + "一" * 10 + "区" + "一" * 24 + "大道" + "一" * 20 + "12345号"
    short = [address, "台湾居民来往大陆通行证：12345678", "旧行身份证号：110105491231002", "AB123456(A)", "1234567(8)", "EA1234567", "H1234567890", "S1234567D", "11010519491231002X", "11010519491231002 - X", "86 138 1234 5678", "900101-14-1234", "010-12345678", "255.255.255.255"]
    texts = [a + t + b for t in short for a in ("", far, "1.", "7 ", "12345678 ") for b in ("", " " + far, ".", " 1234567")]
    texts += [a + " " + b for a in short for b in short] + [far.join(short), "1.2.3.4.5.6.7.8 1234.5.6.7 1..2.3.4.5", "E12345678E12345678", "EE12345678"]
    con = duckdb.connect()
    con.register("p", pa.table({"id": range(len(texts)), "text": texts}))
    want = sorted(con.sql(f"with recursive {matches('a', 'p')} select id, s, e, entity, v, source from am").fetchall())
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), most=None).collect()
    assert sorted((r.id, m.start, m.end, m.entity, m.text, m.source) for r in rows for m in r.matches) == want and len(want) > 600


def test_identifiers_behind_long_prose_are_searched_where_they_are():
    import pyarrow as pa

    from docloom.functions.finder import finder
    from docloom.functions.spans import rules_for

    texts = pa.array(["Lorem ipsum (dolor) sit amet, on the 12th of May. " * 8000 + PLANTS.replace("~~~~~~", "123456").replace("^^^^", "7890")] * 6)
    find = finder(rules_for(None), None)
    start = time.process_time()
    assert min(len(m) for m in find(texts).field("matches").to_pylist()) > 40
    assert time.process_time() - start < 0.7


def test_many_tokens_are_told_from_what_is_left_soon(spark):
    from docloom.operators import redact

    texts = [f"{i} " + " ".join(f"user{k}@mail{k % 97}.org" for k in range(4000)) for i in range(4)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    redact.sanitize(docs.limit(1).selectExpr("'x' as text"), b"k", codes=["EMAIL"]).collect()
    start = time.time()
    rows = redact.sanitize(docs, b"k", codes=["EMAIL"]).selectExpr("verdict", "ledger.redaction_count as n").collect()
    assert [tuple(r) for r in rows] == [("pass", 4000)] * 4
    assert time.time() - start < 6


def test_short_codes_and_tokens_are_gone_through_once(spark):
    import pyarrow as pa

    from docloom.functions.finder import finder
    from docloom.functions.spans import rules_for
    from docloom.plans.catalog import audit

    find, texts = finder(rules_for(["USCC"]), None), pa.array(["[CN_ID_0123456789ABCDEF] " * 8000 + "91350100M000100Y43"] * 2)
    start = time.process_time()
    assert find(texts).field("n").to_pylist() == [1, 1]
    assert time.process_time() - start < 0.4
    cards = [("a", " now ".join(f"{4111111111111111 + k}" for k in range(4000))) for _ in range(4)]
    docs = spark.createDataFrame([*cards, ("b", "91350100M000100Y43 a@b.com")], "source string, text string")
    audit(docs.limit(0), None).collect()
    start = time.time()
    got = {(r.source, r.entity): (r.found, r.residual) for r in audit(docs, None).collect()}
    assert got == {("a", "BANK_CARD"): (16000, 0), ("b", "USCC"): (1, 0), ("b", "EMAIL"): (1, 0)}
    assert time.time() - start < 6
