"""Every detector on texts that hold its identifier and on texts that nearly do; the redaction chain over all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions.entities import ENTITIES, RULES
from docloom.operators import redact
from docloom.operators.detect import counts_by, detect

CARD, ID, CODE = "4111111111111111", "11010519491231002X", "91350100M000100Y43"

#: text -> (entity, matched text), in the order of their places
FOUND = {
    "Juristic ID No. 0105536000315 end": [("TH_JURISTIC", "0105536000315")],
    "法人登记号：0105536000315。": [("TH_JURISTIC", "0105536000315")],
    "Tax ID No 0105536000315 end": [("TH_TAXID", "0105536000315")],
    "泰国税号：0105536000315。": [("TH_TAXID", "0105536000315")],
    "证件：军字第2001001号在此": [("MILITARY_ID", "军字第2001001号")],
    "护照号码：G12345678。": [("PASSPORT", "G12345678")],
    f"身份 {ID} 完": [("CN_ID", ID)],
    "身份 110105-19491231-002X 完": [("CN_ID", "110105-19491231-002X")],
    "１１０１０５１９４９１２３１００２Ｘ": [("CN_ID", "１１０１０５１９４９１２３１００２Ｘ")],
    f"代码 {CODE} 完": [("USCC", CODE)],
    "call 138 1234 5678 now": [("CN_MOBILE", "138 1234 5678")],
    "call 13812345678 now": [("CN_MOBILE", "13812345678")],
    f"card {CARD} now": [("BANK_CARD", CARD)],
    "card 4111 1111 1111 1111 now": [("BANK_CARD", "4111 1111 1111 1111")],
    "tel 010-62345678 now": [("LANDLINE", "010-62345678")],
    "host 192.168.10.1 up": [("IP", "192.168.10.1")],
    "mail a.b+c@d-e.org, x@y.co": [("EMAIL", "a.b+c@d-e.org"), ("EMAIL", "x@y.co")],
    "doc E12345678 and EA1234567": [("PASSPORT", "E12345678"), ("PASSPORT", "EA1234567")],
    "permit H1234567890 here": [("HK_MO_PERMIT", "H1234567890")],
    "香港入境许可证：HK1234567。": [("HK_MO_PERMIT", "HK1234567")],
    "住址广东省深圳市南山区科技路12号": [("ADDRESS", "住址广东省深圳市南山区科技路12号")],
    "Macau 1234567(8) card": [("HK_MO_PERMIT", "1234567(8)")],
    "车牌 澳A1234 停": [("PLATE", "澳A1234")],
    "MST: 0101234567-001 end": [("CN_TAX_ID", "0101234567-001")],
    "TIN: 123-456-789-000 end": [("CN_TAX_ID", "123-456-789-000")],
    "NPWP: 01.234.567.8-901.234 end": [("CN_TAX_ID", "01.234.567.8-901.234")],
    "permit C12345678 here": [("HK_MO_PERMIT", "C12345678")],
    "台胞证号码：12345678。": [("TW_PERMIT", "12345678")],
    "律师执业证号：11101201010123456。": [("LAWYER_NO", "11101201010123456")],
    "车牌 京A12345 停": [("PLATE", "京A12345")],
    "微信号：lawyer_2020 加": [("WECHAT", "lawyer_2020")],
    "id A123456(7) ok": [("HK_ID", "A123456(7)")],
    "nric S1234567D ok": [("SG_NRIC", "S1234567D")],
    "ic 900101-14-5678 ok": [("MY_ID", "900101-14-5678")],
}
NOT_FOUND = [
    "Juristic ID No. 010553600031", "军字第201号", "x192.168.10.1", "192.168.10.1.5", "256.1.1.1", "a@b", "@c.org", "E1234567", "H123456789", "S1234567", "S1234567DX", "900101-14-567", "901301-14-5678",
    "call 12812345678 now", "call x13812345678", "4111x1111", "nothing here at all", "", "京A1", "A123456(77)",
]


@pytest.fixture(scope="module")
def found(spark):
    texts = [*FOUND, *NOT_FOUND]
    rows = detect(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), most=None).collect()
    return {texts[r.i]: [(m.entity, m.text) for m in r.matches] for r in rows}


def test_each_identifier_is_found_where_it_is(found):
    for text, want in FOUND.items():
        assert set(want) <= set(found[text]), (text, found[text])


def test_what_is_nearly_an_identifier_is_not(found):
    assert {t: found[t] for t in NOT_FOUND if found[t]} == {}


def test_every_class_with_a_rule_has_a_case():
    assert {r.code for r in RULES} - {e for w in FOUND.values() for e, _ in w} <= {"LEGACY_ID", "BANK_ACCOUNT"}
    assert {r.code for r in RULES} <= set(ENTITIES)


def test_labelled_accounts_and_old_ids(spark):
    rows = detect(spark.createDataFrame([("身份证号：110105491231002。",), ("账号：6222 0212 3456 7890 12 完",)], "text string"), most=None).collect()
    assert ("LEGACY_ID", "110105491231002") in {(m.entity, m.text) for m in rows[0].matches}
    assert {"BANK_ACCOUNT", "BANK_CARD"} & {m.entity for m in rows[1].matches}


def test_counts_by_entity(spark):
    docs = spark.createDataFrame([("a", "x@y.org and x@y.org"), ("a", f"card {CARD}"), ("b", None), ("b", "10.0.0.1")], "source string, text string")
    got = {(r.source, r.entity): r.found for r in counts_by(detect(docs, codes=["EMAIL", "IP", "BANK_CARD"]), "source").collect()}
    assert got == {("a", "EMAIL"): 2, ("a", "BANK_CARD"): 1, ("b", "IP"): 1}


def test_all_identifiers_go_and_come_back(spark):
    key = redact.scoped_key("secret", "1", "2")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(FOUND)], "i int, text string")
    done = redact.redact(detect(docs), key).withColumn("vault", redact.mapping(F.col("applied")))
    rows = done.select("i", "text", "redacted", "applied", redact.restore(F.col("redacted"), F.col("vault")).alias("back")).collect()
    for r in rows:
        assert r.back == r.text
        assert all(a.original not in r.redacted for a in r.applied), r.redacted
        assert r.applied and all(a.token.startswith(f"[{a.entity}_") for a in r.applied)
        assert [(a.start, a.end) for a in r.applied] == sorted((a.start, a.end) for a in r.applied)
        assert all(r.text[a.start : a.end] == a.original for a in r.applied)
