"""Responses of single connectors."""

from __future__ import annotations

import json

import pytest

from docloom.operators import federate

CASES = {
    "yuandian": ({"data": [{"ftmc": "条", "fgmc": "法", "content": "c", "fbrq": "2020"}]}, ("条", "法", "china_mainland")),
    "pkulaw": ({"result": {"content": [{"title": "t", "citation": "c"}]}}, ("t", "c", "china_mainland")),
    "qcc": ({"result": {"content": [{"type": "text", "text": json.dumps({"企业名称": "公司", "creditCode": "X"}, ensure_ascii=False)}]}}, ("公司", "X", "china_mainland")),
    "fyopen": ({"data": [{"title": "t", "citation": "c"}, {"citation": "none"}]}, ("t", "c", "china_mainland")),
    "sec_edgar": ({"hits": {"hits": [{"_source": {"display_names": ["Firm"], "adsh": "1"}}]}}, ("Firm", "1", "united_states")),
    "firecrawl": ({"success": True, "data": [{"title": "t", "url": "u"}]}, ("t", None, "asked")),
    "vaquill": ({"results": [{"title": "t", "id": "9"}]}, ("t", "9", "united_states")),
    "opencorporates": ({"results": {"companies": [{"company": {"name": "n", "company_number": "7", "jurisdiction_code": "gb"}}]}}, ("n", "7", "gb")),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_one_result(spark, name):
    body, want = CASES[name]
    rows = federate.parsed(spark.createDataFrame([(json.dumps(body),), ("no json",), (None,)], "body string"), name, asked="asked").collect()
    assert [(r.title, r.citation, r.jurisdiction) for r in rows] == [want]


def test_failed_and_nested_responses(spark):
    failed = spark.createDataFrame([(json.dumps({"success": False, "data": [{"title": "t"}]}),)], "body string")
    assert federate.parsed(failed, "firecrawl").count() == 0
    many = json.dumps({"result": {"content": [{"type": "text", "text": json.dumps([{"name": "a"}, {"name": "b"}])}, {"name": "c"}]}})
    assert [r.title for r in federate.parsed(spark.createDataFrame([(many,)], "body string"), "qcc").orderBy("pos").collect()] == ["a", "b", "c"]
