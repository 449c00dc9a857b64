"""Packages: damage, tracked edits, acceptance, and what is written is read back."""

from __future__ import annotations

import io
import json
import os
import random
import re
import zipfile

import pytest

from docloom.sources import extract, packages
from docloom.sources.packages import Package, accepted, differences, tracked_edit


def package(parts: dict[str, str], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as box:
        for n, x in parts.items():
            box.writestr(n, x)
    return out.getvalue()


PARTS = {"word/document.xml": "<w:p><w:r><w:t>Body text</w:t></w:r></w:p>", "docProps/core.xml": "<dc:title>T</dc:title>"}


def test_whole_packages():
    assert extract.office_text(package(PARTS)) == ("Body text\ntitle: T", False)
    inner = package({"a.txt": "x"}, stored=True)  # a package inside a member is no hidden member
    out = io.BytesIO(package(PARTS))
    with zipfile.ZipFile(out, "a") as box:
        box.writestr("word/embeddings/one.bin", inner, zipfile.ZIP_STORED)
    assert not Package(out.getvalue()).incomplete


def test_damage_is_incomplete_and_never_raises():
    good = package(PARTS, stored=True)
    bad_meta = good.replace(b"<dc:title>T", b"<dc:title>U", 1)
    assert extract.office_text(bad_meta) == ("Body text", True)
    bad_body = good.replace(b"Body text", b"Xody text", 1)
    assert extract.office_text(bad_body) == ("\ntitle: T", True)
    # a member that the directory does not list
    hidden, at = package({"word/header9.xml": "<w:t>secret</w:t>"}, stored=True), good.index(b"PK\x01\x02")
    shift = hidden[: hidden.index(b"PK\x01\x02")]
    end = bytearray(good[at:])
    tail = end.index(b"PK\x05\x06")
    end[tail + 16 : tail + 20] = (at + len(shift)).to_bytes(4, "little")
    assert Package(bytes(good[:at] + shift + end)).incomplete
    renamed = bytearray(good)
    renamed[good.index(b"word/document.xml")] = ord("W")  # in the local header alone
    assert Package(bytes(renamed)).incomplete
    with pytest.warns(UserWarning):
        twice = io.BytesIO(good)
        with zipfile.ZipFile(twice, "a") as box:
            box.writestr("word/document.xml", "<w:t>other</w:t>")
    assert extract.office_text(twice.getvalue())[1]
    bomb = Package(package({"word/document.xml": "0" * 5000}), most=1000)
    assert bomb.read("word/document.xml") is None and bomb.incomplete
    rng = random.Random(1)
    for _ in range(300):
        torn = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            torn[rng.randrange(len(torn))] = rng.randrange(256)
        extract.office_text(bytes(torn[: rng.randint(0, len(torn))]))
        extract.simple_docx(bytes(torn))


def test_a_damaged_file_does_not_stop_the_job(spark):
    good = package(PARTS, stored=True)
    files = [("a.docx", bytearray(good)), ("b.docx", bytearray(good.replace(b"<dc:title>T", b"<dc:title>U", 1))), ("c.docx", bytearray(b""))]
    got = {r.path: r.incomplete for r in extract.extract(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a.docx": False, "b.docx": True, "c.docx": True}


def longest_common(a: list[str], b: list[str]) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
    return best[-1][-1]


def test_differences_are_shortest():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = differences(a, b)
        assert "".join(t for k, t in d if k != "+") == "".join(a) and "".join(t for k, t in d if k != "-") == "".join(b)
        assert sum(len(t) for k, t in d if k == "=") == longest_common(a, b)
        assert all(x[0] != y[0] for x, y in zip(d, d[1:], strict=False))


def visible(xml: str, tag: str = "w:t") -> str:
    return "".join(re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", xml))


def test_edits_are_peers_of_runs():
    xml = '<w:p><w:r w:rsid="1"><w:rPr><w:b/></w:rPr><w:t>The party of the first part &amp; others shall pay.</w:t></w:r><w:del w:id="7"/></w:p>'
    out, why = tracked_edit(xml, "first part & others", "second part & nobody")
    assert why is None
    assert accepted(out).count("<w:t") == accepted(out).count("</w:t>") and visible(accepted(out)) == "The party of the second part &amp; nobody shall pay."
    assert visible(out, "w:delText") == "firstothers" and re.findall(r'w:id="(\d+)"', out) == ["8", "9", "10", "11", "7"]
    assert not re.search(r"<w:t(?:\s[^>]*)?>[^<]*<(?!/w:t>)", out)  # no markup inside a text node
    assert out.count("<w:b/>") == out.count("<w:r ")  # each piece keeps the properties
    again, why = tracked_edit(out, "shall pay", "may pay")
    assert why is None and visible(accepted(again)) == "The party of the second part &amp; nobody may pay."


def test_edits_that_cannot_be_made():
    xml = "<w:p><w:r><w:t>one two</w:t></w:r><w:r><w:t>three two</w:t></w:r><w:tbl/></w:p>"
    assert tracked_edit(xml, "four", "x") == (xml, "not found")
    assert tracked_edit(xml, "two", "x", "three ", "!") == (xml, "not found in this context")
    assert tracked_edit(xml, "w:tbl", "x")[1] == "not inside a text node"
    assert tracked_edit("<w:t>free</w:t>", "free", "x")[1] == "text node without a run"
    assert tracked_edit(xml, "", "x")[1] == "nothing to find"
    out, why = tracked_edit(xml, "two", "2", "three ", "")
    assert why is None and visible(accepted(out)) == "one twothree 2"


def test_nested_text_nodes_become_plain():
    nested = '<w:p><w:r><w:t>head <w:ins w:id="1"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>old</w:delText></w:r></w:del> tail</w:t></w:r><w:tbl></w:tbl></w:p>'
    assert accepted(nested) == "<w:p><w:r><w:t>head new tail</w:t></w:r><w:tbl></w:tbl></w:p>"
    assert accepted("<w:t/><w:t>open <b>") == "<w:t/><w:t>open <b>"


STRUCTURE = {
    "title": "Deed", "landscape": True, "sections": [
        {"type": "heading", "level": 2, "text": "Terms <1>"}, {"type": "paragraph", "text": "A & B"}, {"type": "numbered_list", "items": ["one", "two"], "depth": 2}, {"type": "bullet_list", "items": ["x"]},
        {"type": "table", "headers": ["h"], "rows": [["c1"], ["c2"]]}, {"type": "page_break"}, {"type": "recital", "text": "WHEREAS"}, {"type": "signature_page", "parties": [{"name": "N", "role": "Buyer", "title": "Dr"}]}],
}


def test_written_packages_are_read_back(spark, tmp_path):
    packages.register(spark)
    rows = [(f"d{i}.docx", json.dumps({**STRUCTURE, "title": f"Deed {i}"})) for i in range(20)]
    spark.createDataFrame(rows, "name string, structure string").repartition(4).write.format("docx").mode("append").save(f"file://{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == sorted(n for n, _ in rows)
    got = {r.path.rsplit("/", 1)[1]: r for r in extract.extract(extract.read_files(spark, f"file://{tmp_path}/out")).collect()}
    assert len(got) == 20 and not any(r.incomplete for r in got.values())
    text = got["d3.docx"].text
    for x in ("Deed 3", "Terms <1>", "A & B", "(a)  one", "(b)  two", "• x", "c2", "WHEREAS", "Role: Buyer", "Title: Dr"):
        assert x in text
    done = packages.accept_packages(extract.read_files(spark, f"file://{tmp_path}/out")).collect()
    assert len(done) == 20 and extract.office_text(bytes(done[0].content))[1] is False
    spark.createDataFrame(rows[:1], "name string, structure string").write.format("docx").mode("overwrite").save(f"file://{tmp_path}/out")
    assert os.listdir(tmp_path / "out") == ["d0.docx"]


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    packages.register(spark)
    for bad in ([("a.docx", json.dumps(STRUCTURE)), ("b.docx", "{}")], [("a.docx", json.dumps(STRUCTURE)), ("a.docx", json.dumps(STRUCTURE))], [("../a.docx", json.dumps(STRUCTURE))]):
        with pytest.raises(Exception, match="Error|twice|same name"):
            spark.createDataFrame(bad, "name string, structure string").repartition(2).write.format("docx").mode("append").save(f"file://{tmp_path}/out")
        assert not os.path.isdir(tmp_path / "out") or os.listdir(tmp_path / "out") == []


def test_edits_of_a_column(spark):
    xml = "<w:r><w:t>pay the seller now</w:t></w:r>"
    rows = [(xml, "the seller", "a buyer"), (xml, "nobody", "x"), (None, "a", "b")]
    got = packages.edit_texts(spark.createDataFrame(rows, "x string, f string, r string"), "x", "f", "r").collect()
    assert [(r.refused, visible(r.accepted or "")) for r in got] == [(None, "pay a buyer now"), ("not found", "pay the seller now"), ("null", "")]


def test_edited_texts_are_handed_on_in_small_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"i": list(range(1000)), "x": ["<w:p><w:r><w:t>old text</w:t></w:r></w:p>"] * 999 + [None], "f": ["old"] * 1000, "r": ["new"] * 1000})
    got = list(packages.editor(["x", "f", "r"])([batch]))
    assert max(b.num_rows for b in got) <= packages.AT_ONCE < 1000
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["i"] for r in rows] == list(range(1000)) and rows[999]["refused"] == "null"
    assert all("new" in r["accepted"] and "old" not in r["accepted"] for r in rows[:999])
