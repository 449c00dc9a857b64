from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import chunk, cite, evaluate, federate, govern, retrieve
from docloom.sources import extract
from docloom.streaming import loops


def test_chunks_by_bytes():
    small = "a" * 200
    assert chunk.chunks(f"{small}\n\n{small}\n\n{small}\n\ntail") == [f"{small}\n\n{small}\n\n{small}", "tail"]
    sentence = "x" * 99 + "."
    out = chunk.chunks(sentence * 40)
    assert all(500 <= len(c) <= 1500 for c in out) and "".join(out).replace(" ", "") == sentence * 40
    han = "汉" * 800
    assert chunk.chunks(han) == [han]  # no stop it knows: one chunk over the bound
    assert chunk.chunks(" \n\n ") == [] and chunk.chunks("") == []
    assert chunk.sentences("Short. " * 3 + "e" * 60 + "! Rest") == ["Short. Short. Short. " + "e" * 60 + "!", "Rest"]


def test_chunk_table(spark):
    rows = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in chunk.chunk(rows).collect()] == [(1, 0, "one")]


def test_gate_stands_before_the_limit(spark):
    rows = spark.createDataFrame([(i, 0, f"c{i}", 1, 1, lv, st, [1.0, float(i)]) for i, (lv, st) in enumerate([("T1", "sanitized"), ("T4", "never"), (None, "never"), ("T3", "pending"), ("T2", "never"), ("T1", None)])],
                                 "document_id long, chunk_index int, content string, tenant_id long, matter_id long, data_level string, sanitization_state string, embedding array<double>")
    top = retrieve.semantic(retrieve.gated(rows, 1), [1.0, 0.0], 10)
    assert [r.document_id for r in top.collect()] == [0, 4]
    assert {r.document_id for r in retrieve.gated(rows, 1, top="t4").collect()} == {0, 1, 2, 4}
    assert "sanitization_state" in retrieve.gated(rows, 1)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        retrieve.gated(rows, 1, top="T9")
    assert retrieve.gated(rows, 2).count() == 0


def test_phrase_and_merge(spark):
    rows = spark.createDataFrame([(1, 0, "the red fox", [1.0, 0.0]), (2, 0, "red the fox", [0.0, 1.0]), (3, 0, "合同纠纷 案", [0.5, 0.5])], "document_id long, chunk_index int, content string, embedding array<double>")
    assert [r.document_id for r in retrieve.lexical(rows, "Red fox", 5).collect()] == [1]
    assert [r.document_id for r in retrieve.lexical(rows, "合同", 5).collect()] == [3]
    out = retrieve.merged(retrieve.semantic(rows, [1.0, 0.0], 3), retrieve.lexical(rows, "red fox", 3), 3, budget=15).orderBy("position").collect()
    assert out[0].document_id == 1 and out[0].score == pytest.approx(0.8) and sum(len(r.content) for r in out) == 15
    assert retrieve.hybrid(rows, "zebra", [1.0, 0.0], 3).count() == 0
    assert [r.document_id for r in retrieve.hybrid(rows, "纠纷", [1.0, 0.0], 3).orderBy("rank").collect()][0] == 3
    assert retrieve.query_terms("the 合同a of it") == ["the", "合", "同"]


def test_hybrid_searches_whole_texts_for_each_query(spark):
    far = "\n\n".join([f"nothing {i} " * 60 for i in range(3)] + ["the red fox"])
    chunks = chunk.chunk(spark.createDataFrame([(1, "blue"), (2, far), (3, "green"), (4, " ")], "document_id long, text string"), "document_id")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1]), (4, [1.0, 0.0]), (5, None), (6, [0.0, 0.0])], "document_id long, embedding array<double>")
    queries = vectors.where("document_id in (1, 2, 6)").select(F.col("document_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in retrieve.hybrid_each(chunks, vectors, "red fox", queries, 4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.document_id, r.chunk_index, r.matched, r.score))
    assert got[1][:2] == [(2, 3, True, 0.2), (1, 0, False, 0.6)]
    assert got[2] == [(2, 3, True, 0.8)] + [(2, i, False, 0.6) for i in range(3)]
    assert got[6] == [(2, 3, True, 0.2)]


def test_top_k_of_each_query_is_that_of_one(spark):
    rows = spark.range(0, 300, 1, 3).select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), F.array(*[(F.xxhash64(F.col("id") % 40, F.lit(i)) % 9).cast("double") for i in range(3)]).alias("embedding"))
    queries = rows.where("document_id % 50 = 0").select(F.col("document_id").alias("query_id"), F.col("embedding").alias("q"))
    each = retrieve.semantic_each(rows, queries, 7, at_once=4).collect()
    for q in queries.collect():
        one = [(r.document_id, r.score) for r in retrieve.semantic(rows, list(q.q), 7).collect()]
        assert sorted(((r.document_id, r.score) for r in each if r.query_id == q.query_id), key=lambda x: (-x[1], x[0])) == one


def test_html(spark):
    # "<b) {}</script>" is one tag named b, as a tag runs to the next ">", so code goes on to the end;
    # "< b" is a tag that is never closed, one blank
    cases = {"<p>a</p>": " a ", '<a title=">">x</a>': " x ", "a<!-- > -->b": "a b", "<script>if (a<b) {}</script>t": "  ", "&amp;": "&amp;", "<!DOCTYPE html>x": " x", "a < b": "a  "}
    rows = spark.createDataFrame([(k,) for k in cases], "h string")
    for r in rows.select("h", extract.html_text(F.col("h")).alias("t")).collect():
        assert r.t == cases[r.h], r.h


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_office(spark):
    good = _zip({"word/document.xml": "<w:p><w:t>Hello</w:t><w:t>world &amp; co</w:t></w:p>", "docProps/core.xml": "<dc:title>T</dc:title>"})
    text, bad = extract.office_text(good)
    assert (text, bad) == ("Hello world & co\ntitle: T", False)
    assert extract.office_text(b"no zip")[1] and extract.office_text(_zip({"word/other.xml": "<w:t>x</w:t>"}))[1]
    files = spark.createDataFrame([("a.docx", bytearray(good)), ("b.txt", bytearray(b"hi")), ("c.txt", bytearray(b"\xff")), ("d.doc", bytearray(b"")), ("e.pdf", bytearray(b"")), ("f.HTM", bytearray(b"<p>x</p>"))], "path string, content binary")
    got = {r.path: (r.text, r.incomplete, r.error) for r in extract.extract(files).collect()}
    assert got["b.txt"] == ("hi", False, None) and got["c.txt"] == (None, True, None) and got["d.doc"][2] == "unsupported" and got["e.pdf"][2] == "needs_ocr"
    assert got["a.docx"][0].startswith("Hello world") and got["f.HTM"][0] == " x "


def test_boxes(spark):
    r = extract.boxes(spark.createDataFrame([([[3, 1], [9, 2], [8, 7], [2, 6]],)], "box array<array<int>>")).first()
    assert (r.x, r.y, r.width, r.height) == (2, 1, 7, 6)


def test_citations(spark):
    doc = "00000000-0000-0000-0000-000000000001"
    turns = spark.createDataFrame([(1, f'x <CITATIONS>[{{"ref": 1, "document_id": "{doc}", "page": 2, "verbatim": "ＡＢ c"}}, {{"ref": 2, "document_id": "bad"}}]</CITATIONS>'), (2, "<CITATIONS>[broken</CITATIONS>"), (3, "none")], "turn_id int, text string")
    rows = cite.extract(turns)
    assert [(r.turn_id, r.ref) for r in rows.collect()] == [(1, 1)]
    bodies = spark.createDataFrame([(doc, "x a B\nC y")], "document_id string, body string")
    assert cite.verify(rows, bodies).first().outcome == "found"
    assert cite.verify(rows, bodies.limit(0)).first().outcome == "source_unavailable"
    assert {r.turn_id: r.gate for r in cite.gates(turns, cite.verify(rows, bodies)).collect()} == {1: "satisfied", 2: "satisfied", 3: "satisfied"}


def test_find(spark):
    text = "\n".join(["zero"] * 39 + ["End of page"] + ["next Page here"])
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.page, r.start) for r in cite.find_pages(rows, "page").orderBy("page").collect()] == [(1, 39 * 5 + 7), (2, 5)]
    assert [(r.line, r.text) for r in cite.find_lines(rows, "PAGE").orderBy("line").collect()] == [(40, "End of page"), (41, "next Page here")]


def test_auc_and_median(spark):
    rows = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "y int, s double")
    assert evaluate.auc(rows, "y", "s").first().auc == pytest.approx(0.875)
    assert evaluate.auc(rows.where("y = 1"), "y", "s").first().auc != evaluate.auc(rows.where("y = 1"), "y", "s").first().auc
    assert spark.range(1).select(evaluate.upper_median(F.array(*map(F.lit, [4, 1, 3, 2]))).alias("m")).first().m == 3


def test_federation(spark):
    a = federate.parsed(spark.createDataFrame([('{"data": [{"ftmc": "法", "fgmc": "c"}, {"content": "x"}]}',), ("oops",)], "body string"), "yuandian")
    assert [(r.title, r.citation, r.source_level) for r in a.collect()] == [("法", "c", "auxiliary_db")]
    assert len(federate.CONNECTORS) == 11


def test_versions_and_formats(spark):
    r = spark.range(1).select(*[govern.format_of(F.lit(n)).alias(k) for k, n in (("a", "x.MD"), ("b", "x.tar.jpeg"), ("c", "x.doc"), ("d", "none"))]).first()
    assert tuple(r) == ("markdown", "jpeg", None, None)


def test_loops_batch_and_stream_agree(spark, tmp_path):
    rows = [("t", i, "tool", h) for i, h in enumerate(["a", "b", "a", "a", "a", "a", "c"] + [f"x{i}" for i in range(20)] + ["a", "a", "a"])]
    df = spark.createDataFrame(rows, "thread_id string, seq long, tool string, hash string")
    batch = {r.seq: r.action for r in loops.repeated(df).collect()}
    assert [batch[i] for i in range(7)] == [None, None, None, "warn", None, "stop", None] and batch[29] == "warn"
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = loops.detect_stream(stream, ttl_ms=None).writeStream.format("memory").queryName("loops_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {r.seq: r.action for r in spark.table("loops_out").collect()}
    assert {k: v for k, v in got.items() if k < 7} == {k: v for k, v in batch.items() if k < 7} and got[29] is not None


def test_event_stream(spark, tmp_path):
    df = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'a' as event_type union all select timestamp'2024-01-01 02:10:00', 'a'")
    df.write.parquet(str(tmp_path / "ev"))
    out = loops.event_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev")))
    q = out.writeStream.format("memory").queryName("ev_out").option("checkpointLocation", str(tmp_path / "ck2")).outputMode("update").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert spark.table("ev_out").count() == 2
