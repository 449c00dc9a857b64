"""SQL functions agree with the column functions and the detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import checksums as C
from docloom.functions import sqlfunctions
from docloom.operators.detect import detect
from docloom.operators.retrieve import tokens


def test_scalars(spark):
    assert "cjk_tsquery" in sqlfunctions.register(spark)
    cases = ["11010519491231002X", "11010519491231002x", "110105194912310021", "110105194902300021", "91350100M000100Y43", "91350100M000100Y44", "4111111111111111", "4111111111111112", "", "法院 Court-2", None, "A1"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    df.createOrReplaceTempView("cases")
    got = spark.sql("select s, cn_id_valid(s) a, credit_code_valid(s) b, credit_code_shape(s) c, card_valid(s) d, cjk_tokens(s) e, cjk_tsquery(s) f from cases")
    want = df.select("s", C.resident_id_valid(F.col("s")).alias("a"), C.credit_code_valid(F.col("s")).alias("b"), C.credit_code_shape(F.col("s")).alias("c"), (C.card_shape(F.col("s")) & C.luhn(F.col("s"))).alias("d"), tokens(F.col("s")).alias("e"), F.array_join(tokens(F.col("s")), " <-> ").alias("f"))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    assert spark.sql("select cjk_tsquery('质保金 ok')").first()[0] == "质 <-> 保 <-> 金 <-> ok"
    assert [r[0] for r in spark.sql("select egress_admission(x) from values ('sanitized'), ('never'), ('pending') as t(x)").collect()] == ["redacted", "original", "refuse"]


def test_table_function(spark):
    sqlfunctions.register(spark)
    rows = [(1, "mail a@b.org, ip 10.0.0.1 and 1.2.3.4.5, tel 010-62345678"), (2, "S1234567D xS1234567D A123456(7)"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    df.createOrReplaceTempView("texts")
    got = {tuple(r) for r in spark.sql("select id, m.entity, m.start, m.end, m.value from texts, lateral identifiers(text) as m").collect()}
    codes = {c for c, *_ in sqlfunctions._PLAIN}
    found = detect(df, codes=codes, most=None).select("id", F.explode_outer("matches").alias("m")).where("m is not null")
    assert got == {(r.id, r.m.entity, r.m.start, r.m.end, r.m.text) for r in found.collect()} and len(got) == 5
