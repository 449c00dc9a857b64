"""Visible text of web pages against a plain scan, and pages that once overflowed the stack."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.evaluate import auc
from docloom.sources.extract import html_text


def scanned(page: str) -> str:
    """The definition of ``html_text``, one character after the other."""
    out, i, raw = [], 0, False
    while i < len(page):
        if page[i] != "<":
            out.append("" if raw else page[i])
            i += 1
            continue
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = len(page) if end < 0 else end + 3
        elif page.startswith("<!", i):
            end = page.find(">", i)
            i = len(page) if end < 0 else end + 1
        else:
            first, quote, i = i + 1, "", i + 1
            while i < len(page) and (quote or page[i] != ">"):
                quote = ("" if page[i] == quote else quote) if quote else page[i] if page[i] in "'\"" else ""
                i += 1
            tag = page[first:i].lower()
            i += 1
            name = ""
            for c in tag.lstrip("/"):
                if not (c.isalnum() or c in ":-"):
                    break
                name += c
            if name in ("script", "style"):
                raw = not tag.startswith("/")
        out.append(" ")
    return "".join(out)


PIECES = ["text ", "a<b", "<p>", "</p>", "<!DOCTYPE x>", "<!-- c > -->", "<!--", "-->", '<a href=">">', "<a t='", "'", '"', "<script>", "</script>", "<STYLE x='>'>", "</style >", "<scripts>", "<script-x>", "<//script>", ">", "<", "&lt;", "<![CDATA[x]]>", "日本"]


def test_pages_match_a_plain_scan(spark):
    rng = random.Random(4)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", html_text(F.col("html")).alias("t")).collect()
    for r in rows:
        page = pages[r.i]
        assert r.t == (page if page is None else scanned(page)), page


@pytest.mark.parametrize("unit", ["x ", "<a ", "<a '", '"', "<!--", "<script>", "<script>a<b", "<p>t</p>"])
def test_a_megabyte_of_odd_markup(spark, unit):
    page = "<a " + unit * (1_000_000 // len(unit))
    got = spark.createDataFrame([(page,)], "html string").select(html_text(F.col("html")).alias("t")).first().t
    assert got == scanned(page)


def test_auc_of_many_distinct_scores(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 3), rng.randint(0, 1)) for _ in range(2000)] + [(None, 1)]
    wins = sum((p > n) + 0.5 * (p == n) for p, a in rows for n, b in rows if a == 1 and b == 0 and p is not None and n is not None)
    pos, neg = (sum(1 for s, y in rows if y == k and s is not None) for k in (1, 0))
    got = auc(spark.createDataFrame(rows, "s double, y int"), "y", "s").first()
    assert (got.positives, got.negatives, got.auc) == (pos, neg, pytest.approx(wins / pos / neg, abs=1e-6))
    assert auc(spark.createDataFrame([], "s double, y int"), "y", "s").first().positives is None
