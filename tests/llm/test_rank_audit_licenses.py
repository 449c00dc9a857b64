"""Ranked search, filter lattice and license scans against brute force."""

from __future__ import annotations

import math
import random
import re
from itertools import permutations

import pytest

from docloom.llm import lattice, licenses, rankindex

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, score string, lang string"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def ranked(docs: list[tuple], items: list[tuple], k: int) -> set[tuple]:
    terms = [(d[0], TERM.findall(lower(d[1]))) for d in docs]
    n, total = sum(1 for _, t in terms if t), sum(len(t) for _, t in terms)
    df: dict[str, int] = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = set()
    for item, text in items:
        scores = []
        for i, t in terms:
            m = 25 + (75 * len(t) * n) // max(total, 1)
            score = 0
            for x in TERM.findall(lower(text)):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i if i is not None else 1 << 62, i, score))
        scores.sort(key=lambda r: r[:2])
        out |= {(item, rank, i, score) for rank, (_, _, i, score) in enumerate(scores[:k], 1)}
    return out


def test_terms_are_cut_at_texts_and_separators():
    import pyarrow as pa

    texts = pa.array(["Ab_c", None, "d", "eé X9-", "", "\x00z"])
    ((lo, hi, data, row),) = rankindex.slices(texts, 1 << 20, 100)
    terms, n = rankindex.term_runs(data, row)
    assert (lo, hi, terms.to_pylist(), n.tolist()) == (0, 6, ["ab", "c", "d", "eé", "x9", "z"], [2, 0, 1, 2, 0, 1])


@pytest.mark.parametrize(("k", "shard_docs", "pairs", "at_once"), [(10, 4096, 1 << 21, 200_000), (3, 16, 64, 20)])
def test_search_matches_brute_force(spark, monkeypatch, k, shard_docs, pairs, at_once):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "日本", "THE", "the"]
    prose = lambda n: " ".join(rng.choices(vocabulary, weights=[1 + 300 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, prose(rng.randint(1, 120)), "own", "en") for i in range(150)]
    docs += [(1000 + i, docs[7][1], "copies tie", None) for i in range(40)]
    docs += [(200, None, None, None), (201, "", None, None), (202, "-- !", None, None), (None, docs[7][1], "null id", None), (3, docs[7][1], "repeats an id", None), (203, prose(30_000), None, None)]
    items = [(i, prose(rng.randint(1, 25))) for i in range(12)] + [(50, docs[7][1]), (51, None), (52, "unseen words"), (53, "日本 日本 the"), (None, "w5 w6")]
    monkeypatch.setattr(rankindex, "SHARD_DOCS", shard_docs)
    monkeypatch.setattr(rankindex, "PAIRS", pairs)
    scratch = rankindex.Scratch(spark, "t")
    index = rankindex.RankIndex.build(spark.createDataFrame(docs, DOCS), scratch.folder("index"))
    got = [tuple(r) for r in index.search(spark.createDataFrame(items, "item_id long, text string"), k=k, at_once=at_once).collect()]
    want = ranked(docs, items, k)
    assert len(got) == len(set(got)) == len(want)
    assert set(got) == want


def test_bounds_hold_and_the_second_level_is_read_last(spark):
    import numpy as np

    tf, n = np.arange(1, 400), np.arange(400, 1, -1)
    share = rankindex.shares(tf, n, 1000, 90_000)
    impact = -(-share // rankindex.STEP)
    assert impact.max() <= 255 and (impact * rankindex.STEP >= share).all() and ((impact - 1) * rankindex.STEP < share).all()
    scratch = rankindex.Scratch(spark, "t")
    index = rankindex.RankIndex.build(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), scratch.folder("index"))
    assert "tf" not in index.read("docs", "impacts")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_search_of_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rankindex.rank(none, items).count() == 0
    assert rankindex.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert rankindex.rank(docs, items.limit(0)).count() == 0
    # in two equal documents a term has the weight floor(1000 * ln(6/5))
    assert [tuple(r)[:3] for r in rankindex.rank(docs, items).collect()] == [(1, 1, 1), (1, 2, 1)]


def audited(docs: list[tuple], labels: list[tuple]) -> dict:
    first: dict[str, int] = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    rows = []
    for i, text, _, lang in docs:
        t = text or ""
        w = SPACE.findall(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if bad}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((lang or "", fails, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            for s, f in enumerate(p):
                alive = [r for r in own if not r[1] & set(p[:s])]
                gone = [r for r in alive if f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(p), s + 1] = [len(alive) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (q, p, s), v in out.items():
            if q == part:
                v.append(shapley[p[s - 1]])
    return out


def test_lattice_matches_orders_one_by_one(spark, monkeypatch):
    from docloom.llm import runtime

    monkeypatch.setattr(runtime, "HOT", 5)
    rng = random.Random(3)
    prose = lambda n, v: " ".join(f"w{rng.randrange(v)}" for _ in range(n))
    docs = [(i, rng.choice(["", "A B C ", "# "]) + prose(rng.choice([5, 199, 200, 260]), rng.choice([20, 5000])), "own", rng.choice(["en", "de", None, ""])) for i in range(80)]
    docs += [(100 + i, docs[0][1], None, "en") for i in range(1500)] + [(90, None, None, "en"), (91, "", None, None), (91, "", None, "xx"), (None, docs[0][1], None, "en"), (None, None, None, None)]
    docs += [(95, "Äé" * 100 + " A", None, "en"), (96, "\x0b a b \x0c " * 300, None, "fr"), (97, prose(20_000, 30_000), None, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 200, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    got = lattice.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audited(docs, labels)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want
    assert len(got) == len(want) == 600 * 5


def test_lattice_of_an_empty_table(spark):
    none = lattice.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert none.count() == 0


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def scanned(text: str | None, k: int = 3, slack: int = 3, least: float = 0.7) -> tuple:
    w = split_words(text)
    base = [(i, label) for i in range(len(w)) for phrase, label in licenses.BASE if w[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in base}, 0.0
    for label, body in licenses.TEMPLATES:
        t = split_words(body)
        diagonals: dict[int, list[int]] = {}
        for p in range(len(w) - k + 1):
            for q in range(len(t) - k + 1):
                if w[p : p + k] == t[q : q + k]:
                    diagonals.setdefault(p - q, []).append(q)
        groups: list[list[int]] = []
        for d in sorted(diagonals):
            if groups:
                x = groups[-1][-1]
                if d - x <= slack and min(diagonals[d]) + d - max(diagonals[x]) - x <= len(t) and min(diagonals[x]) + x - max(diagonals[d]) - d <= len(t):
                    groups[-1].append(d)
                    continue
            groups.append([d])
        for g in groups:
            places = {q + j for d in g for q in diagonals[d] for j in range(k)}
            at = {q + d + j for d in g for q in diagonals[d] for j in range(k)}
            if len(places) / len(t) >= least and len(at) / (max(at) - min(at) + 1) >= least:
                labels.add(label)
                best = max(best, len(places) / len(t))
    own = sorted({x for _, x in base})
    return len(w), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(sorted(labels)), 1.0 if base else best


def test_licenses_match_brute_force(spark):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice("of the and under License software version apache licensed by cc mit work".split()) for _ in range(n))
    rows = [(i, prose(rng.randint(0, 200)), "own", "en") for i in range(60)]
    for i, (_, body) in enumerate(licenses.TEMPLATES * 4):
        t = body.split()
        for _ in range(i // len(licenses.TEMPLATES)):  # whole, then with words changed, added and dropped
            j = rng.randrange(len(t))
            t[j : j + rng.randint(0, 1)] = rng.choice([[], ["other"], ["two", "words"]])
        rows.append((100 + i, f"{prose(rng.randint(0, 30))} {'. '.join([' '.join(t)] * rng.randint(1, 2))} {prose(rng.randint(0, 30))}", None, None))
    rows += [(None, "CC-BY and Apache  License", None, None), (None, None, None, None), (7, "", None, None), (7, "--", None, None), (7, "MIT License MIT LICENSE", None, None), (8, "lİcense Straße mit license", None, None), (9, f"{prose(30_000)} mit license", None, None)]
    got = licenses.scan(spark.createDataFrame(rows, DOCS)).collect()
    key = lambda r: tuple(str(x) for x in r)
    mine = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got), key=key)
    assert mine == sorted(((i, *scanned(t)) for i, t, *_ in rows), key=key)
    assert {"bsd", "lgpl", "mpl", "isc"} <= {x for r in got for x in r.labels.split(",")}
    for r in got:
        assert {x["label"] for x in r.spans or []} | set(filter(None, r.base_labels.split(","))) == set(filter(None, r.labels.split(",")))


def test_licenses_of_an_empty_table_and_python_free_plan(spark):
    empty = licenses.scan(spark.createDataFrame([], DOCS))
    assert empty.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and empty.count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = licenses.hits(docs, licenses.places(licenses.template_table(spark), 3), licenses.Scratch(spark, "t"), 3, "doc_id", "text")
    assert plan.where("base is not null").count() > 0
