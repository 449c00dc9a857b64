"""Language model, language mixtures, quality rules and embeddings against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import covertree, language, pitmanyor, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def lowered(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def tokens(text: str | None) -> list[str | None]:
    return [*lowered(text), None]


@pytest.mark.parametrize("sizes", [{}, {"frequent": 40, "bucket_tokens": 20_000}, {"frequent": 0}])
def test_base_scores_match_brute_force(spark, sizes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "the end"), (-1, None), (-2, ""), (-3, "unheard-of Straße"), (-3, "unheard-of Straße")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    total, kinds = sum(count.values()), len(count)
    got = pitmanyor.score(docs, **sizes).collect()
    key = lambda i, n: (i is None, i or 0, n)
    got.sort(key=lambda r: key(r.doc_id, r.n_tokens))
    rows.sort(key=lambda r: key(r[0], len(tokens(r[1]))))
    for r, (i, text) in zip(got, rows, strict=True):
        own = tokens(text)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held(i), len(own), sum(count[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in own), abs=1e-6)
        assert r.score < 0
    if not sizes:  # held-out perplexity is lower than the base's
        assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_probabilities_of_one_word_texts_sum_to_less_than_one(spark):
    """Texts of no, one and two known words are disjoint events."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    train = [(i, " ".join(rng.choices(words[:9], k=rng.randint(1, 3)))) for i in range(300)]
    tried = [""] + words + [f"{a} {b}" for a in words for b in words]
    docs = train + [(10_000 + i, t) for i, t in enumerate(tried)]
    # rows that train are told by their ids: those tried are all held out
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 == 2)
    others = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 != 2)
    docs = [(next(ids) if i >= 10_000 else next(others), t) for i, t in docs]
    for lexicon in (5, 100):
        got = pitmanyor.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=lexicon).where("held_out").collect()
        seen = [r for r in got if r.n_known == r.n_tokens]
        assert 0.2 < sum(10**r.score for r in seen) < 1


def table_counts(c: int, a: float, d: float) -> np.ndarray:
    """P(t) proportional to S_d(c, t) * a**t, by the recursion alone."""
    row = [0.0, 1.0]
    for n in range(1, c):
        row = [0.0] + [(row[t] * (n - d * t) if t <= n else 0.0) + row[t - 1] for t in range(1, n + 2)]
        top = max(row)
        row = [x / top for x in row]
    w = np.array([x * a**t for t, x in enumerate(row)])
    return w / w.sum()


@pytest.mark.parametrize(("c", "a", "d"), [(5, 0.3, 0.5), (40, 4.0, 0.8), (64, 0.01, 0.2)])
def test_small_dishes_are_seated_by_their_conditional(c, a, d):
    t = pitmanyor.seat_small(np.full(60_000, c), np.full(60_000, a), d, np.random.default_rng(1))
    want = table_counts(c, a, d)
    assert np.abs(np.bincount(t, minlength=c + 1) / 60_000 - want).max() < 0.01
    assert pitmanyor.mean_tables(a, d)[c] == pytest.approx((want * np.arange(c + 1)).sum(), rel=1e-6)


@pytest.mark.parametrize(("c", "a", "d"), [(80, 0.2, 0.7), (200, 3.0, 0.6), (100, 20.0, 0.5), (90, 500.0, 0.5)])
def test_metropolis_steps_keep_the_conditional_of_large_dishes(c, a, d):
    n, rng = 1500, np.random.default_rng(2)
    top, t, like = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(pitmanyor.DISCOUNTS)))
    pitmanyor.seat_large(np.full(n, c), np.full(n, a), d, rng, top, t, like, steps=150)
    want = table_counts(c, a, d)
    mean = (want * np.arange(c + 1)).sum()
    sd = math.sqrt((want * (np.arange(c + 1) - mean) ** 2).sum())
    assert abs(t.mean() - mean) < 0.15 * sd + 0.02
    assert t.std() == pytest.approx(sd, rel=0.15)
    assert ((top >= 1) & (top + t - 1 <= c)).all()


class Direct:
    """One customer at a time: lifted from a table at random and seated again, in both levels."""

    def __init__(self, pairs: list[tuple[int, int]], kinds: int, d: float, theta: float):
        self.d, self.theta, self.h, self.rng = d, theta, 1 / (kinds + 1), random.Random(3)
        self.seats: dict = {}
        self.pairs = pairs
        for u, w in pairs:
            self.add(u, w)

    def p(self, u: int | None, w: int) -> float:
        dishes = self.seats.get(u, {})
        c, t = sum(map(sum, dishes.values())), sum(map(len, dishes.values()))
        own = dishes.get(w, [])
        above = self.h if u is None else self.p(None, w)
        return (sum(own) - self.d * len(own) + (self.theta + self.d * t) * above) / (self.theta + c) if c else above

    def add(self, u: int | None, w: int) -> None:
        dishes = self.seats.setdefault(u, {})
        own = dishes.setdefault(w, [])
        t = sum(map(len, dishes.values()))
        fresh = (self.theta + self.d * t) * (self.h if u is None else self.p(None, w))
        x = self.rng.random() * (fresh + sum(own) - self.d * len(own))
        for i, n in enumerate(own):
            x -= n - self.d
            if x < 0:
                own[i] += 1
                return
        own.append(1)
        if u is not None:
            self.add(None, w)

    def lift(self, u: int | None, w: int) -> None:
        own = self.seats[u][w]
        i = self.rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if not own[i]:
            del own[i]
            if u is not None:
                self.lift(None, w)

    def sweep(self) -> None:
        for u, w in self.pairs:
            self.lift(u, w)
            self.add(u, w)


class Held:
    def __init__(self, value):
        self.value = value


def test_sampler_agrees_with_one_customer_at_a_time():
    import pyarrow as pa

    rng, kinds, d, theta = random.Random(8), 6, 0.4, 1.0
    tokens_ = [0]
    for _ in range(260):
        tokens_.append((tokens_[-1] + rng.choice([0, 1, 1, 1, 2])) % kinds if rng.random() < 0.8 else rng.randrange(kinds))
    pairs = list(zip(tokens_[:-1], tokens_[1:], strict=True))
    direct, want, rounds = Direct(pairs, kinds, d, theta), np.zeros((kinds, kinds)), 600
    for _ in range(100):
        direct.sweep()
    for _ in range(rounds):
        direct.sweep()
        want += np.array([[direct.p(u, w) for w in range(kinds)] for u in range(kinds)]) / rounds

    c = np.bincount(np.array(tokens_[:-1]), minlength=kinds)
    lex = pitmanyor.Lexicon(np.arange(kinds - 1).astype(np.uint64), c[:-1], int(c[-1]), len(pairs), 1)
    u, w = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    table = pa.table({"bucket": pa.array([0], pa.int32()), "size": pa.array([len(u)], pa.int32()), "u": [pitmanyor.packed(np.diff(u, prepend=0))], "w": [pitmanyor.packed(w)], "n": [pitmanyor.packed(np.ones(len(u)))]})
    from docloom.llm.pitmanyor import Root, gather, summed, sweep, unpacked

    state, root, gen = gather(table).to_batches()[0], Root(kinds, {}, kinds, (d, theta)), np.random.default_rng(1)
    p0, got, width = np.full(kinds, 1 / kinds), np.zeros((kinds, kinds)), 1 + len(pitmanyor.DISCOUNTS) * len(pitmanyor.STRENGTHS)
    for i in range(100 + rounds):
        (state,) = sweep(Held(lex), Held((p0, 1e-9, d, theta, np.zeros(kinds))), i, False)(iter([state]))
        (sums,) = summed(width + 2 * kinds)(iter([state.select(["sums"])]))
        by_word = np.zeros(width + 2 * kinds)
        by_word[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
        old = p0
        p0, _ = root.seat(np.rint(by_word[width : width + kinds]).astype(np.int64), 0.0, gen)
        if i >= 100:
            row = state.to_pylist()[0]
            uu, ww, n, t = np.cumsum(unpacked(row["u"], row["size"])), *(unpacked(row[k], row["size"]) for k in "wnt")
            pred = np.zeros((kinds, kinds))
            for x in range(kinds):
                m = uu == x
                pred[x] = (theta + d * t[m].sum()) / (theta + n[m].sum()) * p0
                pred[x, ww[m]] += (n[m] - d * t[m]) / (theta + n[m].sum())
            got += pred / rounds
    assert old.sum() < 1
    assert np.abs(got - want).max() < 0.01
    assert np.abs(got / want - 1).max() < 0.12


def test_discount_and_strength_are_recovered():
    """Seatings of simulated restaurants put the most likely discount and strength near the truth."""
    rng, d, theta = np.random.default_rng(4), 0.6, 3.0
    like, tables, customers = 0.0, [], []
    for _ in range(150):
        sizes: list[int] = []
        for i in range(120):  # one dish a table: each table is a dish of its own
            x = rng.random() * (theta + i)
            k = int(np.searchsorted(np.cumsum([n - d for n in sizes]), x)) if sizes else 0
            sizes = [n + (j == k) for j, n in enumerate(sizes)] if k < len(sizes) else [*sizes, 1]
        like = like + pitmanyor.size_likelihood(np.array(sizes)).sum(0)
        tables.append(len(sizes)), customers.append(120)
    both = pitmanyor.restaurant_likelihood(np.array(tables), np.array(customers)) + like[:, None]
    i, j = np.unravel_index(np.argmax(both), both.shape)
    assert abs(pitmanyor.DISCOUNTS[i] - d) <= 0.1
    assert pitmanyor.STRENGTHS[j] in (1.0, 3.0, 10.0)


def test_repeated_texts_score_higher_than_the_base_tells(spark):
    """A text seen twice in training is told from a shuffled one, which a model of single words cannot.

    The texts have word order to learn: each word is followed by one of three.
    """
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    after = {w: rng.sample(vocabulary, 3) for w in vocabulary}

    def walk(n: int) -> str:
        words = [rng.choice(vocabulary)]
        while len(words) < n:
            words.append(rng.choice(after[words[-1]]))
        return " ".join(words)

    rows = [(i, walk(80)) for i in range(300)]
    train = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(train[i], t) for i, (_, t) in enumerate(rows)]
    twice = rows[5][1]
    mixed = " ".join(rng.sample(twice.split(), 80))
    held = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = [*rows, (train[400], twice), (held[0], twice), (held[1], mixed), (held[2], twice), (held[3], "x " * 200_000)]
    got = {r.doc_id: r for r in pitmanyor.score(spark.createDataFrame(docs, "doc_id long, text string"), frequent=100, bucket_tokens=5000).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 20
    assert got[held[0]].score == pytest.approx(got[held[2]].score)
    assert got[held[0]].perplexity == pytest.approx(10 ** (-got[held[0]].score / 81))
    assert got[held[3]].n_tokens == 200_001


def test_scores_of_rows_that_share_an_id(spark):
    """Each row is scored by itself; equal rows score alike, null ids are training rows."""
    rows = [(i, f"one two three four {i % 5}") for i in range(40)] + [(3, "one two"), (3, "one two"), (3, None), (None, "one two")]
    got = pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=100, bucket_tokens=5000).collect()
    assert len(got) == len(rows)
    pair = [r.score for r in got if r.n_tokens == 3]
    assert len(pair) == 3 and pair[0] == pytest.approx(pair[1]) == pytest.approx(pair[2])
    assert [r.n_tokens for r in got if r.doc_id == 3 and r.n_tokens == 1] == [1]


def test_scores_without_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = pitmanyor.score(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)]
    assert pitmanyor.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_sets_of_mixed_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    long_ = {r.lang: r.text for r in docs.where("length(text) > 1500").collect()}
    a, b = sorted(long_)[:2]
    odd = [(-1, None, "en"), (-2, "12 34 !?", None), (-3, "", "en"), (-4, "é", None), (-5, long_[a][:1500] + " " + long_[b][:1500], None), (-6, long_[a], None)]
    got = {r.doc_id: r for r in language.identify(docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))).where("doc_id < 0").collect()}
    assert [(got[i].lang_pred, got[i].score) for i in (-1, -2, -3)] == [("und", 0.0)] * 3
    assert got[-4].lang_pred != "und"
    assert set(got[-5].langs) == {a, b}
    assert got[-6].langs == [a]
    nothing = language.identify(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")).collect()
    assert nothing[0].lang_pred == "und"
    assert language.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_language_of_long_repeated_and_tied_texts(spark):
    """A text over a block is judged like its parts, rows of one id each by itself, and equal languages by name."""
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    one, two = "der die das und nicht ist ein schöner tag ", "the and of this is not a nice day "
    rows = [(train[i], (one if i % 2 else two) * 5, "de" if i % 2 else "en") for i in range(20)]
    held = next(i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2)
    rows += [(held, one * 20_000, None), (held, two, None), (held, two, None), (None, one, None)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id is null or held_out").collect()
    assert sorted(r.lang_pred for r in got) == ["de", "de", "en", "en"]
    assert all(r.score > 0.99 for r in got)
    same = [(train[i], "word another thing ", "b" if i % 2 else "a") for i in range(20)] + [(held, "another word", None)]
    tied = language.identify(spark.createDataFrame(same, "doc_id long, text string, lang string")).where("held_out").collect()
    assert [r.lang_pred for r in tied] == ["a"]


def test_language_sets_match_an_exhaustive_search():
    """Of all sets of four languages, the one found has the best penalised likelihood or nearly so."""
    import itertools

    import pyarrow as pa

    rng, names, buckets = np.random.default_rng(3), ["a", "b", "c", "d"], 40
    rows = [(n, k, int(c)) for n in names for k, c in enumerate(rng.gamma(0.5, 200, buckets)) if c >= 1]
    model = language.Model(pa.table({"lang": [r[0] for r in rows], "bucket": pa.array([r[1] for r in rows], pa.int32()), "n": pa.array([r[2] for r in rows], pa.int64())}))
    same = 0
    for trial in range(30):
        true = rng.choice(4, size=1 + trial % 3, replace=False)
        share = rng.dirichlet(np.full(len(true), 5.0))
        p = share @ model.p[true]
        drawn = rng.choice(len(p), size=600, p=p / p.sum())
        live, weight = language.languages(model, drawn)
        n = np.bincount(drawn, minlength=model.p.shape[1])
        at = np.flatnonzero(n)
        price, best = 0.5 * np.log(n.sum()), None
        for size in range(1, 5):
            for s in itertools.combinations(range(4), size):
                _, like = language.fit(model.p[list(s)][:, at], n[at].astype(float), np.full(size, 1 / size), rounds=500, close=1e-7)
                if best is None or like - price * size > best[0]:
                    best = (like - price * size, s)
        same += set(live) == set(best[1])
        assert weight.sum() == pytest.approx(1, abs=1e-6)
    assert same >= 28


def text_statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    w = WORD.findall(text)
    at: dict[tuple, list[int]] = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark):
    rng = random.Random(9)
    made = ["".join(rng.choices(["a ", "b ", "é", "\n", "\t", "# ", "x|y ", "日本 ", "\r\n", "same line\n"], k=rng.randint(0, 120))) for _ in range(300)]
    made += [None, "", "\n\n", "a\nA\na", " a\na", "x " * 40]
    rows = [(i, t, -1) for i, t in enumerate(made)] + [(None, "a b", 0)]
    rows += [(1000 + r.doc_id, r.text, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, n_words long"), labels).collect()
    want = {i: text_statistics(t) for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        s = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0])
        assert r.kept == (not r.base_failed)  # nothing was learned


def test_learned_conjunction(spark):
    """Rows are bad when two thresholds hold together; the list finds that and keeps the rest."""
    rng = random.Random(5)
    rows, labels, bad = [], [], set()
    for i in range(900):
        loud, numeric = rng.random() < 0.5, rng.random() < 0.5
        w = [(f"{rng.choice('ABCDE')}{rng.choice('FGHIJ')}" if loud else f"{rng.choice('abcde')}{rng.choice('fghij')}") + str(rng.randint(0, 99) if numeric else "") for _ in range(60)]
        rows.append((i, " ".join(w)))
        if loud and numeric:
            bad.add(i)
        if i % 2:
            labels.append((i, 0 if i in bad else 1))
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).where("not base_failed").collect()
    assert {r.doc_id for r in got if not r.kept} == bad
    assert all(" and " in r.rule for r in got if not r.kept)
    kept = quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as rest", "2 as _n_words"), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == ["doc_id", "text", "rest", "_n_words"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_random_labels_teach_nothing():
    rng = np.random.default_rng(8)
    assert quality.learn({f"f{i}": rng.random(3000) for i in range(9)}, rng.random(3000) < 0.3) == []


def brute_links(rows: list[tuple]) -> tuple[dict, dict]:
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, np.float32).astype(float), label)
    n, group = Counter(), {i: i for i, *_ in rows}
    pairs = []
    for a in ok:
        for b in ok:
            (x, p), (y, q) = ok[a], ok[b]
            if a < b and p == q and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return n, group


@pytest.mark.parametrize("tile", [2048, 16])
def test_embedding_links_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(covertree, "TILE", tile)
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(25, 8))
    rows = [(i, (centres[i % 25] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.5])).tolist(), int(i % 25 % 3)) for i in range(300)]
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(20)]  # equal vectors
    rows += [(320 + i, [2 * x for x in rows[i][1]], rows[i][2]) for i in range(5)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [float("inf")] + [0.0] * 7, 1), (404, [None] * 8, 1), (405, [], 1), (406, rows[0][1], None), (407, [1.0] * 7, 1)]
    n, group = brute_links(rows)
    assert len(set(group.values())) < 250
    got = covertree.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(i, n[i], group[i], group[i] == i) for i, *_ in rows}


def test_a_tight_group_and_levels_of_nodes_match_brute_force(spark, monkeypatch):
    """Many levels, nodes that link as a whole, scaled copies of one direction, clashing columns."""
    monkeypatch.setattr(covertree, "TILE", 8)
    monkeypatch.setattr(covertree, "PIVOTS", 4)
    rng = np.random.default_rng(12)
    line = [[math.cos(x), math.sin(x), 0.0] for x in np.linspace(0, 3, 120)]  # a chain through all of a half circle
    tight = [(np.array([0.0, 0.0, 1.0]) + rng.normal(size=3) * 0.003).tolist() for _ in range(90)]
    same = [[0.0, float(-k), 1e-9] for k in range(1, 40)]
    vectors = line + tight + same + rng.normal(size=(60, 3)).tolist()
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    n, group = brute_links(rows)
    data = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, n_links string, node string")
    got = covertree.near_embeddings(data).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (n[i], group[i]) for i, *_ in rows}


def test_embeddings_of_odd_rows(spark):
    v = [1.0, 2.0]
    got = covertree.near_embeddings(spark.createDataFrame([(1, v, 0), (None, v, 0), (2, v, 0), (2, [-2.0, 1.0], 0), (3, [-2.0, 1.0], 0)], "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, None: None}
    assert covertree.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_dual_traversal_loses_no_pair():
    rng = np.random.default_rng(1)
    for reach in (0.05, 0.374, 0.9):
        x, y = (covertree.unit(rng.normal(size=(n, 4))) for n in (200, 150))
        alive = covertree.close_pairs(x, y, covertree.CoverTree(x, reach / 4), covertree.CoverTree(y, reach / 4), reach)
        close = covertree.distances(x, y) <= reach
        assert not (close & ~alive).any()
        assert alive.sum() < alive.size or reach > 0.5
