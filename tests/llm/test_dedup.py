"""MinHash near-duplicates and substring removal against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from docloom.llm import minhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, id long, kept string"


def words_of(text: str | None, lower: bool = False) -> list[str]:
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "") if lower else text or ""
    return WORD.findall(text)


def corpus(seed: int) -> list[tuple]:
    """Random texts with exact copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Straße", "日本", "naïve", "a\u00a0b"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(80)
    out = [prose(rng.randint(1, 150)) for _ in range(60)]
    for _ in range(40):
        near = list(rng.choice(out))
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(near)
    for _ in range(10):
        out.append(prose(rng.randint(0, 60)) + passage[rng.randint(0, 20) :] + prose(rng.randint(0, 60)))
    texts = [rng.choice([" ", "\n", "\t", "  "]).join(x) for x in out] + [None, "", " \n\t", "One", "one", "two words", "TWO words"]
    rng.shuffle(texts)
    return [(i, t, -i, "other column") for i, t in enumerate(texts)]


def smallest_reachable(ids: list[int], links: list[tuple[int, int]]) -> dict[int, int]:
    group = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                moved = True
    return group


def shingles(text: str | None, width: int) -> frozenset:
    w = words_of(text, lower=True)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


@pytest.mark.parametrize(("width", "num", "bands"), [(3, 85, 20), (5, 80, 28)])
def test_near_duplicates_match_brute_force(spark, width, num, bands):
    rows = corpus(num)
    sets = {i: shingles(t, width) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    group = smallest_reachable(list(sets), links)
    assert len(set(group.values())) < len(group)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), width=width, num=num, bands=bands).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), group[i], group[i] == i) for i, s in sets.items()}


def test_near_duplicates_of_odd_rows(spark):
    same = " ".join(f"x{i}" for i in range(40))
    rows = [(5, same), (5, "quite another text of some words"), (9, "quite another text of some words"), (7, same), (None, same), (3, None), (None, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    # id 5 ties its two texts, so 7 and 9 reach it; null ids link with nothing
    assert {r.doc_id: r.component_id for r in got} == {5: 5, 7: 5, 9: 5, 3: 3, None: None}
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert empty.count() == 0


def test_large_buckets_are_finished_in_cells(spark):
    """Chains of near copies that share bands but not all with the middle of their bucket."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        if i:
            base = list(base)
            base[rng.randrange(len(base))] = f"c{i}"
        rows.append((i, " ".join(base)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    group = smallest_reachable(list(sets), links)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == group


def test_pruning_keeps_pairs_at_the_threshold():
    import numpy as np

    need = minhash.least_matches(80, 16, 0.85, 1e-6)
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 32, (20_000, 80), dtype=np.uint32)
    b = np.where(rng.random(a.shape) < 0.85, a, a + 1)
    assert len(minhash.survivors(a, b, need)) >= 20_000 - 3
    far = np.where(rng.random(a.shape) < 0.3, a, a + 1)
    assert len(minhash.survivors(a, far, need)) < 20


def removed(rows: list[tuple], width: int) -> dict:
    """(n_words, n_removed, digest) by id."""
    first: dict[tuple, int] = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words_of(t)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), i)
    out = {}
    for i, t, *_ in rows:
        w = words_of(t)
        gone: set[int] = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("width", "batches", "bits"), [(50, 3, 27), (50, 1, 27), (7, 4, 6), (2, 3, 12), (1, 2, 12)])
def test_substring_removal_matches_brute_force(spark, width, batches, bits):
    rows = corpus(width)
    got = substring.remove_repeats(spark.createDataFrame(rows, DOCS), width=width, batches=batches, filter_bits=bits).collect()
    want = removed(rows, width)
    assert any(x[1] for x in want.values())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:  # what is left of a text holds the kept words
        text = r.text if r.kept_text is None else r.kept_text
        assert hashlib.sha256(" ".join(words_of(text)).encode()).hexdigest() == r.kept_sha256
        assert r.kept == "other column"


def test_substring_removal_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(60))
    rows = [(4, text), (4, text), (None, text), (2, None), (8, f"before {text} after"), (9, "short")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (2, 0), (4, 0), (4, 0), (8, 60), (9, 0)]
    assert next(r.kept_text for r in got if r.doc_id == 8) == "before\nafter"
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_do_not_run_over_the_ends_of_texts(spark):
    """Neighbouring texts are scanned in one block; a window never spans two of them."""
    left, right = " ".join(f"l{i}" for i in range(30)), " ".join(f"r{i}" for i in range(30))
    rows = [(1, f"{left} {right}"), (2, left), (3, right), (4, f"{left}\n{right}")]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0, 3: 0, 4: 60}


def test_an_index_is_kept_and_reads_only_matched_history(spark, tmp_path):
    """Three batches by two sessions' worth of objects; fetched ids are those that share an anchor."""
    rng = random.Random(11)
    prose = lambda n: " ".join(f"v{rng.randrange(100_000)}" for _ in range(n))
    passages = [prose(70) for _ in range(3)]
    batches = [[(100 * b + i, prose(120)) for i in range(50)] for b in range(3)]
    batches[0][3] = (3, f"{prose(30)} {passages[0]} {prose(30)}")
    batches[0][4] = (4, f"{prose(30)} {passages[1]} {prose(30)}")
    batches[1][5] = (105, f"{prose(30)} {passages[0]} {prose(30)}")
    batches[1][6] = (106, f"{prose(30)} {passages[2]} {prose(30)}")
    batches[2][7] = (207, f"{prose(30)} {passages[2]} {prose(30)}")
    batches[2][8] = (208, f"{prose(30)} {passages[1]} {prose(30)}")
    batches[2][9] = (209, batches[0][10][1])
    path, got, read = f"file://{tmp_path}/index", {}, []
    for batch in batches:
        index = substring.FingerprintIndex(spark, path, fanout=2)
        for r in index.ingest(spark.createDataFrame(batch, "id long, text string")).collect():
            got.setdefault(r.id, []).extend(zip(r.lo, r.hi, strict=True))
        read.append({r.id for r in index.fetched.collect()} if index.fetched is not None else set())
        index.close()
    assert read == [set(), {3}, {4, 106}]  # the whole copy 209 is told by its print alone
    assert got == {105: [(30, 100)], 207: [(30, 100)], 208: [(30, 100)], 209: [(0, 120)]}
    assert substring.FingerprintIndex(spark, path, fanout=2).version == 3


def test_a_common_window_is_spread(spark, monkeypatch):
    from docloom.llm import runtime

    monkeypatch.setattr(runtime, "HOT", 5)
    line = " ".join(["same"] * 60)
    rows = [(i, f"{line} {i} end") for i in range(400)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {i: 60 if i else 0 for i in range(400)}


def test_regular_words_stay_apart(spark):
    """The alternating words of Thue and Morse and their complements, which polynomials confuse."""
    import numpy as np
    import pyarrow as pa

    from docloom.llm.words import blocks

    word = "a"
    while len(word) < 4096:
        word += word.translate({97: "b", 98: "a"})
    other = word.translate({97: "b", 98: "a"})
    for seed in (0, 1):
        (_, _, block), *rest = blocks(pa.array([f"{word} {other} {word[:100]} {other[:100]} {word}"]))
        assert not rest and len(np.unique(block.hashes(seed))) == 4
    rows = [(1, " ".join([word] * 50)), (2, " ".join([other] * 50)), (3, " ".join([word] * 50 + ["end"]))]
    # the same at the level of words: windows of two words in alternation
    pair = " ".join("left" if c == "a" else "right" for c in word[:64])
    rows += [(4, pair), (5, " ".join("right" if c == "a" else "left" for c in word[:64]))]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = removed(rows, 50)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert want[2][1] == 0 and want[3][1] == 50
    near = minhash.near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert {r.component_id for r in near} == {1, 2}
