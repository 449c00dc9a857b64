"""Hierarchical Pitman-Yor language model over all words of the training texts.

The hierarchy of restaurants, over every word and the end of a text:

* one for each context (the word before, or the text's start), whatever its count: customers are
  the words after it;
* their common parent, whose customers are the tables of the contexts, and whose base is uniform
  over the words seen and one unseen.

**Seating** is sampled by Gibbs.  Of a restaurant with discount d and strength theta, T tables and
an auxiliary variable g ~ Gamma(theta / d + T), the dishes are independent given g: t tables for c
customers have weight S_d(c, t) * (d * g * p0)**t, S being the generalised Stirling numbers.  So
all dishes of all restaurants are drawn at once, and a hot context is spread over tasks without
any total going stale within a sweep.  Dishes of up to ``EXACT`` customers are drawn from that
conditional itself.  Larger ones, whose tables are a Poisson number of Sibuya variables given their
sum, take Metropolis steps that redraw all tables but the largest, which leave it invariant.
Discount and strength of either level are drawn from their conditional on a grid.  A sweep gives
contexts the parent of the sweep before; predictive probabilities are averaged over the sweeps kept.

**Layout.**  A pair (context, word) lives in one bucket: that of its context, or, for contexts so
common that their pairs would not fit (a list of at most ``8 * buckets``), that of the pair.  Texts
are counted and scored by sending packed pairs to buckets.  A list of the ``frequent`` words is
broadcast; it makes pairs short and carries the parent's probabilities of those words.  Other words
take part like all others but for two things: seating in contexts uses their mean probability in
the parent, and the parent's seating is summed over the histogram of their tables.  Scores use each
one's own tables, by a join.

Random numbers depend on (sweep, bucket) alone, so a repeated task seats its customers alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .runtime import Scratch
from .words import U, blocks, mix

END = 0x5EED0E9D  # the fingerprint that stands for the end of a text
EXACT = 64
FLUSH = 1_000_000  # tokens that a task packs at once
DISCOUNTS = np.arange(1, 20) / 20
STRENGTHS = np.array([0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 1000.0])


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    low = x < 8
    y = np.where(low, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    if low.any():
        z, part = x[low], np.ones(int(low.sum()))
        for i in range(8):
            part = part * (z + i)
        out[low] -= np.log(part)
    return out


@lru_cache(maxsize=32)
def stirling(d: float) -> np.ndarray:
    """log S_d(c, t) for c and t up to EXACT: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(EXACT + 1)
    for c in range(1, EXACT):
        stay = np.where(t <= c, out[c] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[c, :-1]]))
    return out


def sibuya(n: int, d: float, rng: np.random.Generator) -> np.ndarray:
    """Draws with P(n) proportional to gamma(n - d) / n!, cut at 2**40."""
    p = np.maximum(rng.beta(d, 1 - d, n), 1e-300)
    return 1 + np.minimum(np.floor(np.log(rng.random(n)) / np.log1p(-np.minimum(p, 1 - 1e-16))), float(1 << 40)).astype(np.int64)


@lru_cache(maxsize=1)
def _size_table() -> np.ndarray:
    n = np.arange(1, 1025)[:, None]
    return np.concatenate([np.zeros((1, len(DISCOUNTS))), lgamma(n - DISCOUNTS[None]) - lgamma(1 - DISCOUNTS)[None]])


def size_likelihood(n: np.ndarray) -> np.ndarray:
    """Log likelihood of tables of n customers at each of DISCOUNTS."""
    out = _size_table()[np.minimum(n, 1024)]
    big = n > 1024
    if big.any():
        out[big] = lgamma(n[big][:, None] - DISCOUNTS[None]) - lgamma(1 - DISCOUNTS)[None]
    return out


def seat_large(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator, top: np.ndarray, t: np.ndarray, size_like: np.ndarray, steps: int = 3) -> None:
    """Metropolis steps on dishes of c > EXACT customers, in place.

    ``top``: customers of the largest table (0: not seated yet); ``t``: tables; ``size_like``:
    log likelihood of the table sizes at each of DISCOUNTS.  A step draws Poisson(a / d) tables
    beside the largest, of Sibuya sizes tilted so that they can fill c, and is weighed by the
    probability of what is left for the largest.
    """
    weigh = lambda n, z: lgamma(n - d) - lgamma(n + 1.0) + n * np.log(z)
    # the tilt at which the mean number of customers is c, if there is one below 1
    lo, hi = np.full(len(c), 1e-6), np.full(len(c), 1 - 1e-9)
    for _ in range(30):
        z = (lo + hi) / 2
        more = a * z * (1 - z) ** (d - 1) > c
        hi, lo = np.where(more, z, hi), np.where(more, lo, z)
    z = (lo + hi) / 2
    fresh = top == 0
    top[fresh], t[fresh] = c[fresh], 1
    size_like[fresh] = size_likelihood(c[fresh])
    for _ in range(steps):
        k = rng.poisson(np.minimum(a / d * (1 - (1 - z) ** d), 1e7))
        owner = np.repeat(np.arange(len(c)), k)
        n = np.zeros(len(owner), np.int64)
        again = np.arange(len(n))
        while len(again):  # tilting by rejection
            n[again] = sibuya(len(again), d, rng)
            again = again[np.log(rng.random(len(again))) > (n[again] - 1) * np.log(z[owner[again]])]
        used = np.bincount(owner, n, minlength=len(c)) if len(owner) else np.zeros(len(c))
        most = np.zeros(len(c), np.int64)
        np.maximum.at(most, owner, n)
        left = c - used
        ties = np.bincount(owner, n == left[owner], minlength=len(c)) if len(owner) else np.zeros(len(c))
        ok = (left >= 1) & (left >= most) & (rng.random(len(c)) * (1 + ties) < 1)
        left = np.maximum(left, 1).astype(np.int64)
        take = ok & (np.log(rng.random(len(c))) < weigh(left, z) - weigh(top, z))
        top[take], t[take], size_like[take] = left[take], k[take] + 1, size_likelihood(left[take])
        new = take[owner]
        np.add.at(size_like, owner[new], size_likelihood(n[new]))


def seat_small(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of at most EXACT customers, drawn from their conditional."""
    out, table = np.ones(len(c), np.int64), stirling(d)
    order = np.argsort(c, kind="stable")
    cut = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    loga = np.log(np.maximum(a, 1e-300))
    for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True), 2):
        step = max(1, 1_000_000 // k)
        for lo in range(x, y, step):
            at = order[lo : min(y, lo + step)]
            w = table[k, 1 : k + 1][None] + np.arange(1, k + 1)[None] * loga[at][:, None]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            out[at] = 1 + (w < rng.random(len(at))[:, None] * w[:, -1:]).sum(1)
    return out


def mean_tables(a: float, d: float) -> np.ndarray:
    """Expected tables of a dish of 0 to EXACT customers."""
    w = stirling(d)[1:, 1:] + np.arange(1, EXACT + 1)[None] * np.log(max(a, 1e-300))
    w = np.exp(w - w.max(1, keepdims=True))
    return np.concatenate([[0.0], (w * np.arange(1, EXACT + 1)[None]).sum(1) / w.sum(1)])


def dish_likelihood(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Log likelihood at each of DISCOUNTS of the tables of dishes of at most EXACT customers."""
    both, n = np.unique(c * (EXACT + 1) + t, return_counts=True)
    return np.array([float((n * stirling(float(d))[both // (EXACT + 1), both % (EXACT + 1)]).sum()) for d in DISCOUNTS])


def restaurant_likelihood(tables: np.ndarray, customers: np.ndarray) -> np.ndarray:
    """Log likelihood (discount, strength) of restaurants' totals."""
    out = np.zeros((len(DISCOUNTS), len(STRENGTHS)))
    if len(tables):
        both, n = np.unique(np.stack([tables, customers]).astype(np.int64), axis=1, return_counts=True)
        t, c = both.astype(float)
        for j, s in enumerate(STRENGTHS):
            tail = lgamma(np.array([s]))[0] - lgamma(s + c)
            for i, d in enumerate(DISCOUNTS):
                out[i, j] = float((n * (lgamma(s / d + t) - lgamma(np.array([s / d]))[0] + t * np.log(d) + tail)).sum())
    return out


def draw_grid(like: np.ndarray, rng: np.random.Generator) -> tuple[float, float]:
    p = np.exp(like - like.max()).ravel()
    k = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
    return float(DISCOUNTS[k // len(STRENGTHS)]), float(STRENGTHS[k % len(STRENGTHS)])


def packed(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, byte planes apart, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view(np.int64).ravel() if n else np.zeros(0, np.int64)


def word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (text) to (h, n), summed within a batch; an END for each text."""
    for batch in batches:
        got = [block.hashes(lower=True) for _, _, block in blocks(batch.column(0))]
        h, n = np.unique(np.concatenate([*got, np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(h.view(np.int64), END)), pa.array(np.append(n, len(batch)).astype(np.int64))], ["h", "n"])


class Lexicon:
    """Words by number: frequent ones by their place in a sorted list, others by fingerprint (negative).

    ``common``: contexts whose pairs are dealt to buckets one by one.
    """

    def __init__(self, h: np.ndarray, n: np.ndarray, ends: int, total: int, buckets: int):
        order = np.argsort(h)
        self.h, self.n, self.end, self.buckets = h[order], np.append(n[order], ends), len(h), buckets
        self.common = self.n >= max(1000, total / (8 * buckets))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each fingerprint."""
        if not len(self.h):
            return (h | U(1 << 63)).view(np.int64)
        kinds, which = np.unique(h, return_inverse=True)  # words repeat, and sorted ones are found sooner
        at = np.minimum(np.searchsorted(self.h, kinds), len(self.h) - 1)
        return np.where(self.h[at] == kinds, at, (kinds | U(1 << 63)).view(np.int64))[which]

    def steps(self, block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, words, text) of the tokens of a block, an end after each text's words."""
        h = block.hashes(lower=True)
        n = block.n_words
        ends = np.cumsum(n + 1) - 1
        now = np.full(len(h) + block.n_texts, self.end, np.int64)
        word = np.ones(len(now), bool)
        word[ends] = False
        now[word] = self.find(h)
        before = np.empty_like(now)
        before[1:] = now[:-1]
        if len(before):
            before[0] = self.end
        return before, now, np.repeat(np.arange(block.n_texts), n + 1)

    def is_common(self, u: np.ndarray) -> np.ndarray:
        return (u >= 0) & self.common[np.maximum(u, 0)]

    def bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        one = mix(u.view(np.uint64) + U(1))
        return (np.where(self.is_common(u), pair_key(u, w), one) % U(self.buckets)).astype(np.int64)


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(u.view(np.uint64) + U(1)) + w.view(np.uint64) * U(0x9E3779B97F4A7C15))


def in_order(b: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The order of pairs by bucket, context and word, from one sort of one number each."""
    kinds, code = np.unique(w, return_inverse=True)
    bits = max(1, len(kinds).bit_length())
    # a context is the word before it, or the first one
    if 2 * bits + int(b.max(initial=0)).bit_length() > 62 or not np.array_equal(u[1:], w[:-1]) or u[0] not in kinds[np.searchsorted(kinds, u[:1]) % len(kinds)]:
        return np.lexsort((w, u, b))
    before = np.append(np.searchsorted(kinds, u[:1]), code[:-1])
    return np.argsort((b << (2 * bits)) | (before << bits) | code)


PAIRS = "bucket int, size int, u binary, w binary, n binary"


def pair_counter(lexicon):
    """Arrow batches of (text) to the packed pairs of each bucket, with counts."""

    def flush(lex: Lexicon, u: list, w: list) -> pa.RecordBatch:
        u, w = np.concatenate(u), np.concatenate(w)
        b = lex.bucket(u, w)
        order = in_order(b, u, w)
        u, w, b = u[order], w[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
        n = np.diff(np.append(new, len(u)))
        u, w, b = u[new], w[new], b[new]
        some, cut = np.unique(b, return_index=True)
        rows = [(int(k), y - x, packed(np.diff(u[x:y], prepend=0)), packed(w[x:y]), packed(n[x:y])) for k, x, y in zip(some, cut, np.append(cut[1:], len(b)), strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "size", "u", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, u, w, held = lexicon.value, [], [], 0
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                before, now, _ = lex.steps(block)
                u.append(before), w.append(now)
                held += len(now)
                if held >= FLUSH:
                    yield flush(lex, u, w)
                    u, w, held = [], [], 0
        if held:
            yield flush(lex, u, w)

    return run


#: A bucket's pairs, sorted: contexts u, words w, customers n, tables t, tables of the sweeps kept,
#: the largest tables and size likelihoods of large dishes, and what the last sweep has to sum up.
STATE = "bucket int, size int, u binary, w binary, n binary, t binary, kept array<binary>, top binary, likes binary, sums binary"


def gather(group: pa.Table) -> pa.Table:
    """All packed pairs of one bucket as its state; each pair starts with one table."""
    u, w, n = ([], [], [])
    for row in group.to_pylist():
        u.append(np.cumsum(unpacked(row["u"], row["size"])))
        w.append(unpacked(row["w"], row["size"]))
        n.append(unpacked(row["n"], row["size"]))
    u, w, n = np.concatenate(u), np.concatenate(w), np.concatenate(n)
    order = np.lexsort((w, u))
    u, w, n = u[order], w[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])]))
    u, w, n = u[new], w[new], np.add.reduceat(n, new)
    row = {"bucket": group.column("bucket")[0].as_py(), "size": len(u), "u": packed(np.diff(u, prepend=0)), "w": packed(w), "n": packed(n), "t": packed(np.ones(len(u))), "kept": [], "top": b"", "likes": b"", "sums": b""}
    return pa.Table.from_pylist([row], _STATE)


_STATE = pa.schema([("bucket", pa.int32()), ("size", pa.int32()), ("u", pa.binary()), ("w", pa.binary()), ("n", pa.binary()), ("t", pa.binary()), ("kept", pa.list_(pa.binary())), ("top", pa.binary()), ("likes", pa.binary()), ("sums", pa.binary())])


def totals(u: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(contexts, place of each pair's context, sums by context) of sorted contexts."""
    new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(u))))
    return u[new], place, [np.add.reduceat(x, new) if len(new) else x[:0] for x in of]


def sweep(lexicon, parent, number: int, keep: bool):
    """One Gibbs sweep over states, given the parent.

    ``parent``: p0 of the lexicon's words and end, p0 of another word, d, theta, g of common contexts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, (p0, rare, d, theta, g_common) = lexicon.value, parent.value
        for batch in batches:
            for row in batch.to_pylist():
                size, rng = row["size"], np.random.default_rng([17, number, row["bucket"]])
                u, w, n, t = np.cumsum(unpacked(row["u"], size)), unpacked(row["w"], size), unpacked(row["n"], size), unpacked(row["t"], size)
                mine, place, (tables, customers) = totals(u, t, n)
                common = lex.is_common(mine)
                g = rng.gamma(theta / d + tables)
                g[common] = g_common[mine[common]]
                base = np.where(w >= 0, p0[np.maximum(w, 0)], rare)
                a = d * g[place] * base
                small = np.flatnonzero((n > 1) & (n <= EXACT))
                t[small] = seat_small(n[small], a[small], d, rng)
                large = np.flatnonzero(n > EXACT)
                top = unpacked(row["top"], len(large)) if row["top"] else np.zeros(len(large), np.int64)
                likes = np.frombuffer(row["likes"], np.float32).astype(float).reshape(len(large), -1) if row["likes"] else np.zeros((len(large), len(DISCOUNTS)))
                mt = t[large].copy()
                seat_large(n[large], a[large], d, rng, top, mt, likes, 3 if row["top"] else 10)
                t[large] = mt
                row["top"], row["likes"], row["t"] = packed(top), likes.astype(np.float32).tobytes(), packed(t)
                if keep:
                    row["kept"] = [*row["kept"], row["t"]]
                _, _, (tables, _) = totals(u, t, n)
                like = restaurant_likelihood(tables[~common], customers[~common]) + (dish_likelihood(n[n <= EXACT], t[n <= EXACT]) + likes.sum(0))[:, None]
                by_word = np.bincount(w[w >= 0], t[w >= 0], minlength=len(p0))
                by_common = np.bincount(mine[common], tables[common], minlength=len(p0)) if common.any() else np.zeros(len(p0))
                row["sums"] = pa.compress(np.concatenate([[t[w < 0].sum()], like.ravel(), by_word, by_common]).astype(np.float64).tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_pylist([row], _STATE)

    return run


def summed(width: int):
    """Arrow batches of (sums) to (at, x), added up within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out += np.frombuffer(pa.decompress(raw, 8 * width, codec="zstd", asbytes=True))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["at", "x"])

    return run


def rare_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States to (w, k): tables of words that are not in the lexicon, summed within a bucket."""
    for batch in batches:
        for row in batch.to_pylist():
            w, t = unpacked(row["w"], row["size"]), unpacked(row["t"], row["size"])
            kinds, at = np.unique(w[w < 0], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(at, t[w < 0], minlength=len(kinds)).astype(np.int64))], ["w", "k"])


class Root:
    """The parent restaurant, on the driver: lexicon words one by one, others by histogram of tables."""

    def __init__(self, words: int, rare: dict[int, int], kinds: int, fixed: tuple[float, float] | None):
        self.rare, self.kinds, self.fixed = rare, kinds, fixed
        self.d, self.theta = fixed or (0.5, 1.0)
        self.n_rare, self.t = sum(rare.values()), np.zeros(words, np.int64)
        self.top, self.likes = np.zeros(words, np.int64), np.zeros((words, len(DISCOUNTS)), np.float32)
        self.k, self.rare_t = np.zeros(words, np.int64), float(self.n_rare)

    def seat(self, k: np.ndarray, rare_total: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        """(p of the lexicon's words, mean p of another word) after a sweep; ``k``: customers."""
        base, total = 1.0 / (self.kinds + 1), float(k.sum() + rare_total)
        for _ in range(3):
            tables = self.t.sum() + self.rare_t
            a = self.d * rng.gamma(self.theta / self.d + tables) * base
            self.a = float(a)
            small = np.flatnonzero((k > 0) & (k <= EXACT))
            self.t[k == 0] = 0
            self.t[small] = seat_small(k[small], np.full(len(small), a), self.d, rng)
            large = np.flatnonzero(k > EXACT)
            top, t, likes = self.top[large], self.t[large], self.likes[large].astype(float)
            top = np.where(top > 0, np.maximum(top + k[large] - self.k[large], 0), 0)  # new customers sit at the largest table
            seat_large(k[large], np.full(len(large), a), self.d, rng, top, t, likes, 5)
            self.top[large], self.t[large], self.likes[large] = top, t, likes
            mean = mean_tables(self.a, self.d)
            self.mean = np.append(mean, 1 + self.a / self.d)
            self.rare_t = sum(n * self.mean[min(c, EXACT + 1)] for c, n in self.rare.items())
            if self.fixed is None:
                like = restaurant_likelihood(np.array([self.t.sum() + self.rare_t]), np.array([total])) + (dish_likelihood(k[small], self.t[small]) + likes.sum(0))[:, None]
                few = [(c, n) for c, n in self.rare.items() if c <= EXACT]
                for c, n in few:
                    like += n * np.array([stirling(float(d))[c, max(1, min(c, round(self.mean[c])))] for d in DISCOUNTS])[:, None]
                self.d, self.theta = draw_grid(like, rng)
            self.k = k.copy()
        self.total, self.tables = total, float(self.t.sum() + self.rare_t)
        self.rest = (self.theta + self.d * self.tables) / (self.theta + total)
        p = np.maximum(k - self.d * self.t, 0) / (self.theta + total) + self.rest * base
        mean_rare = (rare_total - self.d * self.rare_t) / (self.theta + total) / max(self.n_rare, 1) + self.rest * base
        return p, float(max(mean_rare, self.rest * base))

    def other(self) -> np.ndarray:
        """p of a word out of the lexicon by its tables, 0 to EXACT; each more adds 1 / (theta + total)."""
        c = np.arange(EXACT + 1)
        return (c - self.d * self.mean[: EXACT + 1]) / (self.theta + self.total) + self.rest / (self.kinds + 1)


def occurrence_packer(lexicon, unit: float):
    """Arrow batches of (id, text) to one row a text (what is known of it) and packed pairs of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        first = row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        logn = np.log10(lex.n + 1) - unit
        u, w, r, held, kind = [], [], [], 0, None
        names = ["bucket", "row", "id", "n_tokens", "n_known", "base", "size", "u", "w", "r"]

        def flush() -> pa.RecordBatch:
            a, b, c = np.concatenate(u), np.concatenate(w), np.concatenate(r)
            k = lex.bucket(a, b)
            order = in_order(k, a, b)
            a, b, c, k = a[order], b[order], c[order] - first, k[order]
            some, cut = np.unique(k, return_index=True)
            rows = [(int(x), i, j) for x, i, j in zip(some, cut, np.append(cut[1:], len(k)), strict=True)]
            none = pa.nulls(len(rows), pa.int64())
            return pa.RecordBatch.from_arrays([
                pa.array([x for x, _, _ in rows], pa.int32()), pa.array([first] * len(rows), pa.int64()), pa.nulls(len(rows), kind), none, none, pa.nulls(len(rows), pa.float64()),
                pa.array([j - i for _, i, j in rows], pa.int32()), *[pa.array([packed(z[i:j]) for _, i, j in rows], pa.binary()) for z in (a, b, c)],
            ], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for lo, hi, block in blocks(batch.column(1)):
                before, now, text = lex.steps(block)
                m, known = block.n_texts, now >= 0
                base = np.bincount(text[known], logn[now[known]], minlength=m)
                n_known = np.bincount(text[known], lex.n[now[known]] > 0, minlength=m).astype(np.int64)
                u.append(before), w.append(now), r.append(text + row)
                empty = [pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.binary())] * 3]
                yield pa.RecordBatch.from_arrays([pa.array((np.arange(row, row + m) % lex.buckets).astype(np.int32)), pa.array(np.arange(row, row + m)), batch.column(0).slice(lo, hi - lo), pa.array(block.n_words + 1), pa.array(n_known), pa.array(base), *empty], names)
                row += m
                held += len(now)
                if held >= FLUSH:
                    yield flush()
                    u, w, r, held, first = [], [], [], 0, row
        if held:
            yield flush()

    return run


def scorer(lexicon, model, kind: pa.DataType):
    """(texts and packed pairs, state) of one bucket to sums by text, and pairs of words to be joined."""

    schema = pa.schema([("row", pa.int64()), ("id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("w", pa.int64()), ("a", pa.float64()), ("b", pa.float64())])

    def run(texts: pa.Table, states: pa.Table) -> pa.Table:
        lex, (p0, ds, thetas, common_tables) = lexicon.value, model.value
        mean_p0, s = p0.mean(0), len(ds)
        out = []
        of_text = texts.filter(pc.is_null(texts.column("size"))) if len(texts) else texts
        if len(of_text):
            m = len(of_text)
            out.append(pa.table([*[of_text.column(c) for c in ("row", "id", "n_tokens", "n_known", "base")], pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], schema=schema))
        u = w = n = np.zeros(0, np.int64)
        ts = [u] * s
        for row in states.to_pylist():
            size = row["size"]
            u, w, n = np.cumsum(unpacked(row["u"], size)), unpacked(row["w"], size), unpacked(row["n"], size)
            ts = [unpacked(x, size) for x in row["kept"]]
        mine, place, (customers, *tables) = totals(u, n, *ts)
        common = lex.is_common(mine)
        customers = customers.astype(float)
        customers[common] = lex.n[mine[common]]
        share_a, share_b = np.zeros((s, len(u))), np.ones((s, len(mine) + 1))
        for i in range(s):
            tables[i] = tables[i].astype(float)
            tables[i][common] = common_tables[i][mine[common]]
            share_a[i] = (n - ds[i] * ts[i]) / (thetas[i] + customers[place])
            share_b[i, :-1] = (thetas[i] + ds[i] * tables[i]) / (thetas[i] + customers)
        key = pair_key(u, w)
        order = np.argsort(key)
        key = key[order]
        score, first = {}, []
        for row in texts.filter(pc.is_valid(texts.column("size"))).to_pylist() if len(texts) else []:
            size = row["size"]
            a, b, r = unpacked(row["u"], size), unpacked(row["w"], size), unpacked(row["r"], size)
            # equal pairs stand together: each is looked up once
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            times, c, x = np.diff(np.append(new, size)), a[new], b[new]
            at = np.searchsorted(key, wanted := pair_key(c, x))
            hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == wanted) if len(key) else np.zeros(len(c), bool)
            pair = order[np.minimum(at, len(key) - 1)] if len(key) else at
            where = np.minimum(np.searchsorted(mine, c), max(len(mine) - 1, 0))
            where = np.where(mine[where] == c, where, len(mine)) if len(mine) else np.zeros(len(c), np.int64)
            p = np.zeros(len(c))
            for i in range(s):
                part = np.where(hit, share_a[i][pair], 0.0) if len(u) else np.zeros(len(c))
                p += (part + share_b[i][where] * np.where(x >= 0, p0[i][np.maximum(x, 0)], 0.0)) / s
            p, where, known = np.repeat(p, times), np.repeat(where, times), b >= 0
            rows = np.unique(r)
            sums = np.bincount(np.searchsorted(rows, r[known]), np.log10(np.maximum(p[known], 1e-300)), minlength=len(rows))
            m, none = len(rows), lambda k, t: pa.nulls(k, t)
            out.append(pa.table([pa.array(rows + row["row"]), none(m, kind), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), pa.array(sums), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64())], schema=schema))
            other = np.flatnonzero(~known)
            m = len(other)
            out.append(pa.table([pa.array(r[other] + row["row"]), none(m, kind), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), pa.array(b[other]), pa.array(p[other]), pa.array(share_b.mean(0)[where[other]])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, rest: int = 2, frequent: int = 1 << 19, burn: int = 3, keep: int = 3, bucket_tokens: int = 1_500_000, fixed: tuple[float, float] | None = None) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Trains on rows whose crc32(id as text) modulo ``modulus`` is not ``rest`` (null ids train)
    and scores every row.  Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and
    one end; null and empty texts are one end.  ``base_score`` is the sum of
    log10((c + 1) / (N + V + 1)), ``score`` the model's log10 probability of the text,
    ``perplexity`` 10 ** (-score / n_tokens).

    Repeated rows are counted and scored one by one.  Without training rows c, N and V are 0, and
    each token has probability 1.  ``fixed`` (discount, strength) keeps both levels' from being sampled.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitmanyor")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    train = base.where(~held_out("id", modulus, rest)).select("text")

    counts = scratch.table(train.mapInArrow(word_counter, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    stats = counts.agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.sum(F.when(F.col("h") == END, F.col("n"))).alias("ends")).first()
    kinds, total, ends = stats["kinds"], stats["total"] or 0, stats["ends"] or 0
    kinds = kinds if ends else 0
    words = counts.where(F.col("h") != END)
    least = _least_count(words.groupBy("n").agg(F.count("*").alias("k")), frequent)
    head = words.where(F.col("n") >= least).toArrow()
    buckets = max(1, -(-total // bucket_tokens))
    lex = Lexicon(head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy(), ends, total, buckets)
    lexicon = spark.sparkContext.broadcast(lex)

    # pairs of every context, and Gibbs over contexts and their parent
    state = scratch.table(train.mapInArrow(pair_counter(lexicon), PAIRS).groupBy("bucket").applyInArrow(gather, STATE), "state")
    first = state.mapInArrow(rare_tables, "w long, k long").groupBy("w").agg(F.sum("k").alias("k"))
    rare = {r["k"]: r["n"] for r in first.groupBy(_step(F.col("k")).alias("k")).agg(F.count("*").alias("n")).collect()}
    width = lex.end + 1
    root, rng = Root(width, rare, kinds, fixed), np.random.default_rng(5)
    d, theta = fixed or (0.5, 1.0)
    p0, mean_rare = np.maximum(lex.n, 1) / max(total, 1), 1.0 / max(total, 1)
    common_tables, g = np.ones(width), np.zeros(width)
    at, grid = np.flatnonzero(lex.common), len(DISCOUNTS) * len(STRENGTHS)
    model: tuple[list, list, list, list] = ([], [], [], [])
    others = np.zeros(EXACT + 1)
    step = 0.0
    for i in range(burn + keep):
        g[at] = rng.gamma(theta / d + common_tables[at])
        parent = spark.sparkContext.broadcast((p0, mean_rare, d, theta, g.copy()))
        after = scratch.table(state.mapInArrow(sweep(lexicon, parent, i, i >= burn), STATE), "state")
        scratch.free(state)
        state = after
        got = state.select("sums").mapInArrow(summed(1 + grid + 2 * width), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        sums = np.zeros(1 + grid + 2 * width)
        sums[got.column("at").to_numpy()] = got.column("x").to_numpy()
        by_word, common_tables = np.rint(sums[1 + grid : 1 + grid + width]).astype(np.int64), sums[1 + grid + width :]
        if i >= burn:
            model[1].append(d), model[2].append(theta), model[3].append(common_tables)
        p0, mean_rare = root.seat(by_word, sums[0], rng)
        if i >= burn:
            model[0].append(p0)
            others += root.other() / keep
            step += 1 / (root.theta + root.total) / keep
        if fixed is None:
            like = sums[1 : 1 + grid].reshape(len(DISCOUNTS), -1) + restaurant_likelihood(common_tables[at], lex.n[at])
            d, theta = draw_grid(like, rng)

    tail = words.where(F.col("n") < least).select(F.expr("h | shiftleft(1L, 63)").alias("w"), "n")
    tables = state.mapInArrow(rare_tables, "w long, k long").groupBy("w").agg(F.sum("k").alias("k"))
    tail = scratch.table(tail.join(tables, "w", "left"), "tail")
    learned = spark.sparkContext.broadcast((np.array(model[0]) if total else np.ones((keep, width)), model[1], model[2], model[3]))
    kind = dict(base.dtypes)["id"]
    unit = float(np.log10(total + kinds + 1))
    arrow = base.select("id").limit(0).toArrow().schema.field(0).type
    pairs = base.mapInArrow(occurrence_packer(lexicon, unit), f"bucket int, row long, id {kind}, n_tokens long, n_known long, base double, size int, u binary, w binary, r binary")
    out = f"row long, id {kind}, n_tokens long, n_known long, base double, score double, w long, a double, b double"
    parts = scratch.table(pairs.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(scorer(lexicon, learned, arrow), out), "parts")
    scratch.free(state)

    # words out of the lexicon: their own tables in the parent
    k = F.coalesce("k", F.lit(0))
    own = F.element_at(F.array(*[F.lit(float(x)) for x in others]), F.least(k, F.lit(EXACT)).cast("int") + 1) + F.greatest(k - EXACT, F.lit(0)) * step
    p = F.col("a") + F.col("b") * (own if total else F.lit(1.0))
    joined = parts.where("w is not null").join(tail, "w", "left").groupBy("row").agg(
        F.sum(F.log10(F.greatest(p, F.lit(1e-300)))).alias("score"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1) - unit).alias("base"), F.count("n").alias("n_known"))
    rows = parts.where("w is null").select("row", "n_tokens", "n_known", "base", "score", F.when(F.col("n_tokens").isNotNull(), F.struct("id")).alias("id"))
    rows = rows.unionByName(joined, allowMissingColumns=True).groupBy("row").agg(F.max("id")["id"].alias("id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return rows.select(
        F.col("id").alias(id_col), held_out("id", modulus, rest).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.coalesce("score", F.lit(0.0)).alias("score"), F.pow(F.lit(10.0), -F.coalesce("score", F.lit(0.0)) / F.col("n_tokens")).alias("perplexity"),
    )


def _step(n: Column) -> Column:
    """Numbers above 4096 as powers of two, so that few kinds reach the driver."""
    return F.when(n <= 4096, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("long"))


def _least_count(sizes: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words have it or more."""
    rows = sizes.groupBy(_step(F.col("n")).alias("n")).agg(F.sum("k").alias("k")).collect()
    above, least = 0, 1 << 62
    for n, k in sorted(((r["n"], r["k"]) for r in rows), reverse=True):
        if above + k > most:
            break
        above, least = above + k, n
    return least
