"""Near-duplicate documents: banded MinHash candidates under sequential Bayesian verification.

1. A vectorised scan of every whole text gives the size of its shingle set, a fingerprint of
   the set, and a signature of ``bands * rows`` minimum hashes.
2. Documents with equal sets form one class; only its smallest id goes on.
3. Classes that agree on all rows of a band meet in a bucket.  The member nearest to a bucket's
   middle is compared with each other member, so a bucket of m gives m - 1 pairs, not m * m / 2.
4. The signatures of a pair are compared in batches; a pair goes when the posterior chance of
   reaching the threshold falls below ``miss``.  Survivors are compared on their full sets.
5. Confirmed links give components.  Buckets that still hold several components are finished:
   members outside the bucket's main component are compared with all members of other
   components.  Large buckets do this in cells of bounded size, which decide on full sets and return
   only as many links as join the components in them.

A pair at the threshold s is missed by banding with chance (1 - s**rows)**bands, 4e-7 at the
defaults for 0.85, and by pruning with about ``miss``.

Sets are compared as sets of 64-bit fingerprints; a pair is misjudged with chance below 1e-12.

Null and empty texts, or texts without a word, have empty sets and link with nothing.  Texts
shorter than a shingle have their whole word sequence as the one shingle.  A null id links with
nothing.  Rows that repeat an id are one node with all the links of its texts; each row is
returned.  Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, components, small_or_not, spread_join
from .words import U, Block, blocks, mix

SMALL_BUCKET = 32
BLOCK_ROWS = 512


def shingle_sets(block: Block, width: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle fingerprints of each text of a block."""
    hashes = block.hashes(lower=lower)
    at, full = block.windows(hashes, width)
    counts = np.maximum(block.n_words - (width - 1), 0)
    ends = np.cumsum(counts)
    out = []
    for i, n in enumerate(block.n_words):
        if counts[i]:
            out.append(np.unique(full[ends[i] - counts[i] : ends[i]]))
        elif n:
            whole = U(n)
            for h in hashes[block.first[i] : block.first[i + 1]]:
                whole = mix(np.array([whole ^ h], np.uint64) * U(0x9E3779B97F4A7C15))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signer(bands: int, rows: int, width: int):
    """Arrow batches of (id, text) to (id, n_shingles, set_a, set_b, sig)."""
    k = bands * rows
    rng = np.random.default_rng(7)
    mul, add = rng.integers(0, 1 << 64, (2, k), dtype=np.uint64)
    mul |= U(1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            size, key, sigs = np.zeros(n, np.int64), np.zeros((2, n), np.uint64), np.zeros((n, k), np.uint32)
            for lo, _hi, block in blocks(batch.column(1)):
                sets = shingle_sets(block, width)
                lens = np.array([len(s) for s in sets])
                size[lo : lo + len(sets)] = lens
                full = np.flatnonzero(lens)
                if not len(full):
                    continue
                x = np.concatenate([sets[i] for i in full])
                cut = np.concatenate([[0], np.cumsum(lens[full])[:-1]])
                key[0, lo + full] = np.add.reduceat(x, cut)
                key[1, lo + full] = np.add.reduceat(mix(x ^ U(0xA5A5A5A5)), cut)
                for j in range(k):
                    h = x * mul[j]
                    h += add[j]
                    sigs[lo + full, j] = (np.minimum.reduceat(h, cut) >> U(32)).astype(np.uint32)
            rows_ = [s.tobytes() if c else None for s, c in zip(sigs, size, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), pa.array(rows_, pa.binary())], ["id", "n_shingles", "set_a", "set_b", "sig"])

    return scan


def least_matches(k: int, step: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, least matches to go on) for each batch of a signature.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), whose
    mass above t is the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in [*range(step, k, step), k]:
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, need: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two signature matrices that stay above the bounds, batch after batch."""
    left, seen, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, least in need:
        seen = seen + (a[left, done:n] == b[left, done:n]).sum(1)
        keep = seen >= least
        left, seen, done = left[keep], seen[keep], n
    return left


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), -1)


def bayes(need: list[tuple[int, int]]):
    """Arrow batches of (a, b, sig_a, sig_b) to the pairs (a, b) that survive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.select(["a", "b"]).take(pa.array(survivors(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")), need)))

    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all left sets with all right sets, by products of 0/1 blocks."""
    flat = np.concatenate([*left, *right])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    lens = np.array([len(x) for x in (*left, *right)])
    row = np.repeat(np.arange(len(lens)), lens)
    shared = times[code] > 1
    code, row = np.cumsum(times > 1)[code[shared]] - 1, row[shared]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        part = slice(*np.searchsorted(code, [lo, lo + 4096]))
        m = np.zeros((len(lens), 4096), np.float32)
        m[row[part], code[part] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of edges that join trees which the edges before them did not."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(x)) != (y := top(y)):
            up[x] = y
            out.append(i)
    return out


def finish_cell(need: list[tuple[int, int]], num: int, den: int):
    """One cell of a large bucket: its probes against its members of other components.

    Signatures prune first; what survives is decided on full sets, and of the links between
    components only as many are returned as join them.
    """

    def run(cell: pa.Table) -> pa.Table:
        probe = np.array(cell.column("probe").to_pylist(), bool)
        ids, comp = cell.column("id").to_numpy(), cell.column("comp").to_numpy()
        sig = _matrix(cell.column("sig").combine_chunks())
        p, m = np.flatnonzero(probe), np.flatnonzero(~probe)
        alive = np.zeros((len(p), len(m)), bool)
        for x, i in enumerate(p):
            other = np.flatnonzero(comp[m] != comp[i])
            alive[x, other[survivors(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[m[other]], need)]] = True
        px, mx = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        a = b = np.zeros(0, np.int64)
        if len(px):
            sets = cell.column("set").to_pylist()
            left, right = ([np.frombuffer(sets[k], np.uint64) for k in side] for side in (p[px], m[mx]))
            both = common_counts(left, right)
            total = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None]
            x, y = np.nonzero(alive[np.ix_(px, mx)] & (den * both >= num * (total - both)))
            a, b = p[px][x], m[mx][y]
            keep = forest(comp[a], comp[b])
            a, b = ids[a[keep]], ids[b[keep]]
        return pa.table({"a": a, "b": b})

    return run


def set_of(width: int):
    """Arrow batches of (id, text) to (id, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for _, _, block in blocks(batch.column(1)) for s in shingle_sets(block, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def confirm(width: int, num: int, den: int):
    """Arrow batches of (a, b, text_a, text_b) to the pairs whose full sets reach num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            left = (s for _, _, block in blocks(batch.column("text_a")) for s in shingle_sets(block, width))
            right = (s for _, _, block in blocks(batch.column("text_b")) for s in shingle_sets(block, width))
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                if min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i] = den * common >= num * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 85, den: int = 100, bands: int = 20, rows: int = 4, batch: int = 16, miss: float = 1e-6) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Documents link when ``den * intersection >= num * union`` of their sets of ``width``-word
    shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased).  ``component_id`` is the smallest
    id reachable over links, ``kept`` says that it is the row's own.  See the module's text for
    the method and for nulls, empty and repeated rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    need = least_matches(bands * rows, batch, num / den, miss)
    schema = "id long, n_shingles long, set_a long, set_b long, sig binary"
    signed = scratch.table(docs.mapInArrow(signer(bands, rows, width), schema), "signed")

    some = signed.where("n_shingles > 0 and id is not null")
    classes = scratch.table(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("id").alias("rep"), F.min("sig").alias("sig")), "classes")
    member = some.join(classes.drop("sig"), ["set_a", "set_b", "n_shingles"]).select("id", "rep")
    sigs = classes.select(F.col("rep").alias("id"), "sig")
    # rows that repeat an id tie the classes of its texts together
    least = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a < hi").select("id", "a")
    tied = member.join(least, "id").select("a", F.col("rep").alias("b")).where("a < b")

    width_bytes = 4 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * width_bytes + 1, F.lit(width_bytes))))
    rows_ = sigs.select("id", F.explode(keys).alias("key"))
    rows_ = scratch.table(rows_, "bands")
    total = rows_.count()
    sized = scratch.table(rows_.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sized")
    shared = scratch.table(spread_join(rows_, sized, ["key"], "m", total), "shared")
    # the member whose buckets are the largest is nearest to the middle of its group
    fame = shared.groupBy("id").agg(F.sum("m").alias("fame"))
    heads = scratch.table(shared.join(fame, "id").groupBy("key").agg(F.max_by("id", F.struct("fame", -F.col("id"))).alias("head"), F.max("m").alias("size")), "heads")
    buckets = scratch.table(spread_join(shared, heads, ["key"], "size", total).drop("size"), "buckets")
    scratch.free(rows_, sized, shared, heads)

    def check(pairs: DataFrame) -> DataFrame:
        a, b = (sigs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").mapInArrow(bayes(need), "a long, b long")

    def exact(pairs: DataFrame) -> DataFrame:
        """Each text is fetched once; those of ids in many pairs once per 256 of them."""
        pairs = scratch.table(pairs, "pairs")
        many = pairs.groupBy("a").count().select("a", F.ceil(F.col("count") / 256).cast("int").alias("salts"))
        pairs = pairs.join(many, "a").withColumn("salt", F.expr("cast(pmod(xxhash64(b), salts) as int)"))
        wanted = scratch.table(pairs.select(F.col("a").alias("id"), "salt").union(pairs.select(F.col("b").alias("id"), F.lit(0))).distinct(), "wanted")
        found = scratch.table(docs.join(small_or_not(wanted), "id").select("id", "salt", "text"), "texts")
        left = found.select(F.col("id").alias("a"), "salt", F.col("text").alias("text_a"))
        right = found.where("salt = 0").select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        ready = pairs.join(right, "b").join(left, ["a", "salt"]).select("a", "b", "text_a", "text_b")
        return scratch.table(ready.mapInArrow(confirm(width, num, den), "a long, b long").distinct(), "links")

    star = buckets.where("id != head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    links = exact(check(star)).union(tied)
    found = scratch.table(components(links, scratch), "components")

    # buckets of three or more that still hold several components
    open_ = buckets.where("m > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "m", "head", "id", F.coalesce("component", "id").alias("comp"))
    open_ = scratch.table(open_, "members")
    spread = scratch.table(open_.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x < y").select("key", "size"), "spread")
    open_ = scratch.table(spread_join(open_, spread, ["key"], "size", total).drop("size"), "open")
    mine, other = open_.where(f"m <= {SMALL_BUCKET}"), open_.where(f"m <= {SMALL_BUCKET}").select("key", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    few = mine.where("id != head").join(other, "key").where("id < b and comp != comp_b").select(F.col("id").alias("a"), "b").distinct()

    large = open_.where(f"m > {SMALL_BUCKET}")
    main = large.groupBy("key", "comp").count().groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    parts = spread_join(large, scratch.table(main, "main"), ["key"], "all", total).withColumn("nb", F.ceil(F.col("all") / BLOCK_ROWS).cast("int")).withColumn("np", F.ceil((F.col("all") - F.col("most")) / BLOCK_ROWS).cast("int"))
    wanted = small_or_not(scratch.table(large.select("id").distinct(), "wanted"))
    sets = scratch.table(docs.join(wanted, "id").mapInArrow(set_of(width), "id long, set binary"), "sets")
    parts = parts.join(sigs, "id").join(sets, "id")
    cols = ["id", "comp", "sig", "set"]
    members = parts.select("key", F.expr("cast(pmod(xxhash64(id), nb) as int)").alias("j"), F.explode(F.sequence(F.lit(0), F.col("np") - 1)).alias("i"), *cols, F.lit(False).alias("probe"))
    probes = parts.where("comp != main").select("key", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.expr("cast(pmod(xxhash64(id, 1), np) as int)").alias("i"), *cols, F.lit(True).alias("probe"))
    cells = members.unionByName(probes).groupBy("key", "i", "j").applyInArrow(finish_cell(need, num, den), "a long, b long")
    more = scratch.table(exact(check(few)).union(cells), "more")
    if not more.isEmpty():
        found = scratch.table(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), scratch), "components")

    group = member.distinct().join(found.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("c"))
    out = signed.select("id", "n_shingles").join(group, "id", "left")
    out = out.select("id", "n_shingles", F.coalesce("c", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
