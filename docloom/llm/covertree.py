"""Exact pairs of near-equal embeddings by dual traversal of cover trees.

Cosine c of two vectors is Euclidean distance sqrt(2 - 2c) of their directions, a metric.
The vectors of a label are the root of a tree.  As long as a node holds more than a tile and
spans more than the threshold distance, it is split around pivots: some of its own members, and
the one farthest from its centre.  Node pairs are walked down alongside: a pair of nodes becomes
the pairs of their children whose centres are no farther apart than both covering radii and the
threshold distance.  So pairs are pruned at every level before the next is made.

Of the node pairs left, those that lie within the threshold distance altogether link without a
look at their members: a tight group of any size costs a sum for each member.  The rest are tile
pairs, one task each: a tile gets nested levels of centres whose radii halve, and the two trees
are walked level by level in the same way.  What is left is decided by cosine in double precision.

Equal vectors form one class with a count.  A task returns the number of links of each class
and as many links as join the components it sees, so nothing grows with the square of a group.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .minhash import forest
from .runtime import Scratch, components, small_or_not, spread_join

TILE = 2048
PIVOTS = 64
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nested centre sets over unit vectors, radii 1, 1/2, 1/4 ... down to ``finest``.

    ``levels[i]``: (centre rows, parent of each in the level above, covering radius of each).
    The last level has every point.
    """

    def __init__(self, x: np.ndarray, finest: float):
        centres = np.array([0])
        sets, radius = [centres], 1.0
        while radius >= finest and len(centres) < len(x):
            near = distances(x, x[centres]).min(1)
            more = []
            while near.max() > radius:
                far = int(np.argmax(near))
                more.append(far)
                near = np.minimum(near, distances(x, x[far : far + 1])[:, 0])
                if len(centres) + len(more) > len(x) // 2:  # as good as the points themselves
                    break
            if near.max() > radius:
                break
            centres = np.concatenate([centres, np.array(more, int)])
            sets.append(centres)
            radius /= 2
        sets.append(np.arange(len(x)))
        parents = [np.zeros(1, int)]
        for up, down in zip(sets[:-1], sets[1:], strict=True):
            parents.append(np.argmin(distances(x[down], x[up]), axis=1))
        self.levels = []
        top = np.arange(len(x))  # node of each point at the level at hand
        radii = [np.zeros(len(x))]
        for i in range(len(sets) - 2, -1, -1):
            top = parents[i + 1][top]
            far = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, x[sets[i]][top]), 0))
            r = np.zeros(len(sets[i]))
            np.maximum.at(r, top, far)
            radii.append(r)
        self.levels = list(zip(sets, parents, radii[::-1], strict=True))


def close_pairs(x: np.ndarray, y: np.ndarray, tx: CoverTree, ty: CoverTree, reach: float) -> np.ndarray:
    """Boolean matrix of point pairs that no pruned node pair holds."""
    slack = reach + 1e-7
    i = j = 0
    alive = np.ones((1, 1), bool)
    while True:
        (a, _, ra), (b, _, rb) = tx.levels[i], ty.levels[j]
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(rows):
            return np.zeros((len(x), len(y)), bool)
        d = distances(x[a[rows]], y[b[cols]])
        alive[np.ix_(rows, cols)] &= d <= ra[rows][:, None] + rb[cols][None] + slack
        last_x, last_y = i + 1 == len(tx.levels), j + 1 == len(ty.levels)
        if last_x and last_y:
            return alive
        if not last_x:
            i += 1
            alive = alive[tx.levels[i][1]]
        if not last_y:
            j += 1
            alive = alive[:, ty.levels[j][1]]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def join_tiles(least: float):
    """Rows (cls, rep, mult, vec, left) of a tile pair to (cls, n, a, b)."""
    reach = float(np.sqrt(2 - 2 * least))

    def run(group: pa.Table) -> pa.Table:
        left = np.array(group.column("left").to_pylist(), bool)
        cls, rep, mult = (group.column(c).to_numpy() for c in ("cls", "rep", "mult"))
        raw = _vectors(group.column("vec"))
        norm = np.linalg.norm(raw, axis=1)
        x = raw / norm[:, None]
        own = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        p = np.flatnonzero(left)
        q = p if own else np.flatnonzero(~left)
        if not len(p) or not len(q):
            return pa.table({"cls": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        tp = CoverTree(x[p], reach / 4)
        tq = tp if own else CoverTree(x[q], reach / 4)
        alive = close_pairs(x[p], x[q], tp, tq, reach)
        rows, cols = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        cosine = (raw[p[rows]] @ raw[q[cols]].T) / (norm[p[rows]][:, None] * norm[q[cols]][None])
        link = np.zeros(alive.shape, bool)
        link[np.ix_(rows, cols)] = alive[np.ix_(rows, cols)] & (cosine >= least)
        if own:
            np.fill_diagonal(link, False)
        got = [(cls[p], link @ mult[q])] if own else [(cls[p], link @ mult[q]), (cls[q], link.T @ mult[p])]
        who, n = (np.concatenate(z) for z in zip(*got, strict=True))
        some = n > 0
        u, v = np.nonzero(np.triu(link) if own else link)
        keep = forest(rep[p[u]], rep[q[v]])
        a, b = rep[p[u]][keep], rep[q[v]][keep]
        return pa.table({
            "cls": pa.array(np.concatenate([who[some], np.zeros(len(a), np.int64)])),
            "n": pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])),
            "a": pa.array([None] * int(some.sum()) + a.tolist(), pa.int64()),
            "b": pa.array([None] * int(some.sum()) + b.tolist(), pa.int64()),
        })

    return run


def nearest(key, vectors: pa.Table, pivots: pa.Table) -> pa.Table:
    """Vectors of one salted node to their nearest pivot: (label, dim, node, cls, rep, mult, vec, cell, far)."""
    x, p = unit(_vectors(vectors.column("vec"))), unit(_vectors(pivots.column("vec")))
    number = pivots.column("pivot").to_numpy()
    cell, far = np.empty(len(x), np.int32), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        d = distances(x[lo : lo + 4096], p)
        k = np.argmin(d, axis=1)
        cell[lo : lo + 4096], far[lo : lo + 4096] = number[k], d[np.arange(len(d)), k]
    return vectors.select(["label", "dim", "node", "cls", "rep", "mult", "vec"]).append_column("cell", pa.array(cell)).append_column("far", pa.array(far))


KEYS = ["label", "dim", "node"]


def split(members: DataFrame, sizes: DataFrame, number: int, kind: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members in child nodes, (KEYS, cell, vec) of the pivots) of nodes with ``sizes`` (KEYS, m)."""
    members = members.join(small_or_not(sizes), KEYS)
    place = F.pmod(F.xxhash64("cls", F.lit(number)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.least(F.lit(PIVOTS), F.ceil(2 * F.col("m") / TILE)).cast("int")
    low = members.where((place <= wanted * 32 / F.col("m")) | (F.col("m") <= 64))
    order = Window.partitionBy(*KEYS).orderBy(place, "cls")
    some = low.withColumn("pivot", F.row_number().over(order)).where(F.col("pivot") <= wanted).select(*KEYS, "pivot", "vec", "m")
    far = members.groupBy(*KEYS).agg(F.max_by("vec", F.struct("far", "cls")).alias("vec"), F.first("m").alias("m")).select(*KEYS, F.lit(0).alias("pivot"), "vec", "m")
    pivots = scratch.table(some.unionByName(far) if number else far, "pivots")
    salts = F.ceil(F.col("m") / (4 * TILE)).cast("int")
    salted = members.withColumn("salt", F.pmod(F.col("cls"), salts).cast("int")).drop("m", "far")
    spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("m")
    schema = f"label {kind}, dim int, node string, cls long, rep long, mult long, vec array<double>, cell int, far double"
    made = salted.groupBy(*KEYS, "salt").cogroup(spread.groupBy(*KEYS, "salt")).applyInArrow(nearest, schema)
    return made, pivots.select(*KEYS, F.col("pivot").alias("cell"), "vec")


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two rows link when their labels are equal and not null, their vectors have the same length
    and their cosine in double precision is at least ``least``.  ``n_links`` counts other rows;
    ``component_id`` is the smallest id reachable, itself included.  Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing; nor do null ids.
    Rows that repeat an id are one node of the graph, with all their links.
    """
    scratch = Scratch(vectors.sparkSession, "covertree")
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.col(label_col).alias("label"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0))
    usable = usable.withColumn("dim", F.size("vec"))
    equal = usable.groupBy("label", "dim", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    for salt in count():  # until no two classes share a number
        class_of = F.xxhash64("label", "vec", F.lit(salt))
        classes = scratch.table(equal.select("label", "dim", class_of.alias("cls"), "rep", "mult", "vec"), "classes")
        if classes.agg(F.count("*") == F.count_distinct("cls")).first()[0]:
            break
    usable = usable.withColumn("cls", class_of)

    reach, kind = float(np.sqrt(2 - 2 * least)), dict(classes.dtypes)["label"]
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, z: s + z * z))
    dot = F.aggregate(F.zip_with("centre_i", "centre_j", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm(F.col("centre_i")) * norm(F.col("centre_j")))))
    live = classes.select("label", "dim", F.lit("").alias("node"), "cls", "rep", "mult", "vec", F.lit(0.0).alias("far"))
    leaves, pairs, number = [], None, 0
    open_ = scratch.table(classes.groupBy("label", "dim").agg(F.count("*").alias("m")).select("label", "dim", F.lit("").alias("node"), "m"), "open")
    while not open_.isEmpty():
        made, pivots = split(live, open_, number, kind, scratch)
        made = scratch.table(made.withColumn("parent", F.col("node")).withColumn("node", F.concat("parent", F.lit("."), F.col("cell").cast("string"))), "nodes")
        sums = made.groupBy(*KEYS, "parent", "cell").agg(F.count("*").alias("m"), F.sum("mult").alias("mult"), F.min("rep").alias("low"), F.max("far").alias("far"))
        sums = sums.join(pivots.select("label", "dim", F.col("node").alias("parent"), "cell", F.col("vec").alias("centre")), ["label", "dim", "parent", "cell"]).drop("cell")
        sums = sums.withColumn("again", (F.col("m") > TILE) & (2 * F.col("far") > reach - SLACK))
        children = scratch.table(sums if pairs is None else sums.unionByName(done.withColumn("parent", F.col("node"))), "children")  # noqa: F821
        side = lambda x: children.select("label", "dim", F.col("parent").alias(f"p{x}"), F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("m", "mult", "low", "far", "centre", "again")])  # noqa: E731, B023
        if pairs is None:
            pairs = children.select("label", "dim", F.col("parent").alias("pi"), F.col("parent").alias("pj")).distinct()
        met = pairs.join(side("i"), ["label", "dim", "pi"]).join(side("j"), ["label", "dim", "pj"]).where("pi != pj or i <= j").withColumn("apart", apart)
        met = scratch.table(met.where((F.col("i") == F.col("j")) | (F.col("apart") <= F.col("far_i") + F.col("far_j") + reach + SLACK)).drop("centre_i", "centre_j"), "pairs")
        pairs = met.select("label", "dim", F.col("i").alias("pi"), F.col("j").alias("pj"))
        done = children.where("not again").drop("parent")
        open_ = scratch.table(children.where("again").select(*KEYS, "m"), "open")
        again = small_or_not(open_.select(*KEYS))
        leaves.append(made.join(again, KEYS, "left_anti").select(*KEYS, "cls", "rep", "mult", "vec"))
        live = made.join(again, KEYS, "left_semi").select(*KEYS, "cls", "rep", "mult", "vec", "far")
        number += 1
    if pairs is None:  # no usable vector
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    placed = leaves[0]
    for more in leaves[1:]:
        placed = placed.unionByName(more)
    placed = scratch.table(placed, "placed")

    # node pairs within the threshold distance altogether: everything links with everything
    sure = F.when(F.col("i") == F.col("j"), 2 * F.col("far_i")).otherwise(F.col("apart") + F.col("far_i") + F.col("far_j")) <= reach - SLACK
    met = scratch.table(met.withColumn("sure", sure), "met")
    whole = met.where("sure")
    ways = whole.select("label", "dim", F.col("i").alias("node"), F.col("m_i").alias("m"), F.col("mult_j").alias("n"), F.col("low_j").alias("hub"), (F.col("i") == F.col("j")).alias("own"))
    ways = ways.unionByName(whole.where("i != j").select("label", "dim", F.col("j").alias("node"), F.col("m_j").alias("m"), F.col("mult_i").alias("n"), F.col("low_i").alias("hub"), F.lit(False).alias("own")))
    ways = scratch.table(ways.groupBy(*KEYS).agg(F.max("m").alias("size"), F.sum("n").alias("n"), F.min("hub").alias("hub"), F.max("own").alias("own")), "ways")
    every = spread_join(placed.drop("vec"), ways, KEYS, "size", classes.count())
    every = every.select("cls", (F.col("n") - F.when(F.col("own"), F.col("mult")).otherwise(0)).alias("n"), F.col("rep").alias("a"), F.col("hub").alias("b"))
    every = scratch.table(every, "whole")
    between = whole.where("i != j").select("low_i", "low_j").toDF("a", "b")

    # the others are compared; a node larger than a tile is tight and is dealt to tiles by hash
    subs = lambda m: F.ceil(F.col(m) / TILE).cast("int")
    meet = met.where("not sure").select("label", "dim", "i", "j", F.explode(F.sequence(F.lit(0), subs("m_i") - 1)).alias("si"), "m_j").select("label", "dim", "i", "j", "si", F.explode(F.sequence(F.lit(0), subs("m_j") - 1)).alias("sj"))
    meet = scratch.table(meet.select("label", "dim", F.concat_ws("#", "i", "si").alias("i"), F.concat_ws("#", "j", "sj").alias("j")), "meet")
    tiled = done.select(*KEYS, subs("m").alias("subs"), F.col("m").alias("size"))
    tiled = spread_join(placed, scratch.table(tiled, "tiled"), KEYS, "size", classes.count()).withColumn("tile", F.concat_ws("#", "node", F.pmod(F.xxhash64("cls", F.lit(3)), "subs")))
    cols = ["label", "dim", "i", "j", "cls", "rep", "mult", "vec"]
    first = tiled.withColumnRenamed("tile", "i").join(meet, ["label", "dim", "i"]).select(*cols, F.lit(True).alias("left"))
    second = tiled.withColumnRenamed("tile", "j").join(meet.where("i != j"), ["label", "dim", "j"]).select(*cols, F.lit(False).alias("left"))
    found = first.unionByName(second).groupBy("label", "dim", "i", "j").applyInArrow(join_tiles(least), "cls long, n long, a long, b long")
    found = scratch.table(found, "found")
    found = found.unionByName(every.select("cls", "n", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")))
    joined = every.where("n > 0").select("a", "b").union(between)

    links = found.where("a is null").groupBy("cls").agg(F.sum("n").alias("n"))
    member = usable.select("id", "cls", "label", "dim").join(classes.select("label", "dim", "cls", "rep", "mult"), ["label", "dim", "cls"]).select("id", "cls", "rep", "mult")
    member = scratch.table(member, "member")
    least_rep = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("id", "a")
    tied = member.join(least_rep, "id").select("a", F.col("rep").alias("b")).where("a < b")
    comp = components(found.where("a is not null").select("a", "b").union(joined).union(tied), scratch)
    of_id = member.select("id", "rep").distinct().join(comp.withColumnRenamed("node", "rep"), "rep", "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    of_class = member.select("cls", "mult").distinct().join(links, "cls", "left").select("cls", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = base.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0), F.lit(False)))
    out = out.select("id", F.when(F.col("ok"), class_of).alias("cls")).join(of_class, "cls", "left").join(of_id, "id", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
