"""How corpus filters interact: removals along every order, from the edges of the filter lattice.

An order of filters is a path through the subsets of filters that were already applied, and each
of its steps is an edge (subset, next filter) of that lattice.  What a step does depends on its
edge alone, so documents are counted once for each edge, 80 of them for five filters, and the 600
steps of the 120 orders look their edge up.

One pass over the texts gives each document its failures as bits; everything after it works on
rows of a few numbers, summed on the map side.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, small_or_not, spread_join

FILTERS = "ABCDE"
SPACES = " \t\n\x0b\x0c\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> list[tuple[str, Column]]:
    """Failure conditions of one text, by filter: few words (A), repeated words (B), capitals (C), symbols (D)."""
    bare = F.btrim(text, F.lit(SPACES))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [("A", n < 200), ("B", 100 * F.size(F.array_distinct(words)) < 50 * n), ("C", 100 * capitals > 3 * F.length(text)), ("D", text.rlike("[#$%&*|]"))]


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counted cells (part, mask, good, toxic, n) of documents; bit i of ``mask`` is filter i of FILTERS.

    Filter E is the text of any document with a smaller id.  Null texts are empty and so equal to
    one another; null ids are neither smaller nor larger than others, and rows that repeat an id
    do not make each other fail.  A document is good (toxic) when any of its label rows says 1.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    mask = sum((F.when(fails, 1 << FILTERS.index(f)).otherwise(0) for f, fails in text_failures(text)), F.lit(0))
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), mask.alias("mask"))
    slim = scratch.table(slim, "slim")
    copies = slim.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("first < last")
    copies = scratch.table(copies, "copies")
    late = spread_join(slim, copies.select("digest", "first", "n"), ["digest"], "n", slim.count()).where("id > first")
    late = small_or_not(scratch.table(late.groupBy("id", "digest").agg(F.lit(True).alias("late")), "late"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("id is not null and (good or toxic)")
    marks = small_or_not(scratch.table(marks, "marks"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    judged = slim.join(late, ["id", "digest"], "left").join(marks, "id", "left")
    judged = judged.select("part", (F.col("mask") + F.when(F.col("late"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), yes("good"), yes("toxic"))
    return judged.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def lattice_edges(cells: DataFrame, k: int = len(FILTERS)) -> DataFrame:
    """(part, applied, filter, COUNTS) for each subset of applied filters and each filter not in it."""
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for s in range(1 << k) for f in range(k) if not s >> f & 1])
    each = cells.withColumn("edge", F.explode(edges)).select("part", "mask", "good", "toxic", "n", "edge.*")
    bit = F.expr("shiftleft(1, `filter`)")
    alive, fails = F.col("mask").bitwiseAND(F.col("applied")) == 0, F.col("mask").bitwiseAND(bit) != 0
    of = {
        "kept": alive & ~fails, "removed": alive & fails, "redundant": ~alive & fails, "unique_fails": F.col("mask") == bit,
        "good_lost": alive & fails & F.col("good"), "toxic_lost": alive & fails & F.col("toxic"),
    }
    return each.groupBy("part", "applied", "filter").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name) for name, c in of.items()])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): one row for each part, order and step.

    ``shapley`` is what the step's filter removes, summed over all orders.  An edge lies on as
    many orders as there are ways to order what comes before and after it.  An empty table has
    no parts and no rows.
    """
    scratch, k, spark = Scratch(docs.sparkSession, "lattice"), len(FILTERS), docs.sparkSession
    edges = scratch.table(lattice_edges(failures(docs, labels, scratch)), "edges")
    orders = [factorial(s) * factorial(k - 1 - s) for s in range(k)]
    through = F.element_at(F.array(*[F.lit(x) for x in orders]), (F.bit_count("applied") + 1).cast("int"))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * through).alias("shapley"))
    steps = [("".join(FILTERS[f] for f in p), i + 1, sum(1 << f for f in p[:i]), p[i]) for p in permutations(range(k)) for i in range(k)]
    paths = spark.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    return edges.join(shapley, ["part", "filter"]).join(F.broadcast(paths), ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")
