"""Mixing to target weights by iterative proportional fitting, with DataFrame operations only.

Tokens are summed by cell (source, language, topic).  The weights of cells are raked: scaled
to each marginal's target in turn until all marginals hold.  A document's chance is the
calibrated factor of its cell, cut at one, with one scale for all cells chosen so that the
expected number of tokens is the budget.  Whether a document is taken depends on a hash of its
id alone, so a rerun after a lost executor takes the same documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch

MARGINS = ("source", "lang", "topic")
SMALL_CELLS = 20_000  # cells are broadcast only when counted to be no more than these
#: Topics by literal marks, the first that a text has; fixed values.
TOPICS = (("licence", ("License", "license")), ("contact", ("@",)), ("table", (" | ",)), ("link", ("http://", "https://")))
WHITE = " \\t\\n\\x0B\\f\\r"


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{WHITE}]++")).cast("long")


def topic_of(text: Column) -> Column:
    out = None
    for name, marks in TOPICS:
        has = F.lit(False)
        for mark in marks:
            has = has | text.contains(mark)
        out = F.when(has, name) if out is None else out.when(has, name)
    return out.otherwise("prose")


def tempered(cells: DataFrame, by: str, power: float) -> DataFrame:
    """Target shares of a marginal: its token shares to a power, made to sum to one."""
    share = cells.groupBy(by).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("raw"))
    return share.crossJoin(F.broadcast(share.agg(F.sum("raw").alias("all")))).select(by, F.coalesce(F.try_divide("raw", "all"), F.lit(0.0)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch, rounds: int = 40, close: float = 1e-6, every: int = 4) -> DataFrame:
    """``cells`` (marginal columns, tokens) with ``weight``, whose marginals are the targets.

    A marginal value without a target goes to weight 0.  Ends when every marginal is within
    ``close`` of its target, or after ``rounds``; after ``every`` of them the weights are
    written to the shared folder.  ``off`` is the largest distance left between a marginal and its
    target: targets that no weights can meet (as of a value whose cells are all empty) leave it
    above ``close``.  Windows hold cells, which are pre-aggregated: a partition
    has at most as many rows as there are combinations of the other marginals.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for by, target in targets.items():
        now = now.join(target.withColumnRenamed("target", f"target_{by}"), by, "left")
    now = now.fillna(0.0, [f"target_{by}" for by in targets])
    have = {by: F.sum("weight").over(Window.partitionBy(by)) for by in targets}
    for _ in range(0, rounds, every):
        for _ in range(every):
            for by in targets:
                now = now.withColumn("weight", F.when(have[by] > 0, F.col("weight") * F.col(f"target_{by}") / have[by]).otherwise(0.0))
        now = scratch.table(now, "raked")
        off = now.select(F.greatest(*[F.abs(have[by] - F.col(f"target_{by}")) for by in targets]).alias("off"))
        far = off.agg(F.max("off")).first()[0] or 0.0
        if far < close:
            break
    return now.drop(*[f"target_{by}" for by in targets]).withColumn("off", F.lit(far))


def calibrate(cells: DataFrame, budget: Column, steps: int = 4, points: int = 64) -> float:
    """The scale q at which tokens * min(1, q * factor), summed over cells, is the budget.

    Each step sums that for ``points`` scales at once and narrows the range to one of them.
    """
    lo, hi, want = None, None, None
    first = cells.agg(F.sum("tokens").alias("n"), F.min(F.when(F.col("factor") > 0, F.col("factor"))).alias("least"), budget.alias("want")).first()
    if not first["n"] or not first["least"]:
        return 0.0
    lo, hi, want = 0.0, 1.0 / first["least"], first["want"]
    for _ in range(steps):
        grid = [lo + (hi - lo) * i / points for i in range(points + 1)]
        got = cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("factor") * q)).alias(f"q{i}") for i, q in enumerate(grid)]).first()
        at = max([i for i in range(points + 1) if got[i] <= want], default=0)
        if at == points:
            return hi
        lo, hi = grid[at], grid[at + 1]
    return (lo + hi) / 2


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.6, power: float = 0.7, targets: dict[str, DataFrame] | None = None, seed: int = 17, topic: Column | None = None, with_text: bool = True, with_off: bool = False) -> DataFrame:
    """``docs`` with topic, n_tokens, weight, probability and sampled, and with ``off`` if asked.

    ``weight`` is the raked share of the row's cell divided by its share of tokens.  ``sampled``
    takes a row with its ``probability``, so that ``share`` of all tokens are expected.
    Targets not given are the tempered shares of tokens (``power``).  ``off`` is the largest
    distance that raking left between a marginal and its target.  ``topic`` is an expression over
    the columns of ``docs`` (a topic that the data has); the default looks for literal marks.
    ``with_text=False`` leaves the text out of the result, which is then read once.

    Null sources and languages are values of their own.  Null and empty texts have no tokens;
    a cell without tokens has weight 0 and probability 0.  Rows that repeat an id are taken
    or left together.  Result columns replace input columns of their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    made = ["topic", "n_tokens", "weight", "probability", "sampled", *(["off"] if with_off else [])]
    kept = [c for c in docs.columns if c not in made and (with_text or c != text_col)]
    about = F.coalesce((topic_of(F.col(text_col)) if topic is None else topic).cast("string"), F.lit("prose"))
    kind = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"), kind("source").alias("_source"), kind("lang").alias("_lang"), about.alias("_topic"), token_count(F.col(text_col)).alias("_n"))
    if not with_text:
        base = scratch.table(base, "counted")
    cells = scratch.table(base.groupBy(*[F.col(f"_{c}").alias(c) for c in MARGINS]).agg(F.sum("_n").alias("tokens"), F.count("*").alias("rows")), "cells")
    goal = {c: (targets or {}).get(c) or tempered(cells, c, power) for c in MARGINS}
    raked = rake(cells, goal, scratch)
    all_ = raked.agg(F.sum("tokens").alias("n"), F.sum("weight").alias("w")).first()
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.lit(all_["w"] or 1.0) / (F.col("tokens") / F.lit(float(all_["n"] or 1)))).otherwise(0.0)
    factors = scratch.table(raked.select(*[F.col(c).alias(f"_{c}") for c in MARGINS], "tokens", factor.alias("factor"), "off"), "factors")
    q = calibrate(factors, F.sum("tokens") * share)
    few = factors.limit(SMALL_CELLS + 1).count() <= SMALL_CELLS
    slim = factors.drop("tokens")
    out = base.join(F.broadcast(slim) if few else slim, [f"_{c}" for c in MARGINS])
    chance = F.least(F.lit(1.0), F.col("factor") * F.lit(q))
    point = F.pmod(F.xxhash64(F.col(f"rest.{id_col}"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return out.select(*[F.col(f"rest.`{c}`") for c in kept], F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"), F.col("factor").alias("weight"), chance.alias("probability"), (point < chance).alias("sampled"), *(["off"] if with_off else []))


def achieved(mixed: DataFrame) -> DataFrame:
    """(margin, value, before, expected, sampled) of a result of ``mix``: shares of tokens.

    A probability is cut at one, so what is expected can stay below a target that is far above
    what there is; this table tells by how much.
    """
    n = F.col("n_tokens")
    each = mixed.select("source", "lang", "topic", n.alias("n"), (n * F.col("probability")).alias("e"), F.when(F.col("sampled"), n).otherwise(0).alias("s"))
    sums = each.groupBy(*MARGINS).agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("s").alias("s"))
    long_ = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("margin"), F.col(c).cast("string").alias("value")) for c in MARGINS])).alias("m"), "n", "e", "s")
    by = long_.groupBy("m").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("s").alias("s"))
    of = Window.partitionBy("m.margin")  # the values of a marginal, summed before
    return by.select("m.margin", "m.value", *[F.try_divide(c, F.sum(c).over(of)).alias(name) for c, name in (("n", "before"), ("e", "expected"), ("s", "sampled"))])
