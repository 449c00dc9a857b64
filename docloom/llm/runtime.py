"""Shared folder, intermediate tables and connected components of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of this machine is set only where the session names none and runs on this machine
    alone, as in tests; on a cluster that setting is required.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Intermediate Parquet tables of one operator call, in the shared folder.

    A written table cuts the lineage: losing an executor later rereads files, it does not
    repeat the work.  ``free`` deletes a table that nothing lazy refers to any more.  What an
    operator returns reads such tables, so they stay until the caller has written its result and
    calls ``clear``, or leaves the ``cleared`` block that the operator was called in.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _made.get().append(self)

    def folder(self, name: str) -> str:
        self.n += 1
        return f"{self.path}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        where = self.folder(name)
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._docloom_path = where
        return out

    def free(self, *frames: DataFrame) -> None:
        for df in frames:
            delete(self.spark, df._docloom_path)


#: The operator calls since the innermost ``cleared`` block of this thread began.
_made: ContextVar[list[Scratch]] = ContextVar("made", default=[])  # noqa: B039


def clear() -> None:
    """Deletes the folders of the operator calls outside of any ``cleared`` block."""
    own = _made.get()
    while own:
        made = own.pop()
        delete(made.spark, made.path)


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes, at its end, the folders of the operator calls made within; those of other threads stay."""
    before = _made.set([])
    try:
        yield
    finally:
        clear()
        _made.reset(before)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


SMALL_ROWS = 500_000


def small_or_not(keys: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast when it is counted small.

    Beyond the limit Spark shuffles both sides of the join as usual.
    """
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


HOT = 20_000


def spread_join(left: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``keys``, a written table with one row a key; ``how`` is inner or left.

    ``n`` is the number of rows of ``left`` that a key has, of ``total``.  Keys of more than a
    HOT-th of all rows, of which there are at most HOT, are broadcast; the rest are shuffled, and
    none of them is large.
    """
    most = max(1000, total // HOT)
    hot, cold = F.broadcast(keys.where(F.col(n) > most)), keys.where(F.col(n) <= most)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(cold, on, how))


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected graph: (node, component).

    ``edges`` has columns a, b.  Alternates large-star and small-star steps (Kiveris et al.,
    2014) until nothing changes; each round is two aggregations by node with partial sums on
    the map side, and is written to the shared folder.  Beyond SMALL_ROWS edges nodes with very
    many neighbours are looked up in a broadcast list; below, no task can hold more than those.
    Only counts come to the driver.
    """
    a, b = F.col("a"), F.col("b")
    count = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    now = scratch.table(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    was = count(now)

    def lowest(t: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
        """``t`` with the smallest neighbour m of its a, and the table to free."""
        low = t.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        if n <= SMALL_ROWS:
            return t.join(low, "a"), None
        low = scratch.table(low, "low")
        return spread_join(t, low, ["a"], "n", n), low

    for _ in range(rounds):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = now.union(now.select("b", "a"))
        joined, low = lowest(both, 2 * was["n"])
        least = F.least("m", "a")
        large = joined.where(b > a).select(b.alias("a"), least.alias("b")).where(a != b).distinct()
        large = scratch.table(large, "large") if low is not None else large
        # small star: a node and its smaller neighbours link to the smallest of them
        joined, lower = lowest(large, was["n"])
        small = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where(a != b).distinct()
        after = scratch.table(small, "edges")
        scratch.free(now, *[t for t in (low, lower, large if low is not None else None) if t is not None])
        now, then, was = after, was, count(after)
        if then == was:
            break
    else:
        raise RuntimeError("components did not settle")
    lows = now.select(b.alias("node")).distinct()
    return now.select(a.alias("node"), b.alias("component")).union(lows.select("node", F.col("node").alias("component")))
