"""Identifier detection over a DataFrame of texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.finder import finder


def detect(docs: DataFrame, text_col: str = "text", out: str = "matches", codes: Iterable[str] | None = None, extra: Column | None = None, most: int | None = S.MOST_MATCHES, counted: str | None = None, applied: Column | None = None) -> DataFrame:
    """``docs`` with an array of matches, by position: one Arrow function goes through each text once for every rule.

    One match per span is kept and parts of earlier tokens are left out.  A text with more than
    ``most`` matches (4096) gets null, which later steps take as a failed detection; None for
    ``most`` counts them all; ``counted`` names a column for that number.  ``extra`` adds an array of matches of another detector, such as
    a model.  Matches inside the tokens of ``applied``, which redaction put into these texts, are left out.  Null texts get null.
    """
    # never taken for an expression that may be run again where its result is used twice
    find = F.arrow_udf(finder(S.rules_for(codes), most, extra is not None, applied is not None), S.FOUND).asNondeterministic()
    now = docs.withColumn("_found", find(F.col(text_col), *([] if extra is None else [extra.cast(S.MATCH)]), *([] if applied is None else [applied.cast(S.APPLIED)])))
    if counted:
        now = now.withColumn(counted, F.col("_found.n"))
    return now.withColumn(out, F.col("_found.matches")).drop("_found")


def counts_by(matches: DataFrame, *keys: str, col: str = "matches") -> DataFrame:
    """Number of matches by entity and the given columns, summed on the map side."""
    return each_match(matches, *keys, col=col).groupBy(*keys, F.col("m.entity").alias("entity")).agg(F.count("*").alias("found"))


def each_match(matches: DataFrame, *keys: str, col: str | Column = "matches") -> DataFrame:
    """A row ``m`` for each match, with the given columns.

    Not ``explode``: from it Spark infers a filter that repeats the whole expression of the
    matches, and planning it takes far longer than the search.
    """
    return matches.select(*keys, F.explode_outer(col).alias("m")).where("m is not null")
