"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` applies them in order, each to the written result of the
one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.minhash import near_duplicates
from docloom.llm.mixing import mix
from docloom.llm.packing import best_fit
from docloom.llm.quality import keep_good
from docloom.llm.runtime import Scratch, cleared, small_or_not
from docloom.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the learned decision list reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apart(docs: DataFrame, *used: str) -> DataFrame:
    """The columns an operator uses, and all of the input but its text as ``row``, out of the way of others' names."""
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked at 0.8 or more on five-word shingles.

    Rows with a null id stay.  Rows that share an id are told apart by their texts: they stand
    behind all ids that are not shared, and of rows of equal id and text one stays, chosen by a
    hash of all its columns.
    """
    scratch = Scratch(spark, "near")
    shared = small_or_not(scratch.table(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("_shared")), "shared"))
    behind = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)
    named = apart(docs, "doc_id", "text").join(shared, "doc_id", "left").withColumn("_node", F.when(F.col("_shared"), behind).otherwise(F.col("doc_id").cast("long")))
    judged = scratch.table(near_duplicates(named.select("_node", "text"), id_col="_node", width=5, num=80, den=100, bands=28).select("_node", "kept"), "judged")
    left = named.join(small_or_not(scratch.table(judged.where("not kept").select("_node").distinct(), "gone")), "_node", "left_anti")
    once = left.where("_shared").groupBy("_node").agg(F.min_by(F.struct("row", "text"), F.sha2(F.to_json(F.struct("row", "text")), 256)).alias("one")).select("one.row", "one.text")
    left = left.where("_shared is null").select("row", "text").unionByName(once)
    return left.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that a document with a smaller id also has.

    A document that loses all its words goes.
    """
    cut = remove_repeats(apart(docs, "doc_id", "text")).where("n_removed = 0 or n_removed < n_words")
    new = {"text": F.coalesce("kept_text", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("kept_text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept_text")).cast(docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to source, language and topic targets."""
    taken = mix(apart(docs, "doc_id", "text", "source", "lang")).where("sampled")
    return taken.select(*["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences: one row per piece."""
    return best_fit(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned rules, near duplicates and sampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        with cleared():  # the stage's own tables go once its result is written
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if was is not None:
            scratch.free(was)
        was = docs
    return docs
