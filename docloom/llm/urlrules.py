"""URL filtering by host rules and by association rules, with DataFrame operations only.

Labelled urls become sets of tokens (host labels and their parts, path segments with numbers
folded, extension, query pairs, fragment).  Spark's FP-growth gives the combinations that bad
rows have; as rules that imply the bad label they are pruned by support, confidence and lift,
and by simpler rules that are as sure.  A rule is an entry of an inverted
index from token to rules; it fires on a url that has as many of its tokens as it has.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, small_or_not

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one, and for null."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(text of the longest rule that fits, its verdict), null where none does."""
    name = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a url; none for null and urls without a host."""
    rest = rest_of(url)
    host, path = host_of(rest), path_of(rest)
    tail = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^?#]*", 0)) + 1, F.length(rest))
    fold = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    mark = lambda parts, kind: F.transform(parts, lambda x: F.concat(F.lit(kind), fold(x)))
    solid = lambda parts: F.filter(parts, lambda x: x != "")
    labels = solid(F.split(host, r"\."))
    suffix = F.regexp_extract(path, r"[^/]\.([0-9A-Za-z]+)$", 1)
    pieces = F.flatten(F.transform(labels, lambda x: F.when(x.contains("-"), F.split(x, "-")).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(
        mark(labels, "h:"), mark(solid(pieces), "w:"), mark(solid(F.split(path, "/")), "p:"), mark(solid(F.array(F.translate(suffix, _UPPER, _LOWER))), "x:"),
        mark(solid(F.split(F.regexp_extract(tail, r"^\?([^#]*)", 1), "&")), "q:"), mark(solid(F.array(F.regexp_extract(tail, r"(?s)#(.*)$", 1))), "f:"),
    ))


def mine(labelled: DataFrame, scratch: Scratch, support: float = 0.001, least: int = 10, confidence: float = 0.6, lift: float = 1.5, common: float = 1.0, steps: dict[str, int] | None = None) -> DataFrame:
    """Rules (rule, items, size, confidence, support) from rows (tokens array, bad boolean).

    The consequent is fixed: FP-growth runs over the bad rows alone, and what it finds is then
    counted in the others.  A token goes before mining only where no rule can need it: when fewer
    bad rows than the support asks for have it, or when all rows have it.  ``common`` below 1 also
    leaves out tokens in more than that part of the rows, with the rules that have them.  Empty
    when no row is labelled or none is bad.  ``steps`` is given the number of rules that each
    pruning left.
    """
    steps = {} if steps is None else steps
    rows = scratch.table(labelled.where("bad is not null"), "labelled")
    n = rows.count()
    empty = rows.sparkSession.createDataFrame([], "rule long, items array<string>, size int, confidence double, support double")
    used = rows.where("bad or size(tokens) > 0")
    m, n_bad = used.count(), used.where("bad").count()
    steps |= {"labelled": n, "bad": n_bad}
    if not n_bad:
        return empty
    support = max(support, least / n)
    wanted = max(1, ceil(support * m - 1e-9))
    counts = used.select(F.explode("tokens").alias("t"), "bad").groupBy("t").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    may = (F.col("bad") >= wanted) & (F.col("n") < m) & (F.col("n") <= common * n)
    kept = scratch.table(counts.where(may).select("t", "n"), "kept")
    steps["tokens"] = kept.count()
    # tokens that stand in the same rows stand for one another: a rule needs one of them, and any will do
    each = scratch.table(used.withColumn("row", F.monotonically_increasing_id()), "used").select("row", "bad", F.explode("tokens").alias("t")).join(small_or_not(kept.select("t")), "t")
    mark = lambda i: F.sum(F.xxhash64("row", F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}")
    alike = each.groupBy("t").agg(F.count("*").alias("n"), mark(1), mark(2)).groupBy("n", "m1", "m2").agg(F.min("t").alias("first"), F.collect_list("t").alias("members"))
    alike = scratch.table(alike.select("first", "n", "members"), "alike")
    steps["different"] = alike.count()
    # rows of equal tokens are one with a count
    sets = each.join(small_or_not(alike.select(F.col("first").alias("t"))), "t").groupBy("row", "bad").agg(F.sort_array(F.collect_list("t")).alias("items"))
    sets = scratch.table(sets.groupBy("items").agg(F.count_if("bad").alias("n_bad"), F.count_if(~F.col("bad")).alias("n_good")), "sets")
    bad = sets.where("n_bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("n_bad"))))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (wanted - 0.5) / n_bad)).fit(bad.select("items"))
    # FP-growth's shares are of the rows it saw; it gives counts
    found = model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("bad")).withColumn("rule", F.xxhash64("items")).withColumn("size", F.size("items"))
    found = keyed(scratch.table(found, "found"), alike.select(F.col("first").alias("t"), "n"), scratch)
    steps["supported"] = found.count()
    good = sets.where("n_good > 0").select("items", "n_good", F.explode("items").alias("key"))
    inside = F.size(F.array_intersect(good["items"], found["items"])) == F.col("size")
    good = good.join(found, "key").where(inside).groupBy("rule").agg(F.sum("n_good").alias("good"))
    sure = found.join(good, "rule", "left").withColumn("confidence", F.col("bad") / (F.col("bad") + F.coalesce("good", F.lit(0)))).withColumn("support", F.col("bad") / float(m))
    sure = scratch.table(sure.select("rule", "items", "size", "key", "confidence", "support").where(F.col("confidence") >= confidence), "confident")
    steps["confident"] = sure.count()
    sure = sure.where(F.col("confidence") / (n_bad / m) >= lift)
    steps["lifted"] = sure.count()
    # a rule goes when a rule with part of its tokens is as sure; the smaller is looked up by its rarest token
    small = sure.select("key", F.col("items").alias("part"), F.col("size").alias("part_size"), F.col("confidence").alias("part_confidence"))
    over = sure.select("rule", "items", "size", "confidence", F.explode("items").alias("key")).join(small, "key")
    beaten = over.where("part_size < size and part_confidence >= confidence and size(array_intersect(items, part)) = part_size").select("rule").distinct()
    left = scratch.table(sure.join(beaten, "rule", "left_anti").select("rule", "items", "size", "confidence", "support"), "left")
    # back from the tokens that were mined to all that stand in the same rows
    choices = left.select("rule", F.explode("items").alias("first")).join(small_or_not(alike), "first").groupBy("rule").agg(F.collect_list("members").alias("choices"))
    ways = F.aggregate("choices", F.array(F.array().cast("array<string>")), lambda made, more: F.flatten(F.transform(made, lambda m: F.transform(more, lambda x: F.concat(m, F.array(x))))))
    rules = left.drop("items").join(choices, "rule").select(F.explode(ways).alias("items"), "size", "confidence", "support")
    rules = scratch.table(rules.select(F.xxhash64(F.sort_array("items")).alias("rule"), F.sort_array("items").alias("items"), "size", "confidence", "support"), "rules")
    steps["rules"] = rules.count()
    return rules


def keyed(rules: DataFrame, tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """``rules`` with ``key``, the token of each that the fewest rows have."""
    each = rules.select("rule", F.explode("items").alias("t")).join(small_or_not(tokens), "t").groupBy("rule").agg(F.min_by("t", F.struct("n", "t")).alias("key"))
    return scratch.table(rules.join(each, "rule"), "keyed")


def fired(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rules) of the distinct urls on which a rule fires, by the inverted index."""
    index = small_or_not(rules.select(F.explode("items").alias("t"), "rule", "size"))
    seen = urls.select("url", F.explode("tokens").alias("t")).join(index, "t")
    return seen.groupBy("url", "rule", "size").count().where("count = size").groupBy("url").agg(F.count("*").alias("rules"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", host_rules=RULES, **how) -> DataFrame:
    """Per row: id, host, path, rule, verdict, learned.

    ``rule`` is the longest host rule that fits and decides; else the url is blocked when a
    learned rule fires.  A label (quality 0 or toxic 1 is bad) belongs to the page of its id.
    Null urls and urls without ``://`` have an empty host and path, no tokens, and are
    allowed.  Repeated rows are judged alike; every label of a repeated id counts.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    bad = labels.select(F.col(label_id).cast("long").alias("_id"), F.when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad"))
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = base.withColumn("_id", F.col("id").cast("long")).join(bad, "_id").select(tokens_of(F.col("url")).alias("tokens"), "bad")
    rules = mine(rows, scratch, **how)
    urls = base.select("url").where("url is not null").distinct().select("url", tokens_of(F.col("url")).alias("tokens"))
    hits = small_or_not(scratch.table(fired(urls, rules), "hits"), 100_000)
    rest = rest_of(F.col("url"))
    name, verdict = by_rules(F.col("host"), F.col("path"), host_rules)
    out = base.join(hits, "url", "left").select("id", host_of(rest).alias("host"), path_of(rest).alias("path"), F.col("rules").isNotNull().alias("learned"))
    return out.select(F.col("id").alias(id_col), "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("learned"), "block").otherwise("allow")).alias("verdict"), "learned")
