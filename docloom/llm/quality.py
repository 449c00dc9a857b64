"""Quality rules: text statistics and a learned decision list.

The statistics of each whole text are computed in one vectorised scan.  From labelled rows,
sequential covering grows a conjunction of thresholds by information gain on two thirds of
them, prunes it on the rest, keeps it when it is precise enough there, removes what it covers
and goes on.  The ordered rules become one Spark ``CASE`` expression over the statistics.

Learning uses a bounded sample of labelled rows (``sample``, lowest hashes of ids first); the
statistics and the verdicts cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Scratch, small_or_not
from .words import SPACE, U, Block, blocks, mix

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct"]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, UPPER, DIGIT, PUNCT = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(bytes(range(48, 58))), _table(b"!?.,;:")
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)]) & ~SPACE


def _per_text(flags: np.ndarray, row: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[row[1:]] - total[row[:-1]]


def _repeats(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs twice or more in its text, occurred earlier in its text) for each fingerprint."""
    own = mix(key + (text.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again, later = np.zeros(len(own), bool), np.zeros(len(own), bool)
    later[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, later


def statistics(block: Block, width: int = 8) -> dict[str, np.ndarray]:
    """The STATS of each text of a block."""
    data, row, n = block.data, block.row, block.n_texts
    at, full = block.windows(block.hashes(), width)
    text = block.text_of_word()
    again, _ = _repeats(full, text[at])
    step = np.zeros(len(text) + width + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + width, -1)
    covered = np.zeros(len(text) + 1, np.int64)
    np.cumsum(np.cumsum(step)[: len(text)] > 0, out=covered[1:])

    # lines: from the start of a text or after a line feed, up to the next line feed or the end
    feed = np.flatnonzero(data == 10)
    owner = np.searchsorted(row, feed, "right") - 1
    starts, ends = np.concatenate([row[:-1], feed + 1]), np.concatenate([feed, row[1:]])
    whose = np.concatenate([np.arange(n), owner])
    order = np.lexsort((starts, whose))
    starts, whose = starts[order], whose[order]
    order = np.lexsort((ends, np.concatenate([owner, np.arange(n)])))
    ends = ends[order]
    worded = np.searchsorted(block.start, ends) > np.searchsorted(block.start, starts)
    starts, ends, whose = starts[worded], ends[worded], whose[worded]
    lines = block.spans(starts, ends, seed=2)
    _, later = _repeats(lines, whose)
    return {
        "n_words": block.n_words.astype(np.int64),
        "word_chars": _per_text(LEAD[data], row),
        "n_symbols": _per_text(SYMBOL[data], row),
        "n_dup_lines": np.bincount(whose[later], minlength=n).astype(np.int64),
        "n_repeat_words": covered[block.first[1:]] - covered[block.first[:-1]],
        "n_lines": np.bincount(whose, minlength=n).astype(np.int64),
        "n_upper": _per_text(UPPER[data], row),
        "n_digits": _per_text(DIGIT[data], row),
        "n_punct": _per_text(PUNCT[data], row),
    }


def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (text, ...) to the same columns and the STATS."""
    for batch in batches:
        parts = [statistics(block) for _, _, block in blocks(batch.column(0))]
        made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64()) for c in STATS]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f"_{c}" for c in STATS)])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text, rest, _n_words, ...): ``rest`` holds all columns of the input, whatever their names."""
    base = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    schema = T.StructType([*base.schema.fields, *(T.StructField(f"_{c}", T.LongType()) for c in STATS)])
    return base.mapInArrow(scanner, schema)


def features() -> dict[str, Column]:
    """Ratios that rules may test; each is a Spark expression over the statistics."""
    words, lines = F.greatest(F.col("_n_words"), F.lit(1)), F.greatest(F.col("_n_lines"), F.lit(1))
    return {
        "n_words": F.col("_n_words").cast("double"),
        "mean_word": F.col("_word_chars") / words,
        "symbols": F.col("_n_symbols") / words,
        "dup_lines": F.col("_n_dup_lines") / lines,
        "repeats": F.col("_n_repeat_words") / words,
        "words_per_line": F.col("_n_words") / lines,
        "upper": F.col("_n_upper") / words,
        "digits": F.col("_n_digits") / words,
        "punct": F.col("_n_punct") / words,
    }


@dataclass(frozen=True)
class Rule:
    """Texts that meet all conditions (feature, '>' or '<=', threshold) are rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    support: int

    def column(self) -> Column:
        exprs = features()
        out = F.lit(True)
        for name, op, cut in self.conditions:
            out = out & (exprs[name] > cut if op == ">" else exprs[name] <= cut)
        return out

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, cut in self.conditions:
            out &= x[name] > cut if op == ">" else x[name] <= cut
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {op} {c:.4g}" for n, op, c in self.conditions)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's gain of keeping p positives and n negatives of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int) -> list[tuple[str, str, float]]:
    out, live = [], np.ones(len(y), bool)
    while len(out) < most and (~y[live]).any() and y[live].any():
        best = (1e-9, None)
        p0, n0 = y[live].sum(), (~y[live]).sum()
        for name, v in x.items():
            order = np.argsort(v[live], kind="stable")
            s, pos = v[live][order], np.cumsum(y[live][order])
            ends = np.flatnonzero(np.concatenate([s[1:] > s[:-1], [False]]))
            if not len(ends):
                continue
            p_low, n_low = pos[ends], ends + 1 - pos[ends]
            for op, p, n in (("<=", p_low, n_low), (">", p0 - p_low, n0 - n_low)):
                g = _gain(p.astype(float), n.astype(float), p0, n0)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (g[k], (name, op, float((s[ends[k]] + s[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        out.append(best[1])
        name, op, cut = best[1]
        live &= x[name] > cut if op == ">" else x[name] <= cut
    return out


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, least: int = 5, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """Ordered rules that tell bad rows; empty when there is nothing to learn."""
    rng = np.random.default_rng(11)
    left, rules = np.arange(len(bad)), []
    while len(rules) < most_rules and bad[left].sum() >= least:
        mixed = rng.permutation(left)
        grow, prune = mixed[: len(mixed) * 2 // 3], mixed[len(mixed) * 2 // 3 :]
        made = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_conditions)
        if not made:
            break

        def worth(conditions, rows=prune):
            m = Rule(tuple(conditions), 0, 0).mask({k: v[rows] for k, v in x.items()})
            p, n = bad[rows][m].sum(), (~bad[rows][m]).sum()
            return (p - n) / max(p + n, 1), p, n

        best = max((made[:k] for k in range(1, len(made) + 1)), key=lambda c: (worth(c)[0], -len(c)))
        _, p, n = worth(best, left)
        _, pp, pn = worth(best)
        if p < least or p < precision * (p + n) or pp < precision * (pp + pn):
            break
        rule = Rule(tuple(best), float(p / (p + n)), int(p + n))
        rules.append(rule)
        left = left[~rule.mask({k: v[left] for k, v in x.items()})]
    return rules


def base_failed(min_words: int = 20, repeat_percent: int = 30) -> Column:
    return (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > repeat_percent * F.col("_n_words"))


def learn_from(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, **how) -> list[Rule]:
    """Rules from the labelled documents (label columns id, quality; 0 is bad) that pass the base rules.

    Labelled ids are sampled by hash before any text is read, so only about ``2 * sample`` texts
    are, and at most ``sample`` of them come to the driver, as numbers.
    """
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = labels.where("quality is not null").select(F.col(id_col).cast("long").alias("_id"), F.col("quality").cast("int").alias("_q")).where("_id is not null").distinct()
    known = Scratch(docs.sparkSession, "labels").table(known, "known")
    n = known.count()
    if n > 2 * sample:
        known = known.where(place < int((1 << 30) * 2 * sample / n))
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text")).join(small_or_not(known), "_id")
    rows = with_statistics(slim, "text").where(~base_failed()).select(F.col("rest._id").alias("_id"), F.col("rest._q").alias("_q"), *[c.alias(k) for k, c in features().items()])
    picked = rows.orderBy(place, "_id", "_q", *features()).limit(sample).toPandas()
    x = {k: picked[k].to_numpy(float) for k in features()}
    return learn(x, picked["_q"].to_numpy() == 0, **how)


def verdict(rules: list[Rule]) -> Column:
    """The first rule that rejects, as text; null if none does."""
    out = F.when(base_failed(), F.lit("base"))
    for rule in rules:
        out = out.when(rule.column(), F.lit(str(rule)))
    return out.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged
    alike; of labels that contradict each other each counts once.  Without labels only the base
    rules hold.  Labels of unknown documents and null labels are left out.
    """
    rules = learn_from(docs, labels, id_col, text_col, **how)
    out = with_statistics(docs.select(F.col(id_col), F.col(text_col)), text_col).drop("text").withColumn("rule", verdict(rules))
    return out.select(F.col(f"rest.{id_col}").alias(id_col), *[F.col(f"_{c}").alias(c) for c in STATS[:5]], base_failed().alias("base_failed"), F.col("rule").isNull().alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they were."""
    kept = with_statistics(docs, text_col).where(verdict(learn_from(docs, labels, id_col, text_col, **how)).isNull())
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])
