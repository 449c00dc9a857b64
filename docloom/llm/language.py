"""Language proportions of documents by expectation-maximisation over character n-grams.

Training counts n-grams of every labelled document in one scan, hashed to a fixed number of
buckets, so that the model is a table of ``languages * buckets`` numbers whatever the corpus.
For a document the mixture weights of languages are fitted by expectation-maximisation with
the n-gram likelihoods held fixed.  Languages are then dropped one after the other, the
lightest first, while the penalised likelihood (half a logarithm of the number of n-grams for
each language) does not fall; what is left is the document's language set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import Scratch
from .words import SPACE, U, Block, blocks, mix

BITS = 14
ORDER = 3
MOST_LANGUAGES = 512  # 512 * 2**14 counts are 64 MB; the model is refused beyond

_SKIP = np.zeros(256, bool)
_SKIP[list(b"0123456789#*$%&|<>@/\\[]{}()=+_-!?.,;:\"'")] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += U(32)
_FOLD[SPACE | _SKIP] = U(32)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every byte trigram; white space and marks count as one blank."""
    data = _FOLD[block.data]
    n = len(data)
    if n < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2] << U(16) | data[1:-1] << U(8) | data[2:]
    text = np.repeat(np.arange(block.n_texts), np.diff(block.row))
    ok = (text[:-2] == text[2:]) & ((data[:-2] != U(32)) | (data[1:-1] != U(32))) & ((data[1:-1] != U(32)) | (data[2:] != U(32)))
    return (mix(code[ok]) >> U(64 - BITS)).astype(np.int64), text[:-2][ok]


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of (lang, text) to (lang, bucket, n), summed within the task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for lo, hi, block in blocks(batch.column(1)):
            bucket, text = grams(block)
            for k in np.unique(codes[lo:hi]):
                got = np.bincount(bucket[codes[lo:hi][text] == k], minlength=1 << BITS)
                total[names[k]] = total[names[k]] + got if names[k] in total else got
    for name, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Smoothed n-gram probabilities: ``p[language, bucket]``."""

    def __init__(self, counts: pa.Table):
        lang = counts.column("lang").to_pylist()
        self.names = sorted(set(lang))
        table = np.zeros((len(self.names), 1 << BITS))
        code = {x: i for i, x in enumerate(self.names)}
        np.add.at(table, (np.array([code[x] for x in lang], int), counts.column("bucket").to_numpy()), counts.column("n").to_numpy().astype(float))
        own = table.sum(1)
        self.prior = own / own.sum() if own.sum() else own
        table += 0.1
        self.p = table / table.sum(1, keepdims=True) if len(self.names) else table


def fit(p: np.ndarray, n: np.ndarray, weight: np.ndarray, rounds: int = 40, close: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixture weights and log likelihood of n-gram counts ``n`` under likelihoods ``p``."""
    total = n.sum()
    for _ in range(rounds):
        part = weight[:, None] * p
        mixed = part.sum(0)
        new = (part @ (n / mixed)) / total
        moved = np.abs(new - weight).max()
        weight = new
        if moved < close:
            break
    return weight, float(n @ np.log(weight @ p))


def languages(model: Model, bucket: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(language set, weights), the weights of languages out of the set being 0."""
    at, n = np.unique(bucket, return_counts=True)
    p, n = model.p[:, at], n.astype(float)
    live = np.arange(len(model.names))
    weight, like = fit(p, n, np.full(len(live), 1 / len(live)))
    price = 0.5 * np.log(n.sum())
    while len(live) > 1:
        keep = np.delete(np.arange(len(live)), len(live) - 1 - np.argmin(weight[::-1]))  # of equal ones the last goes
        less = weight[keep] + 1e-9
        less, like_less = fit(p[live[keep]], n, less / less.sum())
        if like_less - price * (len(keep) - 1) < like - price * (len(live) - 1):
            break
        live, weight, like = live[keep], less, like_less
    full = np.zeros(len(model.names))
    full[live] = weight
    return list(live), full


def predictor(model):
    """Arrow batches of (text, letters, id) to (id, lang_pred, score, langs, shares)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            pred, score, langs, shares = [], [], [], []
            for lo, _hi, block in blocks(batch.column(0)):
                bucket, text = grams(block)
                cut = np.searchsorted(text, np.arange(block.n_texts + 1))
                for i in range(block.n_texts):
                    own = bucket[cut[i] : cut[i + 1]]
                    if not letters[lo + i] or not m.names:
                        best, part, names, w = "und", 0.0, [], []
                    elif not len(own):  # letters, but too few for an n-gram
                        k = int(np.argmax(m.prior))
                        best, part, names, w = m.names[k], float(m.prior[k]), [], []
                    else:
                        live, weight = languages(m, own)
                        k = int(np.argmax(weight))
                        live.sort(key=lambda j: -weight[j])
                        best, part = m.names[k], float(min(1.0, weight[k]))
                        names, w = [m.names[j] for j in live], [float(weight[j]) for j in live]
                    pred.append(best), score.append(part), langs.append(names), shares.append(w)
            made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(2), *made], ["id", "lang_pred", "score", "langs", "shares"])

    return run


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts of all rows with a text and a language; sums, not texts, reach the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sums = Scratch(docs.sparkSession, "language").table(rows.mapInArrow(counter, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "sums")
    kinds = sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if kinds > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the model's size is bounded")
    return Model(sums.toArrow())


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this rest; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, langs, shares.

    Learns from rows whose crc32(id as text) mod 4 is not 2 and whose text and language are
    not null; predicts from the text alone.  ``langs`` is the language set, largest share
    first; ``score`` is the share of the first.  Null texts, and texts without a letter, are
    ``und`` with score 0 and no set; so is all when nothing was learned.  Texts with letters but
    no n-gram get the language with most n-grams in training, its share as score and no set.  Ties go to the name
    that sorts first.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held_out(id_col, 4, 2)), lang_col, text_col))
    base = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"), F.col(id_col).alias("id"))
    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
    out = base.mapInArrow(predictor(model), T.StructType([base.schema["id"], *more]))
    return out.select(F.col("id").alias(id_col), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score", "langs", "shares")
