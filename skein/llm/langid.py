"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower case, everything that is no letter becomes one blank, and all n-grams of 1 to 3
code points are hashed into ``BUCKETS`` columns. Training counts them per language in every partition and
adds up the dense count rows (languages x buckets, a size that does not depend on the data); the matrix
of log probabilities is broadcast, and a batch is scored as the product of its sparse n-gram count matrix
with that matrix, in numpy. The matrix holds whole multiples of 2 ** -SCALE_BITS, so sums are exact and a text's
score does not depend on the batch or the order in which it comes.

The posterior of naive Bayes is nearly always 0 or 1, as it takes n-grams for independent. The score is the
posterior with all its logarithms divided by the square root of the number of n-grams: the label with the best
posterior has the best score, and short or mixed texts score lower than long and plain ones.

Defined results: null, empty and letterless texts are ``und`` with score 0; a row without a language
trains nothing; without any training row everything is ``und``; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, text_rows

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Texts are worked through in pieces of about this many code points, which bounds a worker's memory.
PIECE = 1 << 20
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Log probabilities are rounded to multiples of 2 ** -SCALE_BITS.
SCALE_BITS = 24
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Code point -> folded letter, or 32 for what is no letter; built once in a worker."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in [*range(0xD800), *range(0xE000, 0x110000)]:
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD = table
    return _FOLD


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, folded, each text between blanks; and the offsets of the texts."""
    joined = " " + "  ".join(t or "" for t in texts.to_pylist()) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array(pc.fill_null(pc.utf8_length(texts), 0), np.int64) + 2
    return _fold_table()[points], np.concatenate([[0], np.cumsum(lengths)])


def ngram_buckets(points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram at every position, and whether one is there at all."""
    solid = points != 32
    h = np.zeros(len(points), np.uint32)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            return
        h = h[:m] * _MULTIPLIERS[0] + (points[n - 1 :] + np.uint32(n)) * _MULTIPLIERS[1]
        g = h ^ (h >> np.uint32(15))
        g = (g * _MULTIPLIERS[2]) >> np.uint32(18)
        valid = solid[:m] if n == 1 else ~((points[: m] == 32) & (points[1 : m + 1] == 32)) if n == 2 else solid[1 : m + 1]
        yield n, g, valid


def sparse_counts(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse count matrix of texts laid end to end: row, bucket and count of every cell that is not 0, in order."""
    keys = np.sort(np.concatenate([owner[: len(g)][valid] * BUCKETS + g[valid] for _, g, valid in ngram_buckets(points)] or [np.zeros(0, np.int64)]))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(keys)]]))
    return keys[first] // BUCKETS, keys[first] % BUCKETS, count


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the batch of about PIECE characters; a longer text is a piece of its own."""
    sizes, at, total = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > PIECE:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield batch.slice(at)


def _count(languages: list[str]):
    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            for piece in _pieces(batch):
                points, offsets = _code_points(piece.column("text"))
                of_row = np.array([index[x] for x in piece.column("lang").to_pylist()], np.int64)
                owner = np.repeat(of_row, np.diff(offsets))
                for _, g, valid in ngram_buckets(points):
                    key = owner[: len(g)] * BUCKETS + g
                    total += np.bincount(key[valid], minlength=total.size).reshape(total.shape)
        yield pa.record_batch([pa.array(range(len(languages)), pa.int32()), pa.array([x.tobytes() for x in total], pa.binary())], ["lang", "counts"])

    return count


def _add_rows(key, table):
    total = np.zeros(BUCKETS, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


class LanguageModel:
    def __init__(self, languages: list[str], log_probs: np.ndarray, prior: np.ndarray):
        self.languages, self.log_probs, self.prior = languages, log_probs, prior


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn=None, smoothing: float = 0.5) -> LanguageModel:
    """Count every n-gram of every training row; ``learn``: condition on the column ``id``."""
    rows = text_rows(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    rows = rows.where(learn) if learn is not None else rows
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(known)
    if not languages:
        return LanguageModel([], np.zeros((0, BUCKETS)), np.zeros(0))
    parts = rows.select("text", "lang").mapInArrow(_count(languages), "lang int, counts binary")
    spread = parts.withColumn("part", F.spark_partition_id() % 64)

    summed = spread.groupBy("lang", "part").applyInArrow(_add_rows, "lang int, counts binary").groupBy("lang").applyInArrow(_add_rows, "lang int, counts binary")
    counts = np.zeros((len(languages), BUCKETS))
    for r in summed.collect():  # languages x buckets, whatever the input
        counts[r.lang] = np.frombuffer(r.counts, np.int64)
    counts += smoothing
    total = sum(known.values())
    return LanguageModel(languages, np.log(counts / counts.sum(1, keepdims=True)), np.log([known[x] / total for x in languages]))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score``; the score is the tempered posterior of the label."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        model = held.value
        names = np.array([*model.languages, "und"], object)
        table = np.rint(model.log_probs.T * 2.0**SCALE_BITS).astype(np.int64)
        for batch in batches:
            for piece in _pieces(batch):
                n = piece.num_rows
                points, offsets = _code_points(piece.column("text"))
                if not model.languages:
                    pred, score = np.full(n, 0), np.zeros(n)
                else:
                    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
                    row, bucket, count = sparse_counts(points, owner)
                    evidence, grams = np.zeros((n, len(model.languages)), np.int64), np.zeros(n, np.int64)
                    if len(row):
                        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        grams[row[first]] = np.add.reduceat(count, first)
                        for i in range(table.shape[1]):
                            evidence[row[first], i] = np.add.reduceat(count * table[bucket, i], first)
                    full = evidence / 2.0**SCALE_BITS + model.prior
                    z = full / np.sqrt(np.maximum(grams, 1))[:, None]
                    z = np.exp(z - z.max(1, keepdims=True))
                    best = full.argmax(1)
                    letters = np.add.reduceat(points != 32, offsets[:-1]) if n else np.zeros(0, int)
                    score = np.where(letters > 0, (z / z.sum(1, keepdims=True))[np.arange(n), best], 0.0)
                    pred = np.where(letters > 0, best, len(model.languages))
                yield pa.record_batch([piece.column("id"), pa.array(names[pred], pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(predict, "id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs, learn=crc_mod("id", 4) != 2)
    found = predict_languages(docs, model)
    return found.select(F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
