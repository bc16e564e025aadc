"""Quality classifier by compression.

zstandard dictionaries are built from texts labelled good and from texts labelled bad. A text is compressed with
either; the difference of the two sizes over the text's length tells which side it is closer to, and nothing
else about the text takes part in the score. The labelled sample is cut into two folds: each has its pair of
dictionaries, and a logistic calibration of that pair's difference fitted on the other fold, which the
dictionaries have not seen. The score is the logistic function of the mean of the two calibrated log odds.

The labelled sample is bounded (``SAMPLE_ROWS`` of each label, chosen by a hash of the id, whole texts): it fits
dictionaries of fixed size, in one task, so no text reaches the driver. All labels of documents that are there are
counted, and the calibration weighs the sample's rows to their ratio, so a score means the same at any size of
the table. Scoring reads every row and whole texts.

Defined results: null and empty texts get the score of a difference of zero; all texts get 0.5 if no fold can be
calibrated because a label is missing there; of documents with the same id the least text is learned from; rows
with a null id are scored, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, staged, text_rows

#: Bound of the labelled sample: rows of each label (their whole texts train; scoring reads all rows).
SAMPLE_ROWS = 2_000
DICT_BYTES = 112_640
#: Texts are given to the dictionary trainer in pieces of this many bytes.
TRAIN_PIECE = 1024
LEVEL = 3
FOLDS = (0, 1)


def train_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    pieces = [t[at : at + TRAIN_PIECE] for t in texts for at in range(0, len(t), TRAIN_PIECE)]
    total = sum(map(len, pieces))
    if total < 1024:
        return b"".join(pieces)
    try:
        return zstd.train_dictionary(max(256, min(size, total // 8)), pieces).as_bytes()
    except zstd.ZstdError:  # too few or too uniform samples for the trainer: their plain content serves
        return b"".join(pieces)[-size:]


def _compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    if len(dictionary) < 8:
        return zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
    made = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_AUTO)
    made.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(dict_data=made, write_content_size=False)


class CompressionModel:
    """Of each fold the two dictionaries and the calibration; small and of fixed size, it travels in a broadcast."""

    def __init__(self, dictionaries: list[tuple[bytes, bytes]], lines: list[tuple[float, float] | None]):
        self.dictionaries, self.lines = dictionaries, lines

    def compressors(self):
        return [(_compressor(good), _compressor(bad)) for good, bad in self.dictionaries]

    @staticmethod
    def differences(text: bytes, compressors) -> list[float]:
        """Of each fold, how many bytes the good dictionary saves against the bad one, for each byte of the text."""
        return [(len(bad.compress(text)) - len(good.compress(text))) / len(text) if text else 0.0 for good, bad in compressors]

    def scores(self, d: np.ndarray) -> np.ndarray:
        odds = [line[0] + line[1] * d[:, k] for k, line in enumerate(self.lines) if line]
        return 1 / (1 + np.exp(-np.clip(np.mean(odds, axis=0), -30, 30))) if odds else np.full(len(d), 0.5)

    def score_texts(self, texts: pa.Array, compressors) -> np.ndarray:
        d = [self.differences(t.as_buffer().to_pybytes() if t.is_valid else b"", compressors) for t in texts]
        return self.scores(np.array(d).reshape(-1, len(self.dictionaries)))


def calibrate(d: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """(a, b) of the log odds a + b * d by weighted logistic regression, a ridge on the slope of the scaled difference."""
    mean, scale = d.mean(), d.std() + 1e-9
    x = np.column_stack([np.ones(len(d)), (d - mean) / scale])
    w, reg = np.zeros(2), np.array([1e-6, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(reg), x.T @ (weight * (y - p)) - reg * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / scale), float(w[1] / scale)


def _train(batches):
    """One task: the dictionaries of each fold and label."""
    rows = sorted((f, y, i, t.encode()) for b in batches for f, y, i, t in zip(*(b.column(c).to_pylist() for c in ("fold", "y", "id", "text")), strict=True))
    made = [(f, y, train_dictionary([t for g, z, _, t in rows if (g, z) == (f, y)])) for f in FOLDS for y in (0, 1)]
    yield pa.record_batch([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.binary())], ["fold", "y", "dictionary"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None) -> CompressionModel:
    """Fit on at most ``SAMPLE_ROWS`` rows of each label; ``learn``: condition on the column ``id``."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(learn) if learn is not None else known
    chosen = None
    for y in (0, 1):  # the smallest hashes of either label, with a fixed bound: a top-k, not a sort of everything
        part = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = text_rows(docs, id_col, text_col).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    # At most 2 * SAMPLE_ROWS rows from here on. Each label alternates between the folds.
    fold = (F.row_number().over(Window.partitionBy("y").orderBy("id")) % len(FOLDS)).alias("fold")
    sample = staged(rows.select("id", "y", fold, "text"), "quality-sample")
    trained = {(r.fold, r.y): bytes(r.dictionary) for r in sample.repartition(1).mapInArrow(_train, "fold int, y int, dictionary binary").collect()}
    model = CompressionModel([(trained.get((f, 1), b""), trained.get((f, 0), b"")) for f in FOLDS], [None for _ in FOLDS])
    held = spark.sparkContext.broadcast(model)

    def differ(batches):
        model = held.value
        tools = model.compressors()
        for b in batches:
            d = [model.differences((t or "").encode(), tools) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("fold"), b.column("y"), pa.array(d, pa.list_(pa.float64()))], ["fold", "y", "d"])

    found = sorted((r.fold, r.y, *r.d) for r in sample.mapInArrow(differ, "fold int, y int, d array<double>").collect())  # numbers only
    there = known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")
    labelled = {r.y: r.n for r in there.groupBy("y").agg(F.count("*").alias("n")).collect()}  # of all labels, not of the sample
    for f in FOLDS:  # the fold's dictionaries on the rows of the other fold
        y = np.array([r[1] for r in found if r[0] != f], float)
        if set(y) == {0.0, 1.0}:
            weight = np.where(y == 1, labelled[1] / (y == 1).sum(), labelled[0] / (y == 0).sum())
            model.lines[f] = calibrate(np.array([r[2 + f] for r in found if r[0] != f]), y, weight * len(y) / weight.sum())
    return model


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: one row per row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tools = model.compressors()
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(model.score_texts(batch.column("text").cast(pa.binary()), tools), pa.float64())], ["id", "score"])

    return text_rows(docs, id_col, text_col).mapInArrow(score, "id long, score double")


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=crc_mod("id", 5) != 0)
    return score_quality(docs, model).select(
        F.col("id").alias("doc_id"), F.coalesce(crc_mod("id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that the classifier does not reject, with the columns of ``docs``.

    An empty ``docs`` gives an empty result.
    """
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=crc_mod("id", 5) != 0)
    held, schema = spark.sparkContext.broadcast(model), docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        tools = model.compressors()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            yield batch.filter(pa.array(model.score_texts(texts, tools) >= 0.3))

    return docs.mapInArrow(keep, schema)
