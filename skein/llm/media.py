"""Media columns: texts or other bytes stored losslessly as FLAC, read back as PCM blocks.

``to_flac`` appends a media column; ``pcm_blocks`` gives one row per block of a media column with its
sample offset and checks header and frame checksums and the stream's MD5; ``read_range`` seeks to a
sample range and decodes only the frames that hold it.

Defined results: null counts as empty, and an empty payload is padded to 64 zero bytes; equal bytes give
equal media; a damaged stream raises ``FlacError``; other columns are kept out of the way by name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import text_rows

#: Payload bytes that are coded or decoded at once, which bounds a worker's memory; a longer text is alone.
CODE_BYTES, READ_BYTES = 1 << 19, 1 << 21
PAD = 64


def padded(data: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def _groups(items: list[bytes], bound: int) -> Iterator[slice]:
    at = total = 0
    for i, x in enumerate(items):
        if i > at and total + len(x) > bound:
            yield slice(at, i)
            at, total = i, 0
        total += len(x)
    if at < len(items):
        yield slice(at, len(items))


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def encode_all(payloads: list[bytes]) -> list[bytes]:
    return [m for g in _groups(payloads, CODE_BYTES) for m in flac.encode_many(payloads[g])]


def features(payload: bytes) -> str:
    """Whole-number signal features of 8-bit PCM: samples, sum, energy, zero crossings, least, most."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    sign = x >= 0
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={(sign[1:] != sign[:-1]).sum()};min={x.min()};max={x.max()}"


def to_flac(df: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: the padded bytes of ``data_col`` as a FLAC stream."""

    def code(batches):
        for batch in batches:
            data = _bytes(batch.column("text"))
            ids = batch.column("id")
            for g in _groups(data, READ_BYTES):
                media = encode_all([padded(x) for x in data[g]])
                yield pa.record_batch([ids[g], pa.array([len(x) for x in data[g]], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(data_col).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(code, "id long, n_bytes long, media binary")


def pcm_blocks(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per PCM block: ``id, block, first_sample, n_samples, media_offset, pcm`` (unsigned bytes)."""
    types = [*[pa.int64()] * 5, pa.binary()]

    def read(batches):
        for batch in batches:
            media = _bytes(batch.column("media"))
            ids = batch.column("id").to_pylist()
            for g in _groups(media, READ_BYTES):
                rows = []
                for i, m, payload in zip(ids[g], media[g], flac.decode_many(media[g]), strict=True):
                    info = flac.Stream(m)
                    rows += [(i, b, s, n, o + info.frames_at, payload[s : s + n]) for b, (s, o, n) in enumerate(info.frames(m).tolist())]
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["id", "block", "first_sample", "n_samples", "media_offset", "pcm"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).where("media is not null")
    return rows.mapInArrow(read, "id long, block long, first_sample long, n_samples long, media_offset long, pcm binary")


def read_range(df: DataFrame, first: int, count: int, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """``id, pcm``: samples ``first`` to ``first + count`` of each stream, found by its seek table."""

    def read(batches):
        for batch in batches:
            media = _bytes(batch.column("media"))
            pcm = [x for g in _groups(media, READ_BYTES) for x in flac.read_many(media[g], [first] * len(media[g]), [count] * len(media[g]))]
            yield pa.record_batch([batch.column("id"), pa.array(pcm, pa.binary())], ["id", "pcm"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).where("media is not null")
    return rows.mapInArrow(read, "id long, pcm binary")


_DIGEST = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks long, seek_crc32 long"


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as FLAC, read the stored bytes back as PCM blocks, and describe both.

    ``blocks`` counts the blocks; ``seek_crc32`` is that of the block in the middle, read alone by its offset.
    """

    def run(batches):
        for batch in batches:
            texts = _bytes(batch.column("text"))
            ids = batch.column("id")
            for g in _groups(texts, READ_BYTES):
                media = encode_all([padded(x) for x in texts[g]])
                back = flac.decode_many(media)
                frames = [flac.Stream(m).frames(m) for m in media]
                middle = [f[len(f) // 2] for f in frames]
                sought = [zlib.crc32(x) for x in flac.read_many(media, [int(f["s"]) for f in middle], [int(f["n"]) for f in middle])]
                yield pa.record_batch(
                    [
                        ids[g], pa.array([len(x) for x in texts[g]], pa.int64()), pa.array([len(x) for x in back], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-PAD:]) for x in back], pa.int64()),
                        pa.array([len(x) for x in media], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in media]), pa.array([features(x) for x in back]),
                        pa.array([len(f) for f in frames], pa.int64()), pa.array(sought, pa.int64()),
                    ],
                    ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "blocks", "seek_crc32"],
                )

    return text_rows(docs, id_col, text_col).mapInArrow(run, _DIGEST)


def op1_flac_media(spark, sf_dir: str) -> DataFrame:
    return store_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
