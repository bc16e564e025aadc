"""Exact deduplication by a tree merge of sorted digest runs.

Every partition of the input forms one run: its distinct digests in sorted order, each with the best
(kept) row and the number of rows behind it. Digests are split by prefix into buckets, so no task ever
holds all of them. In each round a task receives the runs of ``2 ** ROUNDS_AT_ONCE`` neighbours of one
bucket - that many binomial rounds in a single exchange - merges them with a multiway merge, and checks
the runs' order and the digests' second fingerprint before it retains the best identifier. After
``log`` rounds one run per bucket is left. Answers travel back by (run, digest), never by digest alone,
so a text that a third of all rows share is spread over all runs.

Defined results: null text counts as empty; null ids lose against any id, and a class of null ids only
has a null ``keep_id``; among rows that repeat the winning id exactly one is kept; empty input gives an
empty result.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, text_rows

#: Binomial rounds that one exchange does: 2 ** 3 runs meet in a task.
ROUNDS_AT_ONCE = 3
#: Distinct digests that a bucket of the last round should hold.
BUCKET_ROWS = 200_000

_RUN = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("digest", pa.binary()), ("check", pa.int64()), ("n_bytes", pa.int64()), ("best", pa.int64()), ("best_seq", pa.int64()), ("size", pa.int64())])
_RUN_DDL = "bucket long, run long, digest binary, check long, n_bytes long, best long, best_seq long, size long"


def _better(a: tuple, b: tuple, largest: bool) -> tuple:
    """Of two (id, seq): a null id loses; ties go to the smaller seq."""
    if a[0] is None or b[0] is None:
        return min(a, b, key=lambda x: (x[0] is None, x[1]))
    sign = -1 if largest else 1
    return min(a, b, key=lambda x: (sign * x[0], x[1]))


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _RUN]
    return pa.table({f.name: pa.array(list(c), f.type) for f, c in zip(_RUN, columns, strict=True)}, schema=_RUN)


def _local_runs(buckets: int, largest: bool):
    def form(batches):
        classes: dict[tuple, list] = {}
        for batch in batches:
            for run, digest, check, n, i, seq in zip(*(batch.column(c).to_pylist() for c in ("run", "digest", "check", "n_bytes", "id", "seq")), strict=True):
                key = (run, digest, check, n)
                if (had := classes.get(key)) is None:
                    classes[key] = [(i, seq), 1]
                else:
                    had[0], had[1] = _better(had[0], (i, seq), largest), had[1] + 1
        rows = [(int.from_bytes(k[1][:8], "big") % buckets, k[0], *k[1:], *v[0], v[1]) for k, v in classes.items()]
        rows.sort(key=lambda r: (r[0], r[1], r[2], r[3], r[4]))
        for at in range(0, len(rows), 65_536):
            yield from _table(rows[at : at + 65_536]).to_batches()

    return form


def _merge_runs(largest: bool):
    """Merge the runs of one (bucket, group); the merged run gets the group's number."""

    def merge(key, table):
        bucket, group = (k.as_py() for k in key)
        at = {c: table.column(c).to_pylist() for c in ("run", "digest", "check", "n_bytes", "best", "best_seq", "size")}
        runs: dict[int, list] = {}
        for run, *row in zip(*at.values(), strict=True):
            runs.setdefault(run, []).append(row)
        for run in runs.values():
            run.sort(key=lambda r: (r[0], r[1], r[2]))  # an exchange does not keep the order; sorted input costs one pass
        out: list[tuple] = []
        for digest, check, n, best, seq, size in heapq.merge(*runs.values(), key=lambda r: (r[0], r[1], r[2])):
            if out and out[-1][2:5] == (digest, check, n):
                had = out[-1]
                out[-1] = (bucket, group, digest, check, n, *_better(had[5:7], (best, seq), largest), had[7] + size)
            else:
                if out and out[-1][2:5] > (digest, check, n):
                    raise ValueError("a digest run is out of order")
                out.append((bucket, group, digest, check, n, best, seq, size))
        return _table(out)

    return merge


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", seq_col: str | None = None) -> DataFrame:
    """One row per input row: ``id, seq, keep_id, group_size, kept, digest``.

    ``keep``: "max" or "min", the identifier that stays of each class of equal texts. Texts are equal
    when their SHA-256, their length and a second 64-bit fingerprint all agree. ``seq_col`` names a
    column of distinct longs that tells rows with the same identifier apart; without it they are numbered.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be 'max' or 'min', not {keep!r}")
    spark, largest = docs.sparkSession, keep == "max"
    raw = F.col("text").cast("binary")
    base = staged(
        text_rows(docs, id_col, text_col, (F.col(seq_col) if seq_col else F.monotonically_increasing_id()).alias("seq")).select(
            "id", F.unhex(F.sha2(raw, 256)).alias("digest"), F.xxhash64("text").alias("check"), F.octet_length("text").cast("long").alias("n_bytes"),
            F.spark_partition_id().cast("long").alias("run"), "seq",
        ),
        "exact",
    )
    rows, runs = base.agg(F.count("*"), F.coalesce(F.max("run"), F.lit(0)) + 1).first()
    buckets = max(4 * shuffle_partitions(spark), math.ceil(rows / BUCKET_ROWS))
    first = staged(base.mapInArrow(_local_runs(buckets, largest), _RUN_DDL), "exact-runs")
    merged, left = first, runs
    while True:
        fan = 2**ROUNDS_AT_ONCE
        merged = merged.withColumn("run", (F.col("run") / fan).cast("long")).groupBy("bucket", "run").applyInArrow(_merge_runs(largest), _RUN_DDL)
        left = math.ceil(left / fan)
        if left <= 1:
            break
    classes = merged.select("digest", "check", "n_bytes", F.col("best").alias("keep_id"), F.col("best_seq").alias("keep_seq"), F.col("size").alias("group_size"))
    key = ["digest", "check", "n_bytes"]
    by_run = first.select("run", *key).distinct().join(classes, key)
    return base.join(by_run, ["run", *key]).select("id", "seq", "keep_id", "group_size", (F.col("seq") == F.col("keep_seq")).alias("kept"), "digest")


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def dedup_exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of ``docs`` that stay, with the columns of ``docs``."""
    numbered = staged(docs.withColumn("_skein_row", F.monotonically_increasing_id()), "exact-in")
    kept = dedup_exact(numbered, seq_col="_skein_row").where("kept").select(F.col("seq").alias("_skein_row"))
    return numbered.join(kept, "_skein_row", "left_semi").select(*docs.columns)
