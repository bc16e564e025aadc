"""Vector search: exact distances as column expressions, top k by (distance, id), and an index of inverted lists.

The index cuts the vectors into lists around centres; a search reads the lists nearest to the query, ranks their
rows by one-byte codes, and rescores the best of them exactly. ``ef`` sets how many rows are read, ``rerank``
how many are rescored.

All distances are lower for what is closer: squared Euclidean, one minus the cosine (1 where a norm is 0),
and the negated dot product. Sums are in double; the score is a float.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXACT_BOUND = 10_000
#: Rows that the centres of an index are fitted on, at most - every row is indexed -, their number, and rounds of fitting.
SAMPLE_ROWS, MAX_LISTS, ROUNDS = 20_000, 4_096, 10
#: Rows that a search reads for each of ``ef``.
ROWS_PER_EF = 64


def _array(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def distance(vec: Column, query, metric: str) -> Column:
    """Distance of a float array column to a vector of numbers, as double."""
    q = _array(query)
    v = F.transform(vec, lambda x: x.cast("double"))
    if metric == "l2":
        return _sum(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)))
    dot = _sum(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "dot":
        return -dot
    own = _sum(F.transform(v, lambda a: a * a))
    theirs = sum(float(x) * float(x) for x in query)
    return F.when((own == 0) | F.lit(theirs == 0), F.lit(1.0)).otherwise(1.0 - dot / (F.sqrt(own) * F.lit(theirs**0.5)))


@dataclass(frozen=True)
class SearchPlan:
    """What the arguments of a search ask for; the exact search answers all of them, the index reads what they say."""

    k: int
    ef: int
    pool: int
    rerank: int | None


def resolve(k: int, ef: int | None = None, rerank: int | None = None, restricted: bool = False, default_rerank: int | None = None) -> SearchPlan:
    search = 4 * k if restricted else k
    chosen = default_rerank if rerank is None else rerank
    pool = max(search, chosen or 0)
    width = ef if ef is not None else (max(k, 50) if pool == k else max(2 * pool, 64))
    return SearchPlan(k, min(max(width, 1), EXACT_BOUND), min(pool, EXACT_BOUND), chosen)


def nearest(vectors: DataFrame, query, k: int, metric: str, candidates: DataFrame | None = None) -> DataFrame:
    """``id, score`` of the k nearest; with ``candidates`` (ids) these alone are ranked, and those without a
    usable vector come last at an infinite distance."""
    dim = len(query)
    good = F.coalesce((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)), F.lit(False))
    if candidates is None:
        rows = vectors.where(good)
    else:
        rows = candidates.select("id").join(vectors.select("id", "vec"), "id", "left")
    score = F.when(good, distance(F.col("vec"), query, metric)).otherwise(F.lit(float("inf")))
    return rows.select("id", score.cast("float").alias("score")).orderBy("score", "id").limit(k)


def _matrix(column, metric: str) -> np.ndarray:
    """The vectors of an Arrow column, row by row; for the cosine they are brought to length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(column), -1)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    return x


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([(half - x[a : a + 4096] @ centres.T).argmin(1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def fit_centres(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Lloyd's rounds from rows chosen at random; a centre that loses all rows stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(ROUNDS):
        own = _nearest_centre(x, centres)
        order = np.argsort(own, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(own[order]) != 0]))
        centres[own[order[at]]] = np.add.reduceat(x[order], at, axis=0) / np.diff(np.concatenate([at, [len(x)]]))[:, None]
    return centres


@dataclass
class VectorIndex:
    """``rows``: (list, id, vec, code, scale), sorted by list; the centres and the lists' sizes, both of bounded number."""

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    metric: str

    def lists_for(self, query, rows: int) -> list[int]:
        """The lists nearest to the query that together hold ``rows`` rows."""
        q = np.asarray(query, np.float32)
        if self.metric == "cosine":
            q = q / max(float(np.linalg.norm(q)), 1e-30)
        gap = -(self.centres @ q) if self.metric == "dot" else (self.centres * self.centres).sum(1) / 2 - self.centres @ q
        order = np.argsort(gap, kind="stable")
        return order[: int(np.searchsorted(np.cumsum(self.sizes[order]), rows)) + 1].tolist()


def open_vector_index(spark: SparkSession, folder: str, metric: str) -> VectorIndex:
    found = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r.list)
    rows = spark.read.parquet(f"{folder}/rows")
    sizes = np.zeros(len(found), np.int64)
    for r in rows.groupBy("list").agg(F.count("*").alias("n")).collect():  # at most MAX_LISTS
        sizes[r.list] = r.n
    return VectorIndex(rows, np.array([r.centre for r in found], np.float32), sizes, metric)


def build_vector_index(vectors: DataFrame, dim: int, metric: str, folder: str, lists: int | None = None) -> VectorIndex:
    """Index all usable rows of ``vectors`` (id, vec) in ``folder``; the centres come from SAMPLE_ROWS rows by a hash of the id."""
    spark = vectors.sparkSession
    good = vectors.where(F.coalesce((F.size("vec") == dim) & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x)), F.lit(False))).select("id", F.col("vec").cast("array<float>").alias("vec"))
    n = good.count()
    lists = max(1, min(MAX_LISTS, round(n**0.5))) if lists is None else lists

    def fit(batches):
        x = [_matrix(b.column("vec"), metric) for b in batches if b.num_rows]
        if x:
            centres = fit_centres(np.concatenate(x), lists)
            yield pa.record_batch([pa.array(range(len(centres)), pa.int32()), pa.array(list(centres), pa.list_(pa.float32()))], ["list", "centre"])

    sample = good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).repartition(1).sortWithinPartitions("id")
    sample.mapInArrow(fit, "list int, centre array<float>").write.mode("overwrite").parquet(f"{folder}/centres")
    found = sorted(spark.read.parquet(f"{folder}/centres").collect(), key=lambda r: r.list)
    held = spark.sparkContext.broadcast(np.array([r.centre for r in found], np.float32).reshape(-1, dim))  # MAX_LISTS x dim

    def assign(batches):
        for b in batches:
            x = _matrix(b.column("vec"), metric) if b.num_rows else np.zeros((0, dim), np.float32)
            scale = np.maximum(np.abs(x).max(1, initial=0), 1e-30) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            columns = [pa.array(_nearest_centre(x, held.value), pa.int32()), b.column("id"), b.column("vec"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale, pa.float32())]
            yield pa.record_batch(columns, ["list", "id", "vec", "code", "scale"])

    rows = good.mapInArrow(assign, "list int, id long, vec array<float>, code binary, scale float")
    # The id takes part in the ranges, so a long list is spread over several files.
    rows.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.mode("overwrite").parquet(f"{folder}/rows")
    return open_vector_index(spark, folder, metric)


def search_index(index: VectorIndex, query, plan: SearchPlan) -> DataFrame:
    """``id, score`` of about the k nearest: codes choose the pool, exact distances its order."""
    if not len(index.centres):
        return index.rows.select("id", F.lit(0.0).cast("float").alias("score")).limit(0)
    pool = max(plan.pool, 2 * plan.k)
    near = index.rows.where(F.col("list").isin(index.lists_for(query, max(plan.ef * ROWS_PER_EF, pool))))
    q, metric = np.asarray(query, np.float32), index.metric
    if metric == "cosine":
        q = q / max(float(np.linalg.norm(q)), 1e-30)

    def rank(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1) * b.column("scale").to_numpy()[:, None]
            gap = -(x @ q) if metric != "l2" else ((x - q) ** 2).sum(1)
            best = np.argsort(gap, kind="stable")[:pool]
            yield pa.record_batch([b.column("id").take(pa.array(best)), pa.array(gap[best], pa.float32())], ["id", "gap"])

    chosen = near.select("id", "code", "scale").mapInArrow(rank, "id long, gap float").orderBy("gap", "id").limit(pool).select("id")
    score = distance(F.col("vec"), query, metric).cast("float").alias("score")
    return near.select("id", "vec").join(F.broadcast(chosen), "id", "left_semi").select("id", score).orderBy("score", "id").limit(plan.k)


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of ``truth``'s ids that ``found`` has."""
    hit = truth.select("id").join(found.select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return hit.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def rank_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's correlation of two columns over a bounded sample of pairs; ties get their mean rank."""
    from pyspark.sql import Window

    def rank(c):
        w = Window.orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0

    return pairs.select(rank(a).alias("x"), rank(b).alias("y")).agg(F.corr("x", "y").alias("correlation"))


def ingest(vectors: DataFrame, more: DataFrame, dim: int) -> DataFrame:
    """``vectors`` with the rows (id, vec) of ``more`` put in or replaced; all are checked before any is taken."""
    from ..errors import QueryTypeError

    fits = F.coalesce((F.size("vec") == dim) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    bad = more.where(~fits | F.col("id").isNull()).select("id").limit(1).collect()
    if bad:
        raise QueryTypeError(f"vector of object {bad[0].id}: {dim} finite numbers are needed")
    more = more.select("id", F.col("vec").cast("array<float>").alias("vec"))
    return vectors.join(more.select("id"), "id", "left_anti").select("id", "vec").unionByName(more)
