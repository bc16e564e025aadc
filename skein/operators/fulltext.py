"""Full-text search: postings, the ``.matches`` mini-language, BM25.

An index of a field is two frames: ``docs(id, len)`` for every non-null value and ``postings(id, term, tf,
len, positions)``. Postings are sorted by term when saved, so a query reads the row groups of its terms.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TextQueryError
from ..functions.text import VERSIONS, analyze

K1, B = 1.2, 0.75
SLICE_ROWS, SLICE_PLACES = 64, 50_000  # texts that are Python strings at a time, and places of words in one batch
MAX_QUERY_BYTES, MAX_TERMS, MAX_PHRASE, MIN_PREFIX, MAX_EXPANSION = 16 * 1024, 256, 32, 2, 64


@dataclass(frozen=True)
class Clause:
    terms: tuple[str, ...]
    required: bool = False
    prefix: bool = False
    offsets: tuple[int, ...] = ()


@dataclass(frozen=True)
class TextQuery:
    clauses: tuple[Clause, ...]


def parse_text_query(raw: str, analyzer: str) -> TextQuery:
    if len(raw.encode()) > MAX_QUERY_BYTES:
        raise TextQueryError("the text query is too long")
    clauses: list[Clause] = []
    stops, i, n = 0, 0, len(raw)
    while i < n:
        if raw[i].isspace():
            i += 1
            continue
        required = raw[i] == "+"
        if required:
            i += 1
            if i >= n or raw[i].isspace():
                continue
        if raw[i] == '"':
            end = raw.find('"', i + 1)
            if end < 0:
                raise TextQueryError("unterminated phrase")
            phrase = raw[i + 1 : end]
            i = end + 1
            if "*" in phrase:
                raise TextQueryError(f"a phrase cannot hold a prefix: {phrase}")
            found = analyze(phrase, analyzer)
            stops += found.stops
            if len(found.terms) > MAX_PHRASE:
                raise TextQueryError(f"a phrase of more than {MAX_PHRASE} words")
            if found.terms:
                offsets = tuple(p - found.positions[0] for p in found.positions)
                clauses.append(Clause(found.terms, required, False, offsets if len(offsets) > 1 else ()))
        else:
            end = i
            while end < n and not raw[end].isspace() and raw[end] != '"':
                end += 1
            word = raw[i:end]
            i = end
            bare = word.rstrip("*")
            found = analyze(bare, analyzer)
            stops += found.stops
            terms, prefix = list(found.terms), None
            if bare != word:
                kept = analyze(bare, analyzer, keep_stops=True)
                last = kept.positions[-1] if kept.positions else None
                if last is None or last in found.positions:
                    prefix = kept.terms[-1] if kept.terms else ""
                    if len(prefix) < MIN_PREFIX:
                        raise TextQueryError(f"a prefix needs {MIN_PREFIX} characters: {word}")
                    terms.pop()
            clauses += [Clause((t,), required) for t in terms]
            if prefix is not None:
                clauses.append(Clause((prefix + "*",), required, True))
        if sum(len(c.terms) for c in clauses) > MAX_TERMS:
            raise TextQueryError(f"more than {MAX_TERMS} terms")
    if not clauses and not stops:
        raise TextQueryError("the text query holds no words")
    return TextQuery(tuple(clauses))


@dataclass
class TextIndex:
    docs: DataFrame
    postings: DataFrame
    analyzer: str
    positions: bool
    version: str = ""
    rows: DataFrame | None = None

    def save(self, folder: str) -> TextIndex:
        """Write the index, postings in ranges of their terms, and read it again; texts are cut into terms once."""
        spark = self.docs.sparkSession
        docs = self.docs.select("id", F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("tf"), "len", F.lit(None).cast("array<int>").alias("positions"))
        rows = self.rows if self.rows is not None else docs.unionByName(self.postings)
        rows.write.mode("overwrite").parquet(f"{folder}/cut")
        # The id takes part in the ranges, so a very frequent term is spread over several.
        cut = spark.read.parquet(f"{folder}/cut")
        cut.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/index")
        return TextIndex.of(spark.read.parquet(f"{folder}/index"), self.analyzer, self.positions, self.version)

    @classmethod
    def of(cls, rows: DataFrame, analyzer: str, positions: bool, version: str) -> TextIndex:
        """``rows``: id, term, tf, len, positions; the row without a term stands for the document itself."""
        return cls(rows.where("term is null").select("id", "len"), rows.where("term is not null"), analyzer, positions, version, rows)

    def stats(self) -> DataFrame:
        """``n, tokens``: documents (with no words, too) and kept tokens."""
        return self.docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))


def _texts(batches):
    """``(id, text)`` of Arrow batches; only a slice of a batch is Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield from zip(part.column("id").to_pylist(), part.column("value").to_pylist(), strict=True)


def index_rows(batches, analyzer: str, positions: bool):
    """Arrow batches of the index, each of about ``SLICE_PLACES`` words, however many texts come in at once."""
    types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    rows: tuple[list, ...] = ([], [], [], [], [])
    places = 0

    def made():
        return pa.record_batch([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["id", "term", "tf", "len", "positions"])

    for i, text in _texts(batches):
        found = analyze(text, analyzer)
        where: dict[str, list[int]] = {}
        for term, at in zip(found.terms, found.positions, strict=True):
            where.setdefault(term, []).append(at)
        # The row without a term stands for the document itself.
        for term, at in [(None, None), *where.items()]:
            for column, v in zip(rows, (i, term, len(at) if at else None, len(found.terms), at if positions else None), strict=True):
                column.append(v)
        places += len(found.terms) + 1
        if places >= SLICE_PLACES:
            yield made()
            rows, places = ([], [], [], [], []), 0
    if places:
        yield made()


def build_index(frame: DataFrame, column: str, analyzer: str = "simple", positions: bool = True) -> TextIndex:
    values = frame.select("id", F.col(column).alias("value")).where("value is not null")
    all_rows = values.mapInArrow(lambda batches: index_rows(batches, analyzer, positions), "id long, term string, tf int, len int, positions array<int>")
    return TextIndex.of(all_rows, analyzer, positions, VERSIONS[analyzer])


def _norm(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _in_places(got: list[Column], offsets: tuple[int, ...]) -> Column:
    """Whether some place of the first word has all others at their offsets from it."""

    def at(p):
        made = F.lit(True)
        for g, off in zip(got[1:], offsets[1:], strict=True):
            made &= F.array_contains(g["positions"], p + off)
        return made

    return F.exists(got[0]["positions"], at)


def search(index: TextIndex, text: str, k: int, candidates: DataFrame | None = None, corpus: DataFrame | None = None, max_expansion: int | None = MAX_EXPANSION, digits: int | None = None) -> DataFrame:
    """``id, score`` of the k best, by score then id.

    ``candidates`` (ids) restrict the ranking before the cut, with the statistics of the whole field;
    ``corpus`` (ids) restricts the statistics, too: what a reader may not see does not count.
    A prefix of more than ``max_expansion`` terms is refused; with None all its terms count, however many.
    ``digits``: scores are rounded to so many decimals before they are ranked, so that equal ones go by id.
    """
    query = parse_text_query(text, index.analyzer)
    spark = index.docs.sparkSession
    if not query.clauses:
        return spark.createDataFrame([], "id long, score float")
    if not index.positions and any(c.offsets for c in query.clauses):
        raise TextQueryError("a phrase needs stored positions")
    docs, postings = index.docs, index.postings
    if corpus is not None:
        docs, postings = (f.join(corpus.select("id"), "id", "left_semi") for f in (docs, postings))
    terms = sorted({t for c in query.clauses if not c.prefix for t in c.terms})
    prefixes = sorted({c.terms[0] for c in query.clauses if c.prefix})
    for p in prefixes if max_expansion is not None else ():
        more = postings.where(F.startswith("term", F.lit(p[:-1]))).select("term").distinct().limit(max_expansion + 1).count()
        if more > max_expansion:
            raise TextQueryError(f"{p} stands for more than {max_expansion} terms")
    parts = []
    if terms:
        parts.append(postings.where(F.col("term").isin(terms)).select("id", F.col("term").alias("key"), F.col("tf").cast("double").alias("tf"), "len", "positions"))
    for p in prefixes:
        expanded = postings.where(F.startswith("term", F.lit(p[:-1]))).groupBy("id").agg(F.sum("tf").cast("double").alias("tf"), F.max("len").alias("len"))
        parts.append(expanded.select("id", F.lit(p).alias("key"), "tf", "len", F.lit(None).cast("array<int>").alias("positions")))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    df = hits.groupBy("key").agg(F.count("*").cast("double").alias("df"))  # at most MAX_TERMS rows
    n = F.greatest(F.col("n").cast("double"), F.col("df"))
    average = F.when(F.col("tokens") > 0, F.col("tokens") / F.greatest(F.col("n"), F.lit(1))).otherwise(1.0)
    stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))
    weights = df.crossJoin(stats).select("key", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), average.alias("average"))
    if candidates is not None:
        hits = hits.join(candidates.select("id"), "id", "left_semi")
    scored = hits.join(F.broadcast(weights), "key").withColumn("w", F.col("idf") * _norm(F.col("tf"), F.col("len"), F.col("average")))
    entry = F.struct("key", F.struct("w", "positions"))
    by_doc = scored.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # one entry per key
    total, needed = F.lit(0.0), F.lit(True)
    for clause, times in Counter(query.clauses).items():
        got = [F.col("m")[F.lit(t)] for t in clause.terms]
        hit = got[0].isNotNull()
        for g in got[1:]:
            hit &= g.isNotNull()
        if clause.offsets:
            hit &= _in_places(got, clause.offsets)
        worth = F.lit(0.0)
        for t in dict.fromkeys(clause.terms):
            worth += F.col("m")[F.lit(t)]["w"]
        total += F.when(hit, worth * times).otherwise(0.0)
        if clause.required:
            needed &= F.coalesce(hit, F.lit(False))
    found = by_doc.where(needed).select("id", total.alias("score")).where("score > 0")
    ranked = found.select("id", (F.col("score") if digits is None else F.round("score", digits)).cast("float").alias("score"))
    return ranked.orderBy(F.col("score").desc(), "id").limit(k)
