"""From the query tree to a lazy DataFrame.

A stage is a frame of objects with its type and, once it matters, its order. Hops are semi joins, filters are
``where``, ranked steps restrict the candidates before they cut. Order is only imposed where a limit or an
offset would otherwise choose arbitrary rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument, ObjectNotFound, QueryTypeError
from ..operators import fulltext, vectors
from ..operators.links import hop
from ..operators.rules import NOBODY, Principal, Rules
from ..sources.catalog import Catalog
from ..sources.paths import scratch
from . import ast as A
from .governor import Governor
from .predicates import PRESENT, to_column, validate

SCORES = ("score", "rerank_score")


@dataclass
class Context:
    catalog: Catalog
    governor: Governor = field(default_factory=Governor)
    rules: Rules | None = None
    principal: Principal = NOBODY
    indexes: dict[tuple[str, str], fulltext.TextIndex] = field(default_factory=dict)
    vector_indexes: dict[tuple[str, str], vectors.VectorIndex] = field(default_factory=dict)
    embedders: dict = field(default_factory=dict)  # model -> function of a list of texts
    rerankers: dict = field(default_factory=dict)  # model -> function of (query, list of texts)
    default_rerank: int | None = None
    score_digits: int | None = None  # decimals by which text scores are ranked

    def read(self, df: DataFrame, type_name: str) -> DataFrame:
        return df if self.rules is None else self.rules.readable(df, type_name, self.principal, self.catalog)


@dataclass
class Stage:
    df: DataFrame
    type_name: str
    order: list[Column] | None = None
    whole: bool = False  # all objects of the type
    scores: tuple[str, ...] = ()

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*(self.order or [F.col("id")]))


def compile_query(q: A.Query, ctx: Context) -> DataFrame:
    """The result frame of a reading query: ``id``, the type's scalars, and scores of ranked steps."""
    stage = run_steps(source(q, ctx), q.steps, ctx)
    return result(stage, ctx)


def result(stage: Stage, ctx: Context) -> DataFrame:
    t = ctx.catalog.schema.types[stage.type_name]
    return stage.df.select("id", *(f.name for f in t.scalars), *stage.scores)


def source(q: A.Query, ctx: Context) -> Stage:
    frame = ctx.catalog.frame(q.type_name)
    t = ctx.catalog.schema.types[q.type_name]
    if isinstance(q.source, A.Get):
        found = frame.where(F.col("id") == q.source.id)
        if found.limit(1).count() == 0:
            raise ObjectNotFound(f"{q.type_name} {q.source.id}")
        return Stage(ctx.read(found, q.type_name), q.type_name)
    if isinstance(q.source, A.Filter):
        ctx.governor.check_scan(frame)
        df, order = filtered(frame, t, q.source.predicate, ctx)
        return Stage(ctx.read(df, q.type_name), q.type_name, order)
    if isinstance(q.source, A.All):
        ctx.governor.check_scan(frame)
        return Stage(ctx.read(frame, q.type_name), q.type_name, whole=ctx.rules is None)
    raise InvalidArgument("this query changes data; run it through the engine")


def filtered(frame: DataFrame, t, predicate, ctx: Context) -> tuple[DataFrame, list[Column] | None]:
    validate(predicate, t)
    order = None
    if isinstance(predicate, A.Compare) and predicate.value is not None:
        f = t.fields.get(predicate.path)
        if f is not None and f.indexed:  # one comparison on an indexed field comes in the order of its values
            order = [F.col(f.name), F.col("id")]
    return frame.where(to_column(predicate, t, PRESENT in frame.columns)), order


def run_steps(stage: Stage, steps, ctx: Context) -> Stage:
    hops = 0
    for step in steps:
        if isinstance(step, A.Traverse):
            hops += 1
            ctx.governor.check_depth(hops)
            df, name = hop(ctx.catalog, stage.df, stage.type_name, step.field)
            stage = Stage(ctx.read(df, name), name)
        elif isinstance(step, A.Filter):
            t = ctx.catalog.schema.types[stage.type_name]
            df, _ = filtered(stage.df, t, step.predicate, ctx)
            stage = replace(stage, df=df, whole=False)
        elif isinstance(step, A.Limit):
            stage = replace(stage, df=stage.ordered().limit(ctx.governor.clamp(step.n)), whole=False)
        elif isinstance(step, A.Offset):
            stage = replace(stage, df=stage.ordered().offset(step.n), whole=False)
        elif isinstance(step, A.Matches):
            stage = _matches(stage, step, ctx)
        elif isinstance(step, A.Similar):
            stage = _similar(stage, step, ctx)
        else:
            raise InvalidArgument(f"{type(step).__name__.lower()} changes data; run it through the engine")
    return stage


def _ranked(stage: Stage, hits: DataFrame, order: list[Column], scores: tuple[str, ...]) -> Stage:
    """The objects of ``hits``, whose number is bounded by k; their scores go with them."""
    frame = stage.df.drop(*SCORES)
    return Stage(frame.join(F.broadcast(hits), "id"), stage.type_name, order, scores=scores)


def _matches(stage: Stage, step: A.Matches, ctx: Context) -> Stage:
    t = ctx.catalog.schema.types[stage.type_name]
    f = t.fields.get(step.field)
    if f is None or not f.fulltext:
        raise InvalidArgument(f"{t.name}.{step.field} has no full-text index")
    index = ctx.indexes.get((t.name, step.field))
    if index is None:
        # Built once for this version of the catalog, and kept for the queries that follow.
        made = fulltext.build_index(ctx.catalog.frame(t.name), step.field, f.fulltext.analyzer, f.fulltext.positions)
        index = ctx.indexes[t.name, step.field] = made.save(scratch(made.docs.sparkSession, "fulltext"))
    ids = None if stage.whole else stage.df.select("id")
    readable = ctx.read(ctx.catalog.frame(t.name), t.name).select("id") if ctx.rules is not None else None
    hits = fulltext.search(index, step.text, ctx.governor.clamp(step.k), ids, readable, ctx.governor.max_expansion, ctx.score_digits)
    return _ranked(stage, hits, [F.col("score").desc(), F.col("id")], ("score",))


def _similar(stage: Stage, step: A.Similar, ctx: Context) -> Stage:
    t = ctx.catalog.schema.types[stage.type_name]
    f = t.fields.get(step.field)
    if f is None or f.kind != "vector":
        raise InvalidArgument(f"{t.name}.{step.field} is no vector field")
    text = step.query if isinstance(step.query, str) else None
    query = step.query
    if text is not None:
        if not f.vectorize or f.vectorize[1] not in ctx.embedders:
            raise InvalidArgument(f"{t.name}.{step.field} has no model that embeds text")
        query = [float(x) for x in ctx.embedders[f.vectorize[1]]([text])[0]]
    if len(query) != f.dim:
        raise QueryTypeError(f"{t.name}.{step.field} has {f.dim} dimensions, the query {len(query)}")
    metric = f.index.metric if f.index else "cosine"
    k = ctx.governor.clamp(step.k)
    plan = vectors.resolve(k, step.ef, step.rerank, not stage.whole, ctx.default_rerank)
    ids = None if stage.whole else stage.df.select("id")
    model = f.vectorize[1] if f.vectorize else None
    if text is not None and model in ctx.rerankers:
        pool = max(min(3 * k, 48), k)
        near = vectors.nearest(ctx.catalog.vector_frame(t.name, f.name), query, pool, metric, ids)
        hits = rerank(near, ctx.catalog.frame(t.name), f.vectorize[0], text, ctx.rerankers[model], k)
        return _ranked(stage, hits, [F.col("rerank_score").desc_nulls_last(), F.col("score"), F.col("id")], SCORES)
    index = ctx.vector_indexes.get((t.name, f.name))
    if index is not None and ids is None:
        return _ranked(stage, vectors.search_index(index, query, plan), [F.col("score"), F.col("id")], ("score",))
    # Without an index, and for a restricted set, the search is exact: as good as any width and pool.
    hits = vectors.nearest(ctx.catalog.vector_frame(t.name, f.name), query, k, metric, ids)
    return _ranked(stage, hits, [F.col("score"), F.col("id")], ("score",))


def rerank(near: DataFrame, frame: DataFrame, source_field: str, text: str, score, k: int) -> DataFrame:
    """``near`` (a bounded pool) ordered by a cross-encoder; rows that it cannot score come after, by distance."""

    def run(batches):
        for pdf in batches:
            values = [None if t is None else s for t, s in zip(pdf["text"], score(text, [t or "" for t in pdf["text"]]), strict=True)]
            yield pdf.assign(rerank_score=values)[["id", "score", "rerank_score"]]

    pool = frame.select("id", F.col(source_field).alias("text")).join(F.broadcast(near), "id").select("id", "score", "text")
    scored = pool.mapInPandas(run, "id long, score float, rerank_score float")
    return scored.orderBy(F.col("rerank_score").desc_nulls_last(), "score", "id").limit(k)
