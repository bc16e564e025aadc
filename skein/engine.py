"""The engine: a catalog, its rules and limits, and queries as text."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgument, PermissionDenied
from .operators import mutate
from .operators.fulltext import TextIndex, build_index
from .operators.rules import NOBODY, Principal, Rules
from .operators.vectors import VectorIndex, build_vector_index, ingest
from .plans import ast as A
from .plans.compiler import Context, Stage, compile_query, run_steps, source
from .plans.governor import Governor
from .plans.parser import parse_query
from .sources.catalog import Catalog
from .sources.paths import scratch
from .sources.store import Store

_WRITES = (A.Update, A.Delete, A.Link, A.Unlink)


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, rules: Rules | str | None = None, governor: Governor | None = None, store: Store | None = None, embedders: dict | None = None, rerankers: dict | None = None, score_digits: int | None = None):
        self.spark, self.store = spark, store
        if isinstance(rules, str):
            rules = Rules.parse(rules, catalog.schema)
        self.ctx = Context(catalog, governor or Governor(), rules, embedders=embedders or {}, rerankers=rerankers or {}, score_digits=score_digits)
        self.changes: list[DataFrame] = []
        self._next_id: int | None = None
        self._prepared: dict[int, A.Query] = {}

    @property
    def catalog(self) -> Catalog:
        return self.ctx.catalog

    @classmethod
    def open(cls, spark: SparkSession, root: str, **more) -> Engine:
        store = Store(spark, root)
        return cls(spark, store.load(), store=store, **more)

    # Reading and writing by text.
    def query(self, text: str, principal: Principal = NOBODY, origin: int | None = None) -> DataFrame:
        """Rows of the query; a change is committed before this returns, and gives the objects it wrote."""
        return self.run(parse_query(text), principal, origin)

    def prepare(self, text: str) -> int:
        """A handle for a parsed query; there are no parameters."""
        q = parse_query(text)
        handle = len(self._prepared)
        if handle >= 1024:
            raise InvalidArgument("too many prepared queries")
        self._prepared[handle] = q
        return handle

    def execute(self, handle: int, principal: Principal = NOBODY) -> DataFrame:
        if handle not in self._prepared:
            raise InvalidArgument(f"no prepared query {handle}")
        return self.run(self._prepared[handle], principal)

    def run(self, q: A.Query, principal: Principal = NOBODY, origin: int | None = None) -> DataFrame:
        ctx = replace(self.ctx, principal=principal)
        if isinstance(q.source, (A.Create, A.CreateBatch)):
            rows = [dict(q.source.fields)] if isinstance(q.source, A.Create) else [dict(r) for r in q.source.rows]
            for r in rows:
                self._gate_create(q.type_name, r, ctx)
            made = self._commit(mutate.create(self.catalog, q.type_name, rows, self.next_id(), origin))
            if q.steps:
                raise InvalidArgument("nothing follows create")
            return ctx.read(made, q.type_name) if ctx.rules is None else made.join(ctx.read(self.catalog.frame(q.type_name), q.type_name).select("id"), "id", "left_semi")
        writes = [i for i, s in enumerate(q.steps) if isinstance(s, _WRITES)]
        if not writes:
            return compile_query(q, ctx)
        if writes != [len(q.steps) - 1]:
            raise InvalidArgument("a change is the last step")
        stage = run_steps(source(q, ctx), q.steps[:-1], ctx)
        return self._write(stage, q.steps[-1], ctx, origin)

    def collect(self, text: str, principal: Principal = NOBODY) -> list:
        """Rows on the driver, within the governor's limits."""
        return self.ctx.governor.collect(self.query(text, principal))

    def _write(self, stage: Stage, step, ctx: Context, origin: int | None) -> DataFrame:
        name, ids = stage.type_name, stage.df.select("id")
        op = "delete" if isinstance(step, A.Delete) else "update"
        if ctx.rules is not None:
            request = dict(step.fields) if isinstance(step, A.Update) else {}
            frame = self.catalog.frame(name).join(ids, "id", "left_semi")
            denied = ctx.rules.allowed(frame, name, op, ctx.principal, self.catalog, request).where("not _allowed").limit(1).count()
            if denied:
                raise PermissionDenied(f"{op} {name}")
        if isinstance(step, A.Update):
            return self._commit(mutate.update(self.catalog, name, ids, dict(step.fields), origin))
        if isinstance(step, A.Delete):
            self._commit(mutate.delete(self.catalog, name, ids, origin))
        else:
            edge = dict(step.fields) if isinstance(step, A.Link) else None
            self._commit(mutate.link(self.catalog, name, ids, step.target_type, step.target_id, edge, unlink=isinstance(step, A.Unlink)))
        t = self.catalog.schema.types[name]
        return self.catalog.frame(name).select("id", *(f.name for f in t.scalars)).limit(0)

    def _gate_create(self, type_name: str, fields: dict, ctx: Context) -> None:
        if ctx.rules is None:
            return
        one = self.spark.range(1)
        t = self.catalog.schema.type(type_name)
        one = one.select("id", *(F.lit(None).cast(f.spark_type).alias(f.name) for f in t.scalars))
        if not ctx.rules.allowed(one, type_name, "create", ctx.principal, self.catalog, fields).where("_allowed").count():
            raise PermissionDenied(f"create {type_name}")

    def next_id(self) -> int:
        """Ids are given once over all types; a store keeps the next one, other catalogs are searched for the greatest."""
        if self._next_id is None:
            kept = self.store.manifest() if self.store is not None else {"version": 0, "next_id": 1}
            tops = [df.agg(F.max("id")).first()[0] for df in self.catalog.objects.values()] if not kept["version"] else []
            self._next_id = max([kept["next_id"], 1, *(t + 1 for t in tops if t is not None)])
        return self._next_id

    def _commit(self, m: mutate.Mutation) -> DataFrame | None:
        if m.next_id is not None:
            self._next_id = m.next_id
        ids = None
        if self.store is not None:
            if m.result is not None:  # the frames it comes from are of the version before
                path = scratch(self.spark, "result")
                m.result.write.parquet(path)
                ids = self.spark.read.schema(m.result.schema).parquet(path)
            catalog = self.store.commit(m.catalog, m.changed, self.next_id(), m.changes)
        else:
            catalog = replace(m.catalog, version=self.catalog.version + 1)
            if m.changes is not None:
                self.changes.append(m.changes.withColumn("version", F.lit(catalog.version).cast("long")))
        self.ctx.catalog = catalog
        # Indexes of changed types are out of date.
        self.ctx.indexes = {k: v for k, v in self.ctx.indexes.items() if f"o:{k[0]}" not in m.changed}
        self.ctx.vector_indexes = {(t, f): v for (t, f), v in self.ctx.vector_indexes.items() if not {f"o:{t}", f"v:{t}:{f}"} & m.changed}
        return ids if ids is not None else m.result

    # Other operations.
    def index_text(self, type_name: str, field: str, folder: str | None = None) -> TextIndex:
        """Build the full-text index of a field, saved in ``folder`` if one is given, and use it from now on."""
        f = self.catalog.schema.type(type_name).fields[field]
        if not f.fulltext:
            raise InvalidArgument(f"{type_name}.{field} has no @fulltext")
        index = build_index(self.catalog.frame(type_name), field, f.fulltext.analyzer, f.fulltext.positions)
        self.ctx.indexes[type_name, field] = index.save(folder) if folder else index
        return self.ctx.indexes[type_name, field]

    def index_vectors(self, type_name: str, field: str, folder: str | None = None) -> VectorIndex:
        """Build the index of a vector field; unrestricted searches use it from now on, until the vectors change."""
        f = self.catalog.schema.type(type_name).fields.get(field)
        if f is None or f.kind != "vector":
            raise InvalidArgument(f"{type_name} has no vector field {field}")
        metric = f.index.metric if f.index else "cosine"
        index = build_vector_index(self.catalog.vector_frame(type_name, field), f.dim, metric, folder or scratch(self.spark, "vectors"))
        self.ctx.vector_indexes[type_name, field] = index
        return index

    def ingest_vectors(self, type_name: str, field: str, rows: DataFrame) -> None:
        f = self.catalog.schema.type(type_name).fields.get(field)
        if f is None or f.kind != "vector":
            raise InvalidArgument(f"{type_name} has no vector field {field}")
        had = self.catalog.vectors.get((type_name, field))
        had = had if had is not None else self.spark.createDataFrame([], "id long, vec array<float>")
        grown = ingest(had, rows, f.dim)
        self._commit(mutate.Mutation(replace(self.catalog, vectors=self.catalog.vectors | {(type_name, field): grown}), {f"v:{type_name}:{field}"}))

    def embed_missing(self, type_name: str, field: str) -> DataFrame:
        """Vectors of the objects whose text has none yet, by the field's model; put in and returned."""
        f = self.catalog.schema.type(type_name).fields[field]
        model = self.ctx.embedders[f.vectorize[1]]
        had = self.catalog.vectors.get((type_name, field))
        todo = self.catalog.frame(type_name).where(F.col(f.vectorize[0]).isNotNull())
        if had is not None:
            todo = todo.join(had.select("id"), "id", "left_anti")

        def run(batches):
            for pdf in batches:
                yield pdf.assign(vec=[[float(x) for x in v] for v in model(list(pdf["text"]))])[["id", "vec"]]

        made = todo.select("id", F.col(f.vectorize[0]).alias("text")).mapInPandas(run, "id long, vec array<float>")
        self.ingest_vectors(type_name, field, made)
        return made

    def count(self, type_name: str) -> int:
        return self.catalog.frame(type_name).count()

    def scan_chunk(self, type_name: str, after: int | None, n: int, columns: list[str] | None = None) -> DataFrame:
        """The next ``n`` objects by id after a cursor."""
        t = self.catalog.schema.type(type_name)
        df = self.catalog.frame(type_name)
        df = df if after is None else df.where(F.col("id") > after)
        return df.orderBy("id").limit(n).select("id", *(columns or [f.name for f in t.scalars]))

    def filter_bytes(self, type_name: str, field: str, op: str, value: bytes) -> DataFrame:
        """Exact and range comparison of a Bytes field, which the language does not have."""
        f = self.catalog.schema.type(type_name).fields.get(field)
        if f is None or f.scalar != "Bytes" or op not in ("==", "<", "<=", ">", ">="):
            raise InvalidArgument(f"{type_name}.{field} {op}")
        c, v = F.col(field), F.lit(bytearray(value))
        made = {"==": c == v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[op]
        t = self.catalog.schema.types[type_name]
        return self.catalog.frame(type_name).where(made).select("id", *(x.name for x in t.scalars))

    def change_log(self) -> DataFrame:
        """All committed change events."""
        if self.store is not None:
            from .streaming.changes import EVENT

            return self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(self.store.publish())
        out = self.spark.createDataFrame([], "kind string, type string, id long, origin long, fields string, version long")
        for c in self.changes:
            out = out.unionByName(c)
        return out

    def reload_rules(self, text: str | None) -> None:
        self.ctx.rules = Rules.parse(text, self.catalog.schema) if text else None

    def status(self) -> dict:
        c = self.catalog
        return {
            "version": c.version, "digest": c.schema.digest(), "types": sorted(c.objects), "vectors": sorted(f"{t}.{f}" for t, f in c.vectors),
            "fulltext": {f"{t}.{f}": {"analyzer": i.analyzer, "version": i.version, "positions": i.positions} for (t, f), i in self.ctx.indexes.items()},
            "vector_indexes": {f"{t}.{f}": {"lists": len(i.centres), "rows": int(i.sizes.sum()), "metric": i.metric} for (t, f), i in self.ctx.vector_indexes.items()},
            "prepared": len(self._prepared), "rules": self.ctx.rules is not None,
        }

    def health(self) -> bool:
        return self.spark.range(1).count() == 1
