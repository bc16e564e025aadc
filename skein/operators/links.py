"""Links between objects: hops with set semantics, and link reads in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArgument
from ..sources.catalog import Catalog


def hop(catalog: Catalog, objects: DataFrame, type_name: str, name: str) -> tuple[DataFrame, str]:
    """Objects that ``objects`` (or plain ids) reach by the relation, each once, and their type.

    Every hop is a left semi join of the target: duplicates never arise, so none has to be removed, and
    links to what is gone lead nowhere.
    """
    t = catalog.schema.type(type_name)
    f = catalog.relation(t, name)
    target = catalog.frame(f.target)
    ids = objects.select("id")
    if f.inverse and not catalog.schema.inverse_source(f).many and (f.target, f.inverse[1]) not in catalog.edges:
        key = f.inverse[1]  # the target holds the key
        return target.join(ids.select(F.col("id").alias(key)), key, "left_semi").select(*target.columns), f.target
    if not f.inverse and not f.many and (t.name, f.name) not in catalog.edges:
        whole = objects if f.name in objects.columns else catalog.frame(t.name).join(ids, "id", "left_semi")
        keys = whole.select(F.col(f.name).alias("id"))
        return target.join(keys, "id", "left_semi"), f.target
    edges = catalog.edge_frame(t, f).join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return target.join(edges.select(F.col("dst").alias("id")), "id", "left_semi"), f.target


def get_links(catalog: Catalog, type_name: str, name: str, ids: DataFrame) -> DataFrame:
    """``src, dst`` and edge fields of the links of ``ids``."""
    t = catalog.schema.type(type_name)
    return catalog.edge_frame(t, catalog.relation(t, name)).join(ids.select(F.col("id").alias("src")), "src", "left_semi")


def get_many(catalog: Catalog, type_name: str, ids: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Objects of ``ids`` (each once, missing ones left out) with the chosen scalar columns, by id."""
    t = catalog.schema.type(type_name)
    columns = [f.name for f in t.scalars] if columns is None else columns
    for c in columns:
        if c not in t.fields or t.fields[c].kind != "scalar":
            raise InvalidArgument(f"{type_name}.{c} is no scalar field")
    return catalog.frame(type_name).join(ids.select("id"), "id", "left_semi").select("id", *columns).orderBy("id")


def link_peer_ids(catalog: Catalog, type_name: str, name: str, peer: str, ids: DataFrame) -> DataFrame:
    """``src, id, peer``: every object linked to ``ids``, with its own to-one link or null."""
    t = catalog.schema.type(type_name)
    f = catalog.relation(t, name)
    other = catalog.schema.types[f.target]
    p = catalog.relation(other, peer)
    if p.many:
        raise InvalidArgument(f"{f.target}.{peer} is to-many")
    linked = get_links(catalog, type_name, name, ids).select("src", F.col("dst").alias("id")).join(catalog.frame(f.target).select("id"), "id", "left_semi")
    peers = catalog.edge_frame(other, p).select(F.col("src").alias("id"), F.col("dst").alias("peer"))
    return linked.join(peers, "id", "left").select("src", "id", "peer")


def link_peers_top(catalog: Catalog, type_name: str, name: str, peer: str, ids: DataFrame, order_by: str, descending: bool = True, offset: int = 0, limit: int = 10, fields: list[str] | None = None) -> DataFrame:
    """Distinct peers of the linked objects in the order of a field: nulls last, ties by id in the same direction."""
    found = link_peer_ids(catalog, type_name, name, peer, ids)
    t = catalog.schema.types[catalog.schema.types[catalog.schema.type(type_name).fields[name].target].fields[peer].target]
    columns = [f.name for f in t.scalars] if fields is None else fields
    for c in [*columns, order_by]:
        if c not in t.fields or t.fields[c].kind != "scalar":
            raise InvalidArgument(f"{t.name}.{c} is no scalar field")
    peers = catalog.frame(t.name).join(found.select(F.col("peer").alias("id")), "id", "left_semi")
    order = (F.col(order_by).desc_nulls_last(), F.col("id").desc()) if descending else (F.col(order_by).asc_nulls_last(), F.col("id"))
    return peers.orderBy(*order).offset(offset).limit(limit).select("id", *columns)
