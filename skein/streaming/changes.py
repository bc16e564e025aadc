"""The change feed: a stream over the change log of a store, filtered as a subscriber asks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Versions that the gap finder sorts at once.
GAP_RANGE = 1_000_000
EVENT = "kind string, type string, id long, origin long, fields string, version long"


@dataclass(frozen=True)
class Subscription:
    """All that are set must hold; no kinds means every kind; events without an origin are never excluded."""

    type_name: str | None = None
    object_id: int | None = None
    kinds: tuple[str, ...] = ()
    exclude_origin: int | None = None

    def condition(self) -> Column:
        made = F.lit(True)
        if self.type_name is not None:
            made &= F.col("type") == self.type_name
        if self.object_id is not None:
            made &= F.col("id") == self.object_id
        if self.kinds:
            made &= F.col("kind").isin(*self.kinds)
        if self.exclude_origin is not None:
            made &= F.coalesce(F.col("origin") != self.exclude_origin, F.lit(True))
        return made


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change rows of ``folder`` and the folders in it, as they are committed."""
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)


def select_changes(changes: DataFrame, wanted: Subscription) -> DataFrame:
    """Batch or stream: the events a subscriber gets."""
    return changes.where(wanted.condition())


def wire_events(changes: DataFrame) -> DataFrame:
    """Events as a client reads them: numbers as decimal strings."""
    return changes.select(F.col("version").cast("string").alias("version"), "kind", "type", F.col("id").cast("string").alias("object_id"), F.col("origin").cast("string").alias("origin"), "fields")


def readable_changes(changes: DataFrame, rules, type_name: str, principal, catalog) -> DataFrame:
    """Events whose delivered fields a subscribe rule allows the caller to see; links are unknown, so they deny."""
    t = catalog.schema.types[type_name]
    schema = ", ".join(f"`{f.name}` {f.spark_type.simpleString()}" for f in t.scalars)
    own = changes.where(F.col("type") == type_name)
    wide = own.withColumn("_e", F.struct(*changes.columns)).withColumn("_f", F.from_json("fields", schema)).select("_e", "id", *(F.col(f"_f.{f.name}").alias(f.name) for f in t.scalars))
    return rules.readable(wide, type_name, principal, catalog, op="subscribe").select("_e.*")


def subscribe(changes: DataFrame, wanted: Subscription, deliver, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a query that hands each batch of events to ``deliver(df, batch_id)``; stop it to unsubscribe."""
    writer = select_changes(changes, wanted).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def gaps(events: DataFrame, last: int) -> DataFrame:
    """``after, next``: places where versions are missing between events that a subscriber has seen.

    Versions are cut into ranges of ``GAP_RANGE``; each is looked through by itself, and then what lies between
    the last version of a range and the first of the next, one row for each range.
    """
    from pyspark.sql import Window

    seen = events.select("version").where(F.col("version") > last).distinct().withColumn("part", F.floor(F.col("version") / GAP_RANGE))
    inside = seen.withColumn("after", F.lag("version").over(Window.partitionBy("part").orderBy("version")))
    ends = seen.groupBy("part").agg(F.min("version").alias("version"), F.max("version").alias("top"))
    between = ends.withColumn("after", F.lag("top", 1, last).over(Window.orderBy("part")))
    made = inside.where("after is not null").select("after", "version").unionByName(between.select("after", "version"))
    return made.where(F.col("version") > F.col("after") + 1).select("after", F.col("version").alias("next"))
