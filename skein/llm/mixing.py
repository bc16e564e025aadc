"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows are cut into blocks, and the schedule into frames. In a frame of L slots in which a source has m
blocks, its block i is released at slot floor(i * L / m) and due by slot ceil((i + 1) * L / m). Earliest deadline
first among the released blocks keeps every block in its window, and so every source less than one block off
m / L of the slots that have passed, at every slot.

Weights that some scale makes whole numbers with a sum of at most ``MAX_PERIOD`` times the frame's usual length
are taken as these: a frame is a period, each source has its whole weight of blocks in each, so a frame begins with
no deviation and the bound of less than one block holds for the whole table, however long. The default weights are
whole numbers. Other weights are not rounded: source i has had floor(j * w + a fraction of its own) blocks after j
frames, which adds less than one block, never more with time.

A schedule meets its targets until a source runs dry; ``in_mix`` marks the rows of the frames before that. Nothing
is dropped: later frames hold what the sources that go on have for them.

Frames are folded each by itself. Sources with as many blocks in a frame have the same windows and are one entry of
the fold, so a frame costs its slots times its different counts, whatever the number of sources.

Defined results: a null source is a source of its own; a source without a target (weight null or 0) gets
no slots, in_mix false; repeated ids are separate rows; order within a source is by hash of the id, then
the id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged

#: Slots of a frame, nearly, unless whole weights make it another; raised to four for each source if there are many.
FRAME_SLOTS = 1000
#: A period of whole weights may be this many usual frames long.
MAX_PERIOD = 4
BLOCK_ROWS = 8
#: A source is numbered in this many pieces by a hash of the id, more where pieces of the table would pass PIECE_ROWS.
BUCKETS, PIECE_ROWS = 256, 500_000
#: Frames that are made from one row, and whose slots are counted together.
FRAMES_AT_ONCE = 10_000
#: Default target: the square root of a source's number of rows, as a whole number (see ``default_weights``).
POWER = 0.5


def piece_count(rows: int) -> int:
    return max(BUCKETS, math.ceil(rows / PIECE_ROWS))


def default_weights(counts: DataFrame, frame_slots: int = FRAME_SLOTS) -> DataFrame:
    """``source_key, n, weight``: rows to the power ``POWER`` over the least such number, or over what makes their sum ``frame_slots`` if that is more; rounded, 1 at least."""
    root = F.pow(F.col("n"), F.lit(POWER))
    unit = counts.agg(F.greatest(F.min(root), F.sum(root) / frame_slots).alias("unit"))
    return counts.crossJoin(F.broadcast(unit)).select("source_key", "n", F.greatest(F.lit(1.0), F.round(root / F.col("unit"))).alias("weight"))


def frame_weights(counts: DataFrame, block_rows: int, frame_slots: int) -> DataFrame:
    """``source_key, w, blocks, part``: blocks of each source with a weight in a frame, in all, and the fraction that it is rounded with.

    ``counts``: (source_key, n, weight).
    """
    known = counts.select("source_key", "n", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("w")).where("w > 0")
    sums = known.agg(F.sum("w").alias("total"), F.min("w").alias("least"), F.min(F.ceil(F.col("n") / block_rows) / F.col("w")).alias("dry")).first()
    if sums.total is None:
        scale = 1.0
    else:
        scales = [1 / sums.least, 1.0, 10.0, 100.0, 1e3, 1e4, 1e5, 1e6]
        whole = lambda k: F.bool_and(F.abs(F.col("w") * k - F.round(F.col("w") * k)) <= 1e-9 * F.col("w") * k)
        found = known.agg(*(whole(k).alias(f"k{i}") for i, k in enumerate(scales))).first()
        fit = [k for i, k in enumerate(scales) if found[i] and k * sums.total <= MAX_PERIOD * frame_slots]
        scale = min(fit) if fit else None
    if scale is None:  # frames of such a length that one ends where the first source runs dry
        frames = sums.dry * sums.total / frame_slots
        scale = frame_slots / sums.total * frames / math.ceil(frames)
        w = F.col("w") * scale
    else:
        w = F.round(F.col("w") * scale)
    everything = Window.partitionBy(F.lit(0))  # one row for each source
    part = (F.row_number().over(everything.orderBy("source_key")) - 0.5) / F.count("*").over(everything)
    return known.select("source_key", w.alias("w"), F.ceil(F.col("n") / block_rows).alias("blocks"), part.alias("part"))


def frame_members(times: DataFrame) -> DataFrame:
    """``frame, share, member, source_key, first``: each source's blocks in each frame; sources with the same share are numbered."""
    spark = times.sparkSession
    count = F.ceil((F.col("blocks") - F.col("part")) / F.col("w")).cast("long")
    pieces = times.withColumn("frames", count).withColumn("piece", F.explode(F.expr(f"sequence(0L, (frames - 1L) DIV {FRAMES_AT_ONCE}L)")))
    pieces = pieces.repartition(shuffle_partitions(spark), "source_key", "piece")
    each = pieces.withColumn("frame", F.explode(F.expr(f"sequence(piece * {FRAMES_AT_ONCE}L, least(frames, (piece + 1L) * {FRAMES_AT_ONCE}L) - 1L)")))
    had = lambda j: F.least("blocks", F.floor(j * F.col("w") + F.col("part"))).cast("long")
    first, following = had(F.col("frame")), had(F.col("frame") + 1)
    members = each.select("frame", (following - first).alias("share"), "source_key", first.alias("first")).where("share > 0")
    alike = Window.partitionBy("frame", "share").orderBy("source_key")
    return members.withColumn("member", (F.row_number().over(alike) - 1).cast("long"))


def frame_rows(members: DataFrame) -> DataFrame:
    """``frame, start, slots, s``: of each frame the first slot, their number, and its different shares with the number of sources."""
    per = members.groupBy("frame", "share").agg(F.count("*").alias("c"))
    frames = per.groupBy("frame").agg(F.sum(F.col("share") * F.col("c")).alias("slots"), F.sort_array(F.collect_list(F.struct("share", "c"))).alias("s"))
    # Slots before: of whole pieces of frames first, then within a piece.
    frames = frames.withColumn("piece", F.expr(f"frame DIV {FRAMES_AT_ONCE}L"))
    sums = frames.groupBy("piece").agg(F.sum("slots").alias("sum"))
    sums = sums.select("piece", (F.sum("sum").over(Window.orderBy("piece")) - F.col("sum")).alias("base"))
    inside = F.sum("slots").over(Window.partitionBy("piece").orderBy("frame")) - F.col("slots")
    return frames.withColumn("inside", inside).join(sums, "piece").select("frame", (F.col("base") + F.col("inside")).alias("start"), "slots", "s")


def frame_slots_of(frames: DataFrame, members: DataFrame) -> DataFrame:
    """``source_key, block, slot, release, deadline, frame``: the schedule, each frame folded over its slots.

    An entry of ``s`` has share * c jobs in turn: job q is block q DIV c of member q % c.
    """
    due = """
      transform(s, (x, i) -> named_struct('d', IF(
        acc.done[i] < x.share * x.c AND ((acc.done[i] DIV x.c) * slots) DIV x.share <= t,
        ((acc.done[i] DIV x.c + 1L) * slots + x.share - 1L) DIV x.share, 9223372036854775807L), 'i', i))
    """
    step = f"""
      aggregate(
        array(array_min({due}).i), acc,
        (a, pick) -> named_struct('done', transform(a.done, (d, i) -> d + IF(i = pick, 1L, 0L)), 'picks', concat(a.picks, array(named_struct('i', pick, 'q', a.done[pick])))))
    """
    none = "cast(array() AS array<struct<i: int, q: bigint>>)"
    # In runs of slots: a run's picks are put to those before at once, so lists are not copied at every slot.
    run = "CAST(ceil(sqrt(slots)) AS bigint)"
    picks = f"""
      aggregate(
        sequence(0L, (slots - 1L) DIV {run}),
        named_struct('done', transform(s, x -> 0L), 'picks', {none}),
        (all, r) -> aggregate(
          array(aggregate(sequence(r * {run}, least(slots, (r + 1L) * {run}) - 1L), named_struct('done', all.done, 'picks', {none}), (acc, t) -> {step})),
          all, (a, x) -> named_struct('done', x.done, 'picks', concat(a.picks, x.picks))),
        all -> all.picks)
    """
    placed = frames.select("frame", "start", "slots", "s", F.posexplode(F.expr(picks)).alias("t", "pick"))
    placed = placed.select("frame", "start", "slots", "t", F.expr("s[pick.i].share").alias("share"), F.expr("pick.q DIV s[pick.i].c").alias("turn"), F.expr("pick.q % s[pick.i].c").alias("member"))
    placed = placed.join(members, ["frame", "share", "member"])
    return placed.select(
        "source_key", (F.col("first") + F.col("turn")).alias("block"), (F.col("start") + F.col("t")).alias("slot"),
        F.expr("start + (turn * slots) DIV share").alias("release"), F.expr("start + ((turn + 1) * slots + share - 1) DIV share").alias("deadline"), "frame",
    )


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, seq_col: str | None = None) -> DataFrame:
    """One row per input row: ``id, source, seq, row_in_source, block, slot, release, deadline, in_mix``.

    ``weights``: (source, weight); without it see ``default_weights``.
    Slots are numbered from 0; the rows of a block share its slot. ``seq_col``: distinct longs that tell
    rows with the same identifier apart; without it they are numbered.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null, apart from any name
    seq = F.col(seq_col) if seq_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), seq.alias("seq"))
    rows = staged(rows.withColumn("source_key", key).withColumn("h", F.xxhash64("id")), "mix")
    buckets = piece_count(rows.count())
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    # A hot source is numbered in pieces: counts per (source, bucket) first, then rows within a bucket.
    per = staged(rows.groupBy("source_key", "bucket").agg(F.count("*").alias("c")), "mix-counts")
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("source_key", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    counts = per.groupBy("source_key").agg(F.sum("c").alias("n"))
    sources = counts.count()
    frame_slots = max(FRAME_SLOTS, 4 * sources)
    if weights is None:
        aimed = default_weights(counts, frame_slots)
    else:
        given = weights.select(F.col(weights.columns[0]).alias("source"), F.col(weights.columns[1]).cast("double").alias("weight")).withColumn("source_key", key)
        aimed = counts.join(given.groupBy("source_key").agg(F.sum("weight").alias("weight")), "source_key", "left")
    times = staged(frame_weights(aimed, block_rows, frame_slots), "mix-times")
    # Frames before a source runs dry.
    whole = times.agg(F.min(F.ceil((F.col("blocks") + 1 - F.col("part")) / F.col("w")) - 1)).first()[0] or 0
    members = staged(frame_members(times), "mix-members")
    # Few rows, each with a fold of its own: dealt over a fixed number of tasks, which are not put together again.
    frames = staged(frame_rows(members), "mix-frames")
    slots = staged(frame_slots_of(frames.repartition(shuffle_partitions(docs.sparkSession), "frame"), members), "mix-slots")
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy("h", "id", "seq")))
    numbered = numbered.join(before, ["source_key", "bucket"]).withColumn("row_in_source", (F.col("before") + F.col("k") - 1).cast("long"))
    numbered = numbered.withColumn("block", F.floor(F.col("row_in_source") / block_rows).cast("long"))
    return numbered.join(slots, ["source_key", "block"], "left").select("id", "source", "seq", "row_in_source", "block", "slot", "release", "deadline", F.coalesce(F.col("frame") < whole, F.lit(False)).alias("in_mix"))


def op5_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "source", "row_in_source", "block", "slot", "release", "deadline", "in_mix")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all rows of ``docs``, laid out in the order of the mix, with the columns of ``docs``.

    The schedule goes on when a source runs dry, so no row is left out. Rows of a source with the same id
    follow one another anyway, but for a block's end; they are laid out with the first of them.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    at = F.min(F.struct("slot", "row_in_source")).alias("_skein_at")
    order = mix(docs).groupBy(key.alias("_skein_source"), F.coalesce(F.col("id"), F.lit(-(2**63))).alias("_skein_id")).agg(at)
    marked = docs.withColumn("_skein_source", key).withColumn("_skein_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    # Left: a row can never be lost here. Slots belong to one source each, so the ranges are even.
    found = marked.join(staged(order, "mix-order"), ["_skein_source", "_skein_id"], "left")
    return found.repartitionByRange(shuffle_partitions(spark), "_skein_at").sortWithinPartitions("_skein_at").select(*docs.columns)
