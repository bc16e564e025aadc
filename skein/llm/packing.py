"""Best-fit packing of token sequences into bins of several permitted lengths.

A document's length is its number of words plus one end token. Documents longer than the largest bin are
cut into pieces of that size; every token is placed. Pieces are dealt to shards by a hash, and a shard is
packed longest first by best fit: a piece goes into the open bin whose left space it fits best; where none has
room, a bin is opened. At which of the permitted capacities is chosen jointly for the whole shard: every rule of
``opening_rules`` is followed to the end, and the least total cost wins. The rules are

* look ahead: what the pieces still to come can fill each capacity with, and the least cost per token of that
  (the capacities compete at every opening, so a shard is filled with a mixture of them);
* the same, with the pieces that were looked at put into the bin at once;
* each capacity as the least one to open.

Then pairs of bins are joined where one larger bin costs less than the two, and every bin is downsized to the least
permitted capacity that holds its contents. Bins of a shard that end less than ``REPACK_BELOW`` full meet those
of other shards in a second round, which keeps them as they were if that costs less.

The cost of a bin of c tokens is OVERHEAD + c + c * c / ATTENTION: work that grows with the tokens, and attention,
that grows with their square. Without the last term (``attention=None``) and with capacities that double, two
bins never cost less than one of twice the size, so all but the last bins would be opened at the largest.

``pack_in_order`` keeps the order of a written table, such as that of a mix: a shard is not a hash's but a window of
at most ``WINDOW_PIECES`` consecutive pieces, loose bins meet those of the windows beside theirs, and the bins are laid
out by ``place``, the mean place of their pieces in the table. So the bins of the first windows hold what the table
begins with, and only inside such a neighbourhood does best fit choose what goes together.

Defined results: null and empty texts have the end token alone; a null id is a document like others;
repeated rows are packed each; an empty table gives no bins.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, staged, text_rows

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
#: Length at which attention costs as much as all that is linear in the tokens: six times a width of 1024.
ATTENTION = 6 * 1024
#: Pieces of a shard, which a task packs at once.
SHARD_PIECES = 20_000
#: The same where the table's order is kept.
WINDOW_PIECES = 2_000
#: First shards whose loose bins meet in one of the second round.
REPACK_SHARDS = 8
REPACK_BELOW = 0.97

Bins = list[list[int]]


def bin_costs(capacities: tuple[int, ...], overhead: int = OVERHEAD, attention: int | None = ATTENTION) -> dict[int, float]:
    return {c: overhead + c + (c * c / attention if attention else 0.0) for c in sorted(set(capacities))}


class Pool:
    """Pieces still to come, by length; finds the longest that is not above a bound."""

    def __init__(self, lengths: list[int], largest: int):
        self.left = [0] * (largest + 1)
        for n in lengths:
            self.left[n] += 1
        self.below = [n if self.left[n] else n - 1 for n in range(largest + 1)]
        self.below[0] = 0

    def longest(self, bound: int) -> int:
        """The greatest length up to ``bound`` with a piece left, or 0."""
        at, below = bound, self.below
        while below[at] != at:
            below[at] = below[below[at]]
            at = below[at]
        return at

    def take(self, n: int) -> None:
        self.left[n] -= 1
        if not self.left[n]:
            self.below[n] = n - 1

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, pieces) that fill ``room``, the longest first; nothing is taken."""
        out, at = [], room
        while room and (n := self.longest(min(room, at))):
            k = min(self.left[n], room // n)
            out.append((n, k))
            room, at = room - n * k, n - 1
        return out


def cheapest(n: int, pool: Pool, costs: dict[int, float]) -> tuple[int, list[tuple[int, int]]]:
    """The capacity with the least cost per token if a piece of ``n`` opens it and ``pool`` fills it, and that filling."""
    caps, best = list(costs), None
    for c in caps[bisect_left(caps, n) :]:
        filling = pool.fill(c - n)
        used = n + sum(m * k for m, k in filling)
        worth = (costs[caps[bisect_left(caps, used)]] / used, -c)
        if best is None or worth < best[0]:
            best = worth, c, filling
    return best[1], best[2]


def best_fit(lengths: list[int], largest: int, opened: Callable[[int, Pool], int]) -> Bins:
    """Best fit of ``lengths``, which fall; ``opened(n, pool)`` is the capacity of a new bin."""
    pool, bins, room = Pool(lengths, largest), [], []
    for i, n in enumerate(lengths):
        pool.take(n)
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = opened(n, pool), len(bins)
            bins.append([])
        bins[b].append(i)
        if left > n:
            insort(room, (left - n, b))
    return bins


def filled_at_once(lengths: list[int], costs: dict[int, float]) -> Bins:
    """Each bin takes what the least cost per token was reckoned with."""
    pool, bins = Pool(lengths, max(costs)), []
    of: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        of.setdefault(lengths[i], []).append(i)
    for n in sorted(of, reverse=True):
        while of[n]:
            pool.take(n)
            _, filling = cheapest(n, pool, costs)
            bins.append([of[n].pop()])
            for m, k in filling:
                for _ in range(k):
                    pool.take(m)
                    bins[-1].append(of[m].pop())
    return bins


def joined(bins: Bins, lengths: list[int], costs: dict[int, float]) -> Bins:
    """Pairs of bins put into one where that costs less; the fullest that fits goes with the least full."""
    caps = list(costs)
    price = lambda n: costs[caps[bisect_left(caps, n)]]
    used = sorted((sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    out = []
    while used:
        n, k = used.pop(0)
        best = None
        for c in caps:
            at = bisect_right(used, (c - n, len(bins))) - 1
            if at >= 0 and (gain := price(n) + price(used[at][0]) - price(n + used[at][0])) > 1e-9 and (best is None or gain > best[0]):
                best = gain, at
        if best is None:
            out.append((k, bins[k]))
        else:
            m, j = used.pop(best[1])
            bins[j] = bins[j] + bins[k]
            insort(used, (n + m, j))
    return [b for _, b in sorted(out)]


def opening_rules(costs: dict[int, float]) -> list[Callable[[list[int]], Bins]]:
    caps, largest = list(costs), max(costs)
    at_least = lambda low: lambda lengths: best_fit(lengths, largest, lambda n, _: max(low, caps[bisect_left(caps, n)]))
    return [lambda lengths: best_fit(lengths, largest, lambda n, pool: cheapest(n, pool, costs)[0]), lambda lengths: filled_at_once(lengths, costs), *(at_least(c) for c in reversed(caps))]


def pack(lengths: list[int], costs: dict[int, float]) -> list[tuple[int, list[int]]]:
    """The cheapest bins of all rules, as (capacity, indices of ``lengths``); every length is from 1 to the largest capacity."""
    caps, order = list(costs), sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling, best = [lengths[i] for i in order], None
    for rule in opening_rules(costs):
        bins = joined(rule(falling), falling, costs)
        made = [(caps[bisect_left(caps, sum(falling[i] for i in b))], b) for b in bins]
        total = sum(costs[c] for c, _ in made)
        if best is None or total < best[0] - 1e-9:
            best = total, made
    return [(c, [order[i] for i in b]) for c, b in best[1]]


_OUT = "shard long, bin long, capacity long, used long, position long, id long, first_token long, n_tokens long, place long, seq long, done boolean"
_NAMES = ["shard", "bin", "capacity", "used", "position", "id", "first_token", "n_tokens", "place", "seq", "done"]


def _pack(costs: dict[int, float], last: bool):
    """Pack one shard; in the second round its pieces come in bins (``old``), which stay if they cost less together."""

    def run(key, table):
        shard = key[0].as_py()
        ids, first, n, seq = (table.column(c).to_pylist() for c in ("id", "first_token", "n_tokens", "seq"))
        order = sorted(range(len(n)), key=lambda i: (-n[i], seq[i], first[i]))
        bins = [(c, [order[m] for m in members]) for c, members in pack([n[i] for i in order], costs)]
        if last:
            old: dict[tuple, list[int]] = {}
            caps = {}
            for i, name in enumerate(zip(*(table.column(c).to_pylist() for c in ("old_shard", "old_bin", "old_capacity")), strict=True)):
                old.setdefault(name[:2], []).append(i)
                caps[name[:2]] = name[2]
            if sum(costs[c] for c in caps.values()) < sum(costs[c] for c, _ in bins):
                bins = [(caps[k], sorted(old[k], key=lambda i: (-n[i], seq[i], first[i]))) for k in sorted(old)]
        cols: list[list] = [[] for _ in _NAMES]
        for b, (cap, members) in enumerate(bins):
            used = sum(n[i] for i in members)
            done = last or used >= REPACK_BELOW * cap
            place = sum(seq[i] for i in members) // len(members)
            for pos, i in enumerate(members):
                for c, v in zip(cols, (shard, b, cap, used, pos, ids[i], first[i], n[i], place, seq[i], done), strict=True):
                    c.append(v)
        return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 10 + [pa.bool_()], strict=True)], names=_NAMES)

    return run


def _lengths(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``id, n`` and ``more``: a document's tokens with its end."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return text_rows(docs, id_col, text_col, *more).withColumn("n", (words + 1).cast("long")).drop("text")


def _pieces(rows: DataFrame, largest: int) -> DataFrame:
    """``id, seq, first_token, n_tokens, piece`` from ``id, seq, n``."""
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / largest)))
    pieces = rows.select("id", "seq", "n", cut.alias("piece"))
    return pieces.select("id", "seq", (F.col("piece") * largest).alias("first_token"), F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * largest).alias("n_tokens"), "piece")


def _costs(capacities: tuple[int, ...], overhead: int, attention: int | None) -> dict[int, float]:
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    return bin_costs(capacities, overhead, attention)


def _shards(spark, total: int, most: int) -> int:
    return max(1, math.ceil(total / most), min(shuffle_partitions(spark), math.ceil(total / 200)))


def _two_rounds(dealt: DataFrame, costs: dict[int, float], mixed) -> DataFrame:
    """Pack the shards, then the loose bins in the shards that ``mixed`` names; a bin's pieces stay together on the way."""
    one = staged(dealt.groupBy("shard").applyInArrow(_pack(costs, False), _OUT), "pack-1")
    loose = one.where("not done").select("id", "seq", "first_token", "n_tokens", F.col("shard").alias("old_shard"), F.col("bin").alias("old_bin"), F.col("capacity").alias("old_capacity"), mixed.cast("long").alias("shard"))
    two = loose.groupBy("shard").applyInArrow(_pack(costs, True), _OUT)
    return one.where("done").unionByName(two).drop("seq", "done")


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, attention: int | None = ATTENTION) -> DataFrame:
    """One row per piece: ``shard, bin, capacity, used, position, id, first_token, n_tokens``; (shard, bin) names a bin."""
    costs = _costs(capacities, overhead, attention)
    rows = staged(_lengths(docs, id_col, text_col).withColumn("seq", F.monotonically_increasing_id()), "pack-lengths")
    pieces = _pieces(rows, max(capacities)).drop("piece")
    shards = _shards(docs.sparkSession, pieces.count(), SHARD_PIECES)
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("seq", "first_token"), F.lit(shards)).cast("long"))
    # Bins that the first round left loose meet in fewer and mixed shards.
    fewer = max(1, math.ceil(shards / REPACK_SHARDS))
    return _two_rounds(dealt, costs, F.lit(shards) + F.pmod(F.xxhash64("shard", "bin"), F.lit(fewer))).drop("place")


def pack_in_order(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD, attention: int | None = ATTENTION) -> DataFrame:
    """As ``pack_documents``, with ``place``, and laid out by it; ``docs``: a table as a job has written it, in the order of its files' numbers and rows."""
    spark, costs, largest = docs.sparkSession, _costs(capacities, overhead, attention), max(capacities)
    try:
        rows = _in_files(docs, id_col, text_col)
    except AnalysisException:  # not a table of files: written in its order
        rows = _in_files(staged(docs, "pack-order"), id_col, text_col)
    rows = staged(rows.withColumn("pieces", F.floor((F.col("n") - 1) / largest) + 1), "pack-lengths")
    # Places in the table count pieces: those of the files before, then of the rows before in the file.
    number = F.regexp_extract("file", r"part-(\d+)[^/]*$", 1)
    files = rows.groupBy("file").agg(F.sum("pieces").alias("sum"))
    ordered = Window.orderBy(F.length(number), number, "file")  # one row for each file
    files = files.select("file", "sum", F.row_number().over(ordered).alias("f"), (F.sum("sum").over(ordered) - F.col("sum")).alias("base"))
    files = staged(files, "pack-files")
    total = files.agg(F.coalesce(F.sum("sum"), F.lit(0))).first()[0]
    shards = _shards(spark, total, WINDOW_PIECES)
    window = max(1, math.ceil(total / shards))
    before = F.sum("pieces").over(Window.partitionBy("f").orderBy("row")) - F.col("pieces")
    rows = rows.join(F.broadcast(files.drop("sum")), "file").select("id", "n", "f", "row", "pieces", "base")
    rows = rows.withColumn("seq", (F.col("base") + before).cast("long"))
    dealt = _pieces(rows, largest).withColumn("shard", F.expr(f"(seq + piece) DIV {window}L")).drop("piece")
    found = _two_rounds(dealt, costs, F.lit(shards) + F.expr(f"shard DIV {REPACK_SHARDS}L"))
    order = ["place", "shard", "bin", "position"]
    return found.repartitionByRange(shuffle_partitions(spark), *order[:3]).sortWithinPartitions(*order)


def _in_files(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, n, file, row``: with each document the file that it is read from and its number in that."""
    at = docs.metadataColumn("_metadata")
    return _lengths(docs, id_col, text_col, at["file_path"].alias("file"), at["row_index"].alias("row"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the bins of ``docs``, one row per piece of a document, in the order that the mix gave the documents."""
    return pack_in_order(docs).withColumnRenamed("id", "doc_id")
