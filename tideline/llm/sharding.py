"""Shards of near equal bytes: a minimax contiguous partition of documents whose equal texts stay together.

Groups of equal texts, ordered by their smallest doc_id, are atomic. The smallest capacity C that some contiguous
partition needs is found by binary search; a capacity is checked greedily, by filling one shard after the other. Under
C the cuts are then evened out: each shard takes its share of what is left, at least one group, and no less than what the
shards after it can't hold.

The groups' running sums are a distributed table (ranges of the order, each summed on its own, plus an offset). A search
asks only for the last sum up to some x or the first from x on, so it works on bounds: of ever finer pieces of the table
the largest sum and the count are known, and what may lie between two known sums is bracketed. The few stretches that a
cut may fall into, at most ``4 * shards``, are counted again, finer, until no bracket is left: some rounds, each one
filtered aggregation, with ``FAN`` sums for the driver (more only if a round doesn't halve what is open).

Rows get their slot from the group's place, and within a group by salted parts, so a group of any size is many tasks.
DataFrame functions only.

Edge cases: null counts as empty text (8 bytes of size, crc32 of nothing); a null doc_id is ordered first; texts of any
length are read whole; rows that repeat doc_id and text have neighbouring slots; a group larger than an equal share is a
shard of its own, as far as the order allows; with fewer groups than shards the last shards are empty; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import read_table, text_of, written

SHARDS, EXTRA = 24, 8  # bytes of a row besides its text
FAN = 1 << 15  # pieces of a round
SALTS = 64  # parts of a group of copies, at least
ROWS = 1 << 20  # groups of a range of the order, about


class Sums:
    """Some of the running sums of a sequence of sizes, 0 and the total among them. ``alone[i]``: none lies between
    ``points[i - 1]`` and ``points[i]``."""

    def __init__(self, points: list[int], alone: list[bool]):
        self.points, self.alone, self.total = points, alone, points[-1]

    def upto(self, x: int) -> tuple[int, int]:
        """Bounds of the last sum that is at most ``x``."""
        i = bisect_right(self.points, x)
        low = self.points[i - 1]
        return low, low if i == len(self.points) or self.alone[i] else x

    def beyond(self, x: int) -> tuple[int, int]:
        """Bounds of the first sum that is at least ``x``, at most the total."""
        i = bisect_left(self.points, min(x, self.total))
        high = self.points[i]
        return high if self.alone[i] or high == x else x, high

    def filled(self, capacity: int, shards: int, side: int) -> list[int]:
        """The greedy cuts, all taken from below (side 0) or from above (side 1)."""
        at = [0]
        for _ in range(shards):
            at.append(self.upto(at[-1] + capacity)[side])
        return at

    def capacity(self, shards: int, side: int) -> int:
        """The smallest capacity that suffices: of side 1 perhaps too small, of side 0 perhaps too large."""
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            if self.filled(mid, shards, side)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def cuts(self, shards: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Bounds of the cuts, and of every sum that they depend on."""
        low, high = self.capacity(shards, 1), self.capacity(shards, 0)
        asked = list(zip(self.filled(low, shards, 0), self.filled(high, shards, 1)))
        if low < high:
            return asked, asked
        need = [(self.total, self.total)]  # from here on the shards left hold the rest
        for _ in range(shards - 1):
            need.append((self.beyond(max(0, need[-1][0] - low))[0], self.beyond(max(0, need[-1][1] - low))[1]))
        need.reverse()
        cuts = [(0, 0)]
        for j, least in enumerate(need):
            share = [at + -(-(self.total - at) // (shards - j)) for at in cuts[-1]]
            cut = []
            for side in (0, 1):
                after = self.beyond(min(cuts[-1][side] + 1, self.total))
                asked.append(after)
                cut.append(max(least[side], self.upto(share[side])[side], after[side]))
            cuts.append((cut[0], cut[1]))
        return cuts, asked + need + cuts


def _stretches(sums: Sums, asked: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint stretches between known sums in which unknown ones are asked for."""
    out: list[list[int]] = []
    for low, high in sorted(set(asked)):
        i, j = bisect_right(sums.points, low), bisect_left(sums.points, high)
        gaps = [k for k in range(max(1, i), min(j, len(sums.points) - 1) + 1) if not sums.alone[k]]
        if low == high or not gaps:
            continue
        a, b = sums.points[gaps[0] - 1], sums.points[gaps[-1]]
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _finer(prefix: DataFrame, sums: Sums, stretches: list[tuple[int, int]], fan: int) -> Sums:
    """Count the sums of ``prefix`` (upto long) in equal pieces of the stretches."""
    upto, pieces = F.col("upto"), max(2, fan // len(stretches))
    which, piece = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, (a, b) in enumerate(stretches):
        width = max(1, -(-(b - a) // pieces))
        inside = (upto > a) & (upto <= b)
        which, piece = F.when(inside, i).otherwise(which), F.when(inside, F.floor((upto - a - 1) / F.lit(width)).cast("long")).otherwise(piece)
    rows = prefix.select("upto", which.alias("i"), piece.alias("p")).where("i IS NOT NULL").groupBy("i", "p").agg(F.max("upto").alias("most"), F.count("*").alias("n")).collect()
    known = {p: alone for p, alone in zip(sums.points, sums.alone) if not any(a < p <= b for a, b in stretches)}
    known |= {r["most"]: r["n"] == 1 for r in rows}
    points = sorted(known)
    return Sums(points, [known[p] for p in points])


def minimax_cuts(prefix: DataFrame, total: int, shards: int = SHARDS, fan: int = FAN) -> list[int]:
    """Where the shards end, among the running sums ``upto`` (long, distinct, the largest is ``total``) of ``prefix``."""
    sums, last, pieces = Sums([0, total], [True, False]), 2 * total, fan
    while True:
        cuts, asked = sums.cuts(shards)
        stretches = _stretches(sums, asked)
        if not stretches:
            return [low for low, _ in cuts[1:]]
        length = sum(b - a for a, b in stretches)
        pieces, last = pieces if 2 * length <= last else 4 * pieces, length  # bounds add up over shards: few pieces may not narrow them
        sums = _finer(prefix, sums, stretches, pieces)


def running(groups: DataFrame, order: list[str], sizes: dict[str, str]) -> DataFrame:
    """Add the running sum of each column of ``sizes``, under the name it has there, over all rows in ``order``."""
    spark = groups.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // ROWS))
    ranged = written(groups.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sizes])
    base = base.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sizes])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(c).over(within).alias(n) for c, n in sizes.items()]).join(base, "_range")
    return summed.select(*groups.columns, *[(F.col(n) + F.col(f"_{c}")).alias(n) for c, n in sizes.items()])


def shard(docs: DataFrame, shards: int = SHARDS, fan: int = FAN, extra: int = EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: shards of contiguous groups of equal texts, their largest
    as small as can be, and a gapless place within each."""
    binary = text_of(text_col).cast("binary")
    key = F.unhex(F.sha2(binary, 256))
    n = docs.count()
    salt = F.pmod(F.coalesce(F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col))), F.lit(0)) + F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)), F.lit(max(SALTS, n // 2_000_000)))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(binary) + F.lit(extra)).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"), key.alias("key"), salt.alias("salt"))
    rows = written(rows, "rows")
    parts = written(rows.groupBy("key", "salt").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.first("size").alias("size")), "parts")
    groups = written(parts.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum(F.col("n") * F.col("size")).alias("bytes")), "groups")
    prefix = written(running(groups, ["first", "key"], {"bytes": "upto", "n": "rows"}), "prefix")
    total = groups.agg(F.sum("bytes")).first()[0]
    cuts = minimax_cuts(prefix, int(total), shards, fan) if total else []
    before = F.array(*[F.lit(c).cast("long") for c in cuts])
    mine = F.size(F.filter(before, lambda c: c < F.col("upto"))) if cuts else F.lit(0)
    placed = written(prefix.select("key", mine.alias("shard"), (F.col("rows") - F.col("n")).alias("place")), "placed")
    base = placed.groupBy("shard").agg(F.min("place").alias("base"))  # one row a shard
    placed = placed.join(F.broadcast(base), "shard").select("key", "shard", (F.col("place") - F.col("base")).alias("place"))
    earlier = Window.partitionBy("key").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("key", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip")).join(placed, "key")
    parts = parts.select("key", "salt", "shard", (F.col("place") + F.col("skip")).alias("place"))
    order = Window.partitionBy("key", "salt").orderBy("doc_id")
    out = rows.join(parts, ["key", "salt"]).withColumn("slot", F.col("place") + F.row_number().over(order) - 1)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    none: Column = F.lit(None).cast("int")
    return shard(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"))
