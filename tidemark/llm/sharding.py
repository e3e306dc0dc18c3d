"""Sharding by the minimax contiguous partition of ordered atomic groups.

Documents of equal text are one atomic group.  Groups larger than their share of a shard stand first, the
others in the order of a hash of their text.  The shards are contiguous runs of groups, and the largest
shard is as small as it can be: the smallest feasible capacity is found by binary search, each try packs
greedily.  Of the cuts that keep to this capacity those are taken that come nearest to the mean of what
is left, so shards are near equal and none is empty while groups suffice.

The driver never sees all groups.  It holds byte sums of hash ranges ("cells"), at first 2^14 of
them, and splits into 2^8 only those in which a cut may fall, until the cuts are exact: at most shards
squared times 2^8 more a round, and there are no more rounds than the hash has bits over 8 and the two
searches need, whatever the number of documents.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import stored, table

HASH_BITS, FIRST_BITS, STEP_BITS = 60, 14, 8
#: Rows of a shard are numbered in so many slices.
SLICES = 1024


def text_hash(text: Column) -> Column:
    """59 bits of a hash, above those of the groups that stand first."""
    whole = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.shiftright(whole, 1) + F.lit(1 << HASH_BITS - 1)


class Cells:
    """Byte sums of disjoint hash ranges in order: start, width in bits, bytes, whether it is one group."""

    def __init__(self, rows: list[tuple[int, int, int, bool]]):
        self.rows = sorted(rows)
        self.ends = []
        total = 0
        for _, _, size, _ in self.rows:
            total += size
            self.ends.append(total)
        self.total = total

    def start(self, i: int) -> int:
        return self.ends[i] - self.rows[i][2]

    def cut(self, begin: int, capacity: int, low: bool) -> tuple[int, int | None]:
        """Greedy end, in bytes, of the shard from byte ``begin``; the cell it can't decide, if any.

        low: the cut is taken at that cell's start, else wherever the capacity ends.
        """
        i = bisect_right(self.ends, begin + capacity)
        if i == len(self.rows):
            return self.total, None
        if self.rows[i][3]:
            return max(begin, self.start(i)), None
        return (max(begin, self.start(i)) if low else begin + capacity), i

    def below(self, x: int) -> tuple[int, int | None]:
        """The last boundary of groups up to byte x; the cell that must be split to tell, if any."""
        i = bisect_right(self.ends, x)
        if i == len(self.rows):
            return self.total, None
        at = self.start(i)
        return (at, None) if at == x or self.rows[i][3] else (x, i)

    def above(self, x: int) -> tuple[int, int | None]:
        """The first boundary of groups from byte x on; the cell that must be split to tell, if any."""
        i = bisect_right(self.ends, x)
        if i == len(self.rows) or self.start(i) == x:
            return min(x, self.total), None
        return (self.ends[i], None) if self.rows[i][3] else (x, i)

    def pack(self, capacity: int, shards: int, low: bool) -> tuple[bool, list[int], set[int]]:
        at, cuts, open_cells = 0, [], set()
        for _ in range(shards):
            at, cell = self.cut(at, capacity, low)
            cuts.append(at)
            if cell is not None:
                open_cells.add(cell)
        return at >= self.total, cuts, open_cells


def _sums(groups: DataFrame, bits: int) -> list[tuple[int, int, int, bool]]:
    width = HASH_BITS - bits
    rows = groups.groupBy(F.shiftright("h", width).alias("c")).agg(F.sum("bytes").alias("b"), F.min("h").alias("low"), F.count("*").alias("n")).collect()
    return [(r.low if r.n == 1 else r.c << width, 0 if r.n == 1 else width, r.b, r.n == 1) for r in rows]


def _split(groups: DataFrame, cells: Cells, chosen: set[int]) -> Cells:
    """Splits the chosen cells.  Their number is bounded by the shards squared."""
    rows = [r for i, r in enumerate(cells.rows) if i not in chosen]
    by_width: dict[int, list[int]] = {}
    for i in chosen:
        start, width, _, _ = cells.rows[i]
        by_width.setdefault(width, []).append(start >> width)
    spark = groups.sparkSession
    for width, keys in by_width.items():
        wanted = spark.createDataFrame([(k,) for k in keys], "k long")
        part = groups.join(F.broadcast(wanted), F.shiftright("h", width) == F.col("k"), "left_semi")
        rows += _sums(part, min(HASH_BITS, HASH_BITS - width + STEP_BITS))
    return Cells(rows)


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """(h, bytes) of groups -> the smallest capacity, and the first hash of shards 1, 2, ... (2^60: no rows)."""
    cells = Cells(_sums(groups, FIRST_BITS))
    low = max(groups.agg(F.max("bytes")).first()[0] or 0, -(-cells.total // shards))
    high = max(cells.total, low)
    while True:
        doubtful: set[int] = set()
        lo, hi = low, high
        while lo < hi:
            mid = (lo + hi) // 2
            sure, late, _ = cells.pack(mid, shards, True)
            if sure:
                hi = mid
            elif not cells.pack(mid, shards, False)[0]:
                lo = mid + 1
            else:
                doubtful = _between(cells, late, cells.pack(mid, shards, False)[1])
                break
        low, high = lo, hi
        if not doubtful:
            cuts, doubtful = even_cuts(cells, low, shards)
            if not doubtful:
                return low, [cells.rows[i][0] if (i := bisect_right(cells.ends, c)) < len(cells.rows) else 1 << HASH_BITS for c in cuts]
        cells = _split(groups, cells, doubtful)


def even_cuts(cells: Cells, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """The ends, in bytes, of all shards but the last, near the mean of what is left; and the cells that must be split to tell."""
    open_: set[int] = set()

    def known(found: tuple[int, int | None]) -> int:
        if found[1] is not None:
            open_.add(found[1])
        return found[0]

    least = [cells.total]  # what the last 0, 1, 2 ... shards can hold starts there
    for _ in range(shards - 1):
        least.append(known(cells.above(max(0, least[-1] - capacity))))
    at, cuts = 0, []
    for k in range(shards - 1):
        most = known(cells.below(at + capacity))
        mean = at + (cells.total - at) // (shards - k)
        down, up = known(cells.below(mean)), known(cells.above(mean))
        cut = up if down <= at or up - mean < mean - down else down
        at = min(max(cut, least[shards - 1 - k]), most)
        cuts.append(at)
    return cuts, open_


def _between(cells: Cells, low: list[int], high: list[int]) -> set[int]:
    """Cells that aren't single groups from the lowest to the highest possible place of each cut."""
    out: set[int] = set()
    for a, b in zip(low, high, strict=True):
        for i in range(bisect_right(cells.ends, a), min(len(cells.rows), bisect_right(cells.ends, b) + 1)):
            if not cells.rows[i][3]:
                out.add(i)
    return out


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id and text of ``docs`` -> doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text plus 16.  Equal texts (null is the empty text) share a shard.
    slot: from 0 without gaps within a shard, by id (null first) and hash of the text within slices.
    Null and repeated doc_ids are rows like any other; repeated rows have neighbouring slots and are
    counted before they are shuffled.  An empty table gives an empty table; a group larger than the mean
    shard sets the capacity; of fewer groups than shards the last shards stay empty.  Other columns
    of ``docs`` are not looked at, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_hash(text).alias("h"))
    rows = stored(rows.groupBy("doc_id", "size", "text_crc32", "h").agg(F.count("*").alias("n")))
    groups = stored(rows.groupBy("h").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")))
    # no more than ``shards`` groups can be larger than the share of a shard
    left, first = groups.agg(F.sum("bytes")).first()[0] or 0, []
    for r in groups.orderBy(F.col("bytes").desc(), "h").limit(shards).collect():
        if r.bytes * (shards - len(first)) <= left:
            break
        first.append(r.h)
        left -= r.bytes
    place = F.col("h")
    if first:
        place = F.coalesce(F.create_map(*(F.lit(x) for k, h in enumerate(first) for x in (h, k)))[F.col("h")].cast("long"), F.col("h"))
    _, starts = minimax_cuts(groups.withColumn("h", place), shards)
    number = F.lit(0)
    for start in starts:
        number = number + (place >= F.lit(start)).cast("int")
    rows = rows.withColumn("shard", number).withColumn("slice", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SLICES)).cast("int"))
    counts = rows.groupBy("shard", "slice").agg(F.sum("n").alias("n"))  # shards * SLICES rows at most
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard", "slice").orderBy("doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("within", within).join(F.broadcast(offsets), ["shard", "slice"])
    return out.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), (F.col("offset") + F.col("within")).alias("slot")).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("copy")).alias("slot"))


def op9(spark, sf_dir: str) -> DataFrame:
    """One row per document, in shards 0 to 39 by the law of near equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
