"""Exact removal of repeated long strings with a run-length index.

A byte goes if a string of LENGTH bytes that covers it also starts earlier in the corpus.

1. Every window of LENGTH bytes is led to the 32-byte gram in it of least hash, the leftmost of equals.
   Equal windows have equal grams at equal places, so only grams that occur twice can matter; a shuffle
   of gram hashes finds these.  Consecutive windows with one gram in common form a stretch.
2. Stretches of such grams are cut from the texts.  Of equal stretches within a task only the earliest
   goes on, the others are repeats as a whole; so no stretch is sent more often than there are tasks.
3. Stretches meet by their gram; equal ones are entered once, for the earliest, and the others are
   repeats.  Groups of different stretches are concatenated into texts of bounded size; for each a
   run-compressed Burrows-Wheeler transform is built, with the earliest place sampled for each run of
   rows that agree in LENGTH bytes.  All stretches are then streamed backwards through the index by LF
   steps: the row of a position tells its run, that is whether its matching statistic reaches LENGTH at
   an earlier position.
4. A gram that occurs more than HOT times (a line that very many documents share, in different
   surroundings) would make one group too large: its stretches go on as single windows, which meet by a
   hash of 64 bits, confirmed by 64 more, and are read as a sorted stream, the earliest first.
5. Marked ranges are merged by document and cut out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import packed, replacing, slices, stored, table, tidy, unpacked

LENGTH, GRAM = 100, 32
#: Bytes of stretches that are indexed together, unless one group is larger.
INDEX_BYTES = 1 << 20
#: Bytes of distinct stretches that a task holds before it sends them on.
HELD_BYTES = 48 << 20
#: Occurrences of a gram beyond which its stretches go on as windows; at most HOT_GRAMS of them travel to all tasks (8 bytes each).
HOT, HOT_GRAMS = 20_000, 1_000_000
LAST = (1 << 63) - 1
SEPARATOR = 0xFF  # not in UTF-8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


#: Texts are joined up to about so many bytes; places within a piece take PLACE_BITS bits.
PIECE_BYTES, PLACE_BITS = 1 << 20, 24


def gram_hashes(text: bytes) -> np.ndarray:
    """A hash of the 32 bytes at each place."""
    n = len(text) - GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,)).astype(np.uint64)
    h = words[:n] * _MIX[0]
    for k in range(1, 4):
        h = (h ^ (h >> np.uint64(29))) * _MIX[k] + words[8 * k : 8 * k + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def _piece(joined: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a piece the hash of its gram and the gram's place.

    The least of the upper bits decides, and the leftmost of equals: equal windows choose alike.  The whole hash is the key.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    h = gram_hashes(joined)
    key = h & ~low
    key |= np.arange(len(key), dtype=np.uint64)
    width, have = length - GRAM + 1, 1
    while have * 2 <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    place = (key & low).astype(np.int64)
    return h[place], place


def stretches(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows led to the same gram: the text's index, the gram's hash and place, the first window, the number of windows."""
    found: list[tuple] = []
    # long texts are cut into pieces that share the bytes of a window but one
    span = PIECE_BYTES * 8
    parts = [(k, at, t[at : at + span + length - 1] if len(t) > span else t) for k, t in enumerate(texts) if len(t) >= length for at in range(0, max(1, len(t) - length + 1), span)]
    first = 0
    while first < len(parts):
        last, size = first, 0
        while last < len(parts) and (size == 0 or size + len(parts[last][2]) <= PIECE_BYTES):
            size += len(parts[last][2])
            last += 1
        own = parts[first:last]
        first = last
        sizes = np.array([len(t) for _, _, t in own])
        starts = np.cumsum(sizes) - sizes
        h, place = _piece(own[0][2] if len(own) == 1 else b"".join(t for _, _, t in own), length)
        part = np.repeat(np.arange(len(own)), sizes)[: len(h)]
        inside = np.arange(len(h)) + length <= (starts + sizes)[part]
        new = inside & np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        at = np.flatnonzero(new)
        # a run ends where the next begins, or where its text does
        ends = np.minimum(np.append(at[1:], len(h)), (starts + sizes)[part[at]] - length + 1)
        shift = np.array([a for _, a, _ in own])[part[at]] - starts[part[at]]
        found.append((np.array([k for k, _, _ in own])[part[at]], h[at], place[at] + shift, at + shift, ends - at))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _keyed(docs: DataFrame, length: int) -> DataFrame:
    """Texts that have a window.  doc: the id, null last; th: a hash of the text; row: what the grams are listed under, the id or, where it is null, another hash of the text."""
    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc, F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"), F.coalesce(doc, F.xxhash64(F.lit("row"), "text")).alias("row"), "text")
    return rows.filter(F.octet_length("text") >= length)


def repeated_grams(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row, places): grams of documents that lead stretches and occur more than once as such; and (h, n): grams that do so more than HOT times.

    Texts listed under one id share their places, so some may name grams that aren't repeated; these do no harm.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                text, h, place, _, _ = stretches(texts, length)
                doc = batch.column(0).to_numpy()[text].astype(np.int64)
                # what is repeated here already goes on as a list by document; one of it stands for the rest
                _, first, owner, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                known = count[owner] > 1
                sent = np.concatenate([np.flatnonzero(~known), first[count > 1]])
                lists = np.split(place[known].astype(np.int32), np.flatnonzero(np.diff(text[known])) + 1) if known.any() else []
                heads = doc[known][np.cumsum([0, *map(len, lists[:-1])])] if lists else doc[:0]
                keys = np.concatenate([h[sent], heads.astype(np.uint64) * _MIX[0]]).view(np.int64)
                times = np.concatenate([count[owner[sent]], np.zeros(len(heads), np.int64)])
                columns = [pa.array(keys), pa.array(np.concatenate([doc[sent], heads])), pa.array([*place[sent].tolist(), *[None] * len(lists)], pa.int32()), pa.array(times.astype(np.int32)), pa.array([*[None] * len(sent), *(x.tobytes() for x in lists)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "row", "place", "times", "known"])
        tidy()

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row: its hash, whether it is repeated, document, place, and how often the hash has occurred
        names = ["row", "places", "h", "n"]

        def rows(doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1, dtype=np.int32)), pa.array(place.astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(doc), lists, pa.nulls(len(doc), pa.int64()), pa.nulls(len(doc), pa.int64())], names=names)

        def often(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            hot = n > HOT
            k = int(hot.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.array(h[hot]), pa.array(n[hot])], names=names)

        for whole in batches:
            lists = whole.filter(pc.is_valid(whole.column(4)))
            if lists.num_rows:
                known = [np.frombuffer(x, np.int32) for x in lists.column(4).to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, known)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([lists.column(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(known))), pa.nulls(len(known), pa.int64()), pa.nulls(len(known), pa.int64())], names=names)
            batch = whole.filter(pc.is_null(whole.column(4)))
            if not batch.num_rows:
                continue
            h, doc, place, times = (batch.column(k).to_numpy() for k in range(4))
            same = np.concatenate([[held is not None and held[0] == h[0]], h[1:] == h[:-1]])
            if held is not None and (held[1] or same[0]):
                yield rows(*held[2:4])
            firsts = np.flatnonzero(np.concatenate([[True], ~same[1:]]))
            totals = np.add.reduceat(times.astype(np.int64), firsts)
            if same[0]:
                totals[0] += held[4]
            elif held is not None:
                yield often(np.array([held[0]]), np.array([held[4]]))
            yield often(h[firsts[:-1]], totals[:-1])
            keep = same.copy()
            keep[:-1] |= same[1:]
            held, keep[-1] = (h[-1], bool(keep[-1]), doc[-1:], place[-1:], int(totals[-1])), False
            yield rows(doc[keep], place[keep])
        if held is not None:
            yield often(np.array([held[0]]), np.array([held[4]]))
            if held[1]:
                yield rows(*held[2:4])

    all_ = keyed.select("row", "text").mapInArrow(emit, "h long, row long, place int, times int, known binary")
    return all_.repartition("h").sortWithinPartitions("h").mapInArrow(repeated, "row long, places array<int>, h long, n long")


STRETCH = "doc long, th long, start int, stop int, key long, bytes binary, windows int"
_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32())
_NAMES = ["doc", "th", "start", "stop", "key", "bytes", "windows"]


def cut_out(keyed: DataFrame, found: DataFrame, length: int = LENGTH) -> DataFrame:
    """Stretches of repeated grams (key, bytes, windows; from ``start``); with null bytes, ranges that repeat an earlier stretch of the same task; with -1 windows, single windows of hot grams by their hash."""
    spark = keyed.sparkSession
    often = found.filter("h IS NOT NULL").orderBy(F.col("n").desc(), "h").limit(HOT_GRAMS).select("h").toArrow()
    hot = spark.sparkContext.broadcast(np.sort(often.column("h").to_numpy()))
    grams = found.filter("row IS NOT NULL").groupBy("row").agg(F.flatten(F.collect_list("places")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int, int, int, int]] = {}
        marks: list[tuple[int, int, int, int]] = []
        size = 0
        everywhere = hot.value

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), 20000):
                columns = zip(*rows[at : at + 20000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal size
            rows = [(d, t, a, b, d ^ t, None, None) for d, t, a, b in marks]
            marks.clear()
            if everything:
                keys = np.fromiter((x[4] for x in held.values()), np.int64, len(held))
                for far, (content, (d, t, a, n, key)) in zip(np.isin(keys, everywhere).tolist(), held.items(), strict=True):
                    if not far:
                        rows.append((d, t, a, None, key, content, n))
                        continue
                    for w in range(n):
                        digest = xxhash.xxh3_128_digest(content[w : w + length])
                        rows.append((d, t, a + w, None, int.from_bytes(digest[:8], "little", signed=True), digest[8:], -1))
                    if len(rows) > 20000:
                        yield from out(rows)
                        rows = []
                held.clear()
                size = 0
            yield from out(rows)

        for whole in batches:
            for batch, small in slices(whole, "text", 1 << 20):
                docs, hashes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [unpacked(x) for x in small]
                own, h, place, begin, count = stretches(texts, length)
                places = batch.column(3)
                listed = (np.repeat(np.arange(len(texts)), places.value_lengths().to_numpy()) << 32) + places.flatten().to_numpy()
                chosen = np.isin((own << 32) + place, listed)
                columns = (x[chosen].tolist() for x in (own, h.view(np.int64), begin, count))
                for k, key, at, n in zip(*columns, strict=True):
                    content = texts[k][at : at + n - 1 + length]
                    now = (docs[k], hashes[k], at, n, key)
                    before = held.setdefault(content, now)
                    if before is now:
                        size += len(content) + 250
                    elif now[:3] != before[:3]:
                        if now < before:
                            held[content], now = now, before
                        last = marks[-1] if marks else None
                        if last and last[0] == now[0] and last[1] == now[1] and last[2] <= now[2] <= last[3]:
                            marks[-1] = (*last[:3], max(last[3], now[2] + len(content)))
                        else:
                            marks.append((now[0], now[1], now[2], now[2] + len(content)))
                if size > HELD_BYTES:
                    yield from flush(True)
                elif len(marks) > 20000:
                    yield from flush(False)
        yield from flush(True)
        tidy()

    return packed(keyed).join(grams, "row").select("doc", "th", "text", "places").mapInArrow(run, STRETCH)


class Ones:
    """A bit vector with the given ones and a count for each word of 64 bits; rank by popcount."""

    def __init__(self, places: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def run(self, rows: np.ndarray) -> np.ndarray:
        """How many ones stand up to each row, less one: the number of its run."""
        word = rows >> 6
        upto = ~np.uint64(0) >> (63 - (rows & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & upto) - 1


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts joined by separators.

    ``order`` tells for each place of the joined text how early it is in the corpus, ``last`` where the
    separator behind it is.  Separators rise and are above all other symbols, so the last rows are those
    of the separators, in the order of the texts: there the streaming of a text begins.  What is kept is
    where runs of equal symbols begin and where LF leads them, and, for runs of rows that agree in
    ``length`` bytes, the sample of their earliest place.
    """

    def __init__(self, joined: np.ndarray, order: np.ndarray, last: np.ndarray, length: int):
        n = len(joined)
        padded = np.concatenate([joined, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | padded[k : k + n]
        beyond = (8 * np.maximum(0, 7 - (last - np.arange(n)))).astype(np.uint64)  # bits behind the separator don't count
        key = key >> beyond << beyond
        rows = np.argsort(key)
        ordered = key[rows]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])  # rows that open a group of equals, and the end
        # prefix doubling; the rank of a group is its first row, and only groups of several are sorted on
        place = np.maximum.accumulate(np.where(first[:-1], np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[rows] = place
        depth, agree = 8, None
        while depth < 2 * length:
            if agree is None and depth * 2 >= length:  # rows that agree in ``length`` bytes
                agree = self._paired(rank, np.arange(n), length - depth, last)
            tied = np.flatnonzero(~(first[:-1] & first[1:]))
            if not len(tied):
                break
            key = self._paired(rank, rows[tied], depth, last)
            by = np.argsort(key)
            rows[tied] = rows[tied][by]
            ordered = key[by]
            first[tied] = np.concatenate([[True], ordered[1:] != ordered[:-1]])
            place[tied] = np.maximum.accumulate(np.where(first[tied], tied, 0))
            rank[rows[tied]] = place[tied]
            depth *= 2
        tied = np.flatnonzero(~(first[:-1] & first[1:]))
        if len(tied):  # equal to the separator
            rows[tied] = rows[tied][np.argsort(place[tied].astype(np.uint64) << np.uint64(32) | rows[tied].astype(np.uint64))]
        before = joined[rows - 1]
        self.starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        symbols = before[self.starts].astype(np.int64)
        sizes = np.diff(np.append(self.starts, n))
        by_symbol = np.argsort(symbols, kind="stable")
        self.heads = np.empty(len(symbols), np.int64)
        self.heads[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        self.runs = Ones(self.starts, n)
        same = agree[rows]
        intervals = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        self.intervals = Ones(intervals, n)
        self.earliest = np.minimum.reduceat(order[rows], intervals)
        self.rows = n

    @staticmethod
    def _paired(rank: np.ndarray, at: np.ndarray, shift: int, last: np.ndarray) -> np.ndarray:
        ahead = at + shift
        other = np.where(ahead <= last[at], rank[np.minimum(ahead, len(rank) - 1)] + 1, 0)
        return rank[at].astype(np.uint64) << np.uint64(32) | other.astype(np.uint64)

    def step(self, rows: np.ndarray) -> np.ndarray:
        """LF: the rows of the places one before those of ``rows``."""
        run = self.runs.run(rows)
        return self.heads[run] + rows - self.starts[run]

    def earliest_match(self, rows: np.ndarray) -> np.ndarray:
        """How early the first place is that agrees with each row in ``length`` bytes."""
        return self.earliest[self.intervals.run(rows)]


def marked(contents: list[bytes], windows: np.ndarray, orders: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each stretch the numbers of its windows that occur earlier; orders: how early its first window is."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    joined = np.frombuffer(b"".join(x for c in contents for x in (c, b"\xff")), np.uint8)
    ends = np.cumsum(sizes + 1) - 1  # places of the separators
    order = np.repeat(orders - (ends - sizes), sizes + 1) + np.arange(len(joined))
    index = RunIndex(joined, order, np.repeat(ends, sizes + 1), length)
    rows, own = index.rows - len(contents) + np.arange(len(contents)), np.arange(len(contents))
    hits = []
    for back in range(1, int(sizes.max()) + 1):
        rows = index.step(rows)
        at = sizes[own] - back  # place within the stretch
        there = np.flatnonzero(at < windows[own])
        early = there[index.earliest_match(rows[there]) < orders[own[there]] + at[there]]
        hits.append(own[early] << 32 | at[early])
        alive = at > 0
        rows, own = rows[alive], own[alive]
    hit = np.sort(np.concatenate(hits))
    return np.split(hit & (1 << 32) - 1, np.searchsorted(hit, np.arange(1, len(contents)) << 32))


def find_repeats(cuts: DataFrame, length: int = LENGTH) -> DataFrame:
    """What cut_out gives -> (doc, th, start, stop): ranges whose windows occur earlier."""

    kinds, names = (pa.int64(), pa.int64(), pa.int32(), pa.int32()), ["doc", "th", "start", "stop"]

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        t = pa.Table.from_batches(rows)
        keys = t.column("key").to_numpy()
        alone = np.concatenate([[True], keys[1:] != keys[:-1]]) & np.concatenate([keys[1:] != keys[:-1], [True]])[: len(keys)] if len(keys) else np.zeros(0, bool)
        t = t.filter(pa.array(~alone[: len(keys)]))
        earliest: dict[bytes, tuple[int, int, int, int, int]] = {}  # equal stretches are entered once, for the first of them
        for doc, th, start, key, content, n in zip(*(t.column(c).to_pylist() for c in ("doc", "th", "start", "key", "bytes", "windows")), strict=True):
            now = (doc, th, start, n, key)
            before = earliest.setdefault(content, now)
            if before is not now and now[:3] != before[:3]:
                if now < before:
                    earliest[content], now = now, before
                out.append((*now[:3], now[2] + len(content)))
        members = Counter(x[4] for x in earliest.values())
        kept = [(c, x) for c, x in earliest.items() if members[x[4]] > 1]
        if kept:
            docs, hashes, starts, windows = (np.array([x[k] for _, x in kept], np.int64) for k in range(4))
            by = np.lexsort((hashes, docs))
            number = np.empty(len(by), np.int64)
            number[by] = np.cumsum(np.concatenate([[0], (docs[by][1:] != docs[by][:-1]) | (hashes[by][1:] != hashes[by][:-1])]))
            found = marked([c for c, _ in kept], windows, (number << 32) + starts, length)
            for k, hits in enumerate(found):
                if len(hits):
                    firsts = np.flatnonzero(np.concatenate([[True], np.diff(hits) > length]))
                    lasts = np.append(firsts[1:], len(hits)) - 1
                    out += [(docs[k], hashes[k], starts[k] + hits[a], starts[k] + hits[b] + length) for a, b in zip(firsts, lasts, strict=True)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def later(batch: pa.RecordBatch, first: tuple | None) -> tuple[pa.RecordBatch, tuple]:
        """Windows in the order of key and place: those behind the first of their key; and the last key's first."""
        key, doc, th, start = (batch.column(k).to_numpy() for k in (4, 0, 1, 2))
        digest = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<u8")
        begins = np.concatenate([[first is None or first[0] != key[0]], key[1:] != key[:-1]])
        lead = np.maximum.accumulate(np.where(begins, np.arange(len(key)), -1))
        of = lambda own, k: np.where(lead >= 0, own[lead], first[k] if first else 0)
        behind = (of(digest, 1) == digest) & ((of(doc, 2) != doc) | (of(th, 3) != th) | (of(start, 4) != start))
        rows = pa.RecordBatch.from_arrays([pa.array(doc[behind]), pa.array(th[behind]), pa.array(start[behind], pa.int32()), pa.array(start[behind] + length, pa.int32())], names=names)
        k = lead[-1]
        return rows, first if k < 0 else (key[k], digest[k], doc[k], th[k], start[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, first = [], 0, None
        for whole in batches:
            ready = pc.is_valid(whole.column(3))
            done = whole.filter(ready)
            yield pa.RecordBatch.from_arrays(done.columns[:4], names=names)
            single = pc.equal(pc.fill_null(whole.column(6), 0), -1)
            windows = whole.filter(single)
            if windows.num_rows:
                found, first = later(windows, first)
                yield found
            rest = whole.filter(pc.invert(pc.or_(ready, single)))
            for batch, _ in slices(rest, "bytes", INDEX_BYTES):
                held.append(batch)
                size += batch.column(5).nbytes
                if size < INDEX_BYTES:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                keys = t.column("key").to_numpy()
                done = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if done:
                    yield from settle(t.slice(0, done).to_batches())
                    held = t.slice(done).combine_chunks().to_batches()
                    size = sum(b.column(5).nbytes for b in held)
        if held:
            yield from settle(held)
        held.clear()
        tidy()

    return cuts.repartition("key").sortWithinPartitions("key", "doc", "th", "start").mapInArrow(run, "doc long, th long, start int, stop int")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and text -> (doc, th, spans): ranges (start, stop) of repeated bytes, not merged yet.  Documents without any are left out."""
    keyed = _keyed(docs, length)
    spans = find_repeats(cut_out(keyed, stored(repeated_grams(keyed, length)), length), length)
    return spans.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the bytes of characters that they hold in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, *, characters: bool = False) -> DataFrame:
    """All columns of ``docs``, and kept binary, removed array<struct<start, stop>>: the bytes that stay, and the maximal ranges that went.

    ``characters``: characters of which some bytes would stay, stay whole.

    A document is earlier if its doc_id is smaller; null ids are last; of equal ids a hash of the text
    decides.  Rows that repeat both id and text are one document, and each keeps the same bytes.  Null
    texts are empty and keep nothing; texts shorter than ``length`` stay as they are; long ones are read
    whole.  An empty table gives an empty table.  Columns named kept or removed give way to the results.
    """
    spans = repeated_spans(docs, length)
    docs = replacing(docs, "kept", "removed")
    names, at = docs.columns, docs.columns.index("text")
    schema = docs.withColumns({"kept": F.lit(b""), "removed": F.array().cast("array<struct<start: int, stop: int>>")}).schema
    # under the join all columns have names of our own, so those of the input are free
    plain = [F.col(f"`{c}`").alias("text" if k == at else f"kept{k}") for k, c in enumerate(names)]
    keyed = docs.select(*plain, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th"))
    joined = packed(keyed).join(spans, ["doc", "th"], "left").drop("doc", "th")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, small in slices(whole, "text", 1 << 20):
                texts, kept, removed = [unpacked(x) for x in small], [], []
                for text, own in zip(texts, batch.column(len(names)).to_pylist(), strict=True):
                    ranges = whole_characters(text, merge(own)) if characters else merge(own)
                    places = [0, *(x for r in ranges for x in r), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(places[::2], places[1::2], strict=True)))
                    removed.append([{"start": a, "stop": b} for a, b in ranges])
                known = batch.column(at).is_valid().to_pylist()
                plain = pa.array([t.decode() if k else None for t, k in zip(texts, known, strict=True)], pa.string())
                own = [plain if i == at else c for i, c in enumerate(batch.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.binary()), pa.array(removed, kind)], names=schema.names)
        tidy()

    return joined.mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """One row per document: how many of its bytes go, in how many ranges, and a digest of the rest."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n: Column = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", n.alias("n_bytes"), (n - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
