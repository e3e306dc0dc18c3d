"""SimHash near-duplicates with pigeonring filtering.

The bits of a fingerprint form a ring of m segments.  If two fingerprints differ in at most t bits,
some segment starts a chain in which the first l segments differ in at most l * t / m bits together,
for every l (the pigeonring principle).  Where that budget is below one for the first ``run``
segments these are equal, which makes them an index key; candidates under a key are tested along the
chain, budget by budget, and only those that hold to its end get the full Hamming check.

Only spanning links leave a bucket, never all pairs.  A bucket of more than BLOCK fingerprints is
cut into blocks that meet pairwise in groups of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, stored, table, tidy
from tidemark.operators.components import connected_components

SEED = 42
BLOCK = 4096
#: Hot keys up to this number travel as a broadcast (16 bytes each), more by a join.
BROADCAST_KEYS = 200_000
#: Odd multipliers that give further 64-bit lanes of a shingle's hash.
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: MinHash keys of near copies, and the minima in each.
BANDS, DEPTH = 32, 4
SALTS, ODDS = (np.frombuffer(b"".join(xxhash.xxh64_digest(name + bytes([k]), SEED) for k in range(BANDS * DEPTH)), "<u8").astype(np.uint64) for name in (b"salt", b"odd"))
ODDS = ODDS | np.uint64(1)
#: Bits of 256 in which near copies may differ.  At a Jaccard similarity of 0.8 39 do on average, 48 in sets of a few shingles, with a deviation of 6.
APART = 90
#: They form a ring of so many segments, and a chain of so many must hold its budgets before all bits are counted.
SEGMENTS, CHAIN = 16, 6
#: Candidate components up to this size are compared throughout.
WHOLE = 4096


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; fewer words: of the whole sequence; none: empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-size] + 1]).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> bytes:
    """64 bits a lane, big-endian: a bit is 1 if it is set in over half the hashes; zero if there are none."""
    out = b""
    for lane in LANES[:lanes]:
        mixed = hashes * np.uint64(lane)
        if lane != 1:
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(lane)
            mixed ^= mixed >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 4096):
            bits = np.unpackbits(mixed[at : at + 4096].byteswap().view(np.uint8).reshape(-1, 8), axis=1)
            counts += bits.sum(axis=0, dtype=np.int64)
        out += np.packbits(counts * 2 > len(mixed)).tobytes()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id and text -> doc_id, fp binary.  Null and empty texts have the zero fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                found = [fingerprint(shingle_hashes(x, shingle), lanes) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "fp"])
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id", F.lit(b"").alias("fp")).schema)


class Ring:
    """The segments of a ring of ``bits`` bits, as masks over big-endian 64-bit words."""

    def __init__(self, bits: int, segments: int, distance: int, run: int | None):
        cuts = [bits * i // segments for i in range(segments + 1)]
        self.segments, self.distance, self.cuts = segments, distance, cuts
        self.budget = [(l * distance) // segments for l in range(1, segments + 1)]
        self.run = run or sum(b == 0 for b in self.budget)
        self.masks = np.zeros((segments, bits // 64), np.uint64)
        for i in range(segments):
            for bit in range(cuts[i], cuts[i + 1]):
                self.masks[i, bit // 64] |= np.uint64(1 << (63 - bit % 64))

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """One key for each start of a chain: the start and a hash of the equal segments."""
        if not self.run:
            raise ValueError("no chain of equal segments: take more segments, or set run")
        out = np.empty((len(fps), self.segments), np.int64)
        for i in range(self.segments):
            mask = np.bitwise_or.reduce(self.masks[[(i + k) % self.segments for k in range(self.run)]], axis=0)
            h = np.full(len(fps), i + 1, np.uint64)
            for w in range(fps.shape[1]):
                if mask[w]:
                    h = (h ^ (fps[:, w] & mask[w])) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(31)
            out[:, i] = (np.uint64(i) << np.uint64(56) | h >> np.uint64(8)).view(np.int64)
        return out

    def linked(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """x: exclusive ors of candidates; which of them hold all budgets of the chain, the last being the Hamming distance."""
        total = np.zeros(len(x), np.int64)
        alive = np.arange(len(x))
        for l in range(self.segments):
            mask = self.masks[(start[alive] + l) % self.segments]
            total[alive] += np.bitwise_count(x[alive] & mask).sum(axis=1, dtype=np.int64)
            alive = alive[total[alive] <= self.budget[l]]
            if not len(alive):
                break
        out = np.zeros(len(x), bool)
        out[alive] = True
        return out


    def chained(self, x: np.ndarray, length: int) -> np.ndarray:
        """x: exclusive ors of candidates; which of them have a chain of ``length`` consecutive segments that holds its budgets.  All within the distance have one."""
        counts = np.stack([np.bitwise_count(x & mask).sum(axis=1, dtype=np.int16) for mask in self.masks], axis=1)
        total, alive = np.zeros_like(counts), np.ones(counts.shape, bool)  # of the chains by their start
        for l in range(length):
            total += np.roll(counts, -l, axis=1)
            alive &= total <= self.budget[l]
        return alive.any(axis=1)


def _forest(group: np.ndarray, test: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Rows sorted by group -> for each row the first row that it is linked to, over any number of links that pass the test."""
    n = len(group)
    parent = np.arange(n)
    active, shift = np.arange(n), 1
    while True:
        active = active[active + shift < n]
        active = active[group[active] == group[active + shift]]
        if not len(active):
            return parent
        a = active[parent[active] != parent[active + shift]]
        if len(a):
            a = a[test(a, a + shift)]
            while len(a):
                pa_, pb = parent[a], parent[a + shift]
                np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
                while not np.array_equal(up := parent[parent], parent):
                    parent = up
                a = a[parent[a] != parent[a + shift]]
        shift += 1


def links(fps: DataFrame, *, bits: int = 64, distance: int = 2, segments: int = 6, run: int | None = None) -> DataFrame:
    """Distinct fp binary -> spanning links (a, b) of the graph that joins fingerprints of at most ``distance`` differing bits.

    Complete where the budgets give the equal run; with ``run`` set above that, a key may miss pairs
    (their chance falls with the distance), since then equality of the run isn't implied.
    """
    ring = Ring(bits, segments, distance, run)
    width = bits // 64

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                own = whole.column(0).slice(at, 8192)
                words = np.frombuffer(b"".join(own.to_pylist()), ">u8").astype(np.uint64).reshape(-1, width)
                keys = ring.keys(words).ravel()
                places = pa.array(np.repeat(np.arange(len(own)), segments))
                yield pa.RecordBatch.from_arrays([pa.array(keys), own.take(places)], names=["key", "fp"])

    keyed = stored(fps.select("fp").mapInArrow(spread, "key long, fp binary"))
    hot = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    count = hot.count()
    if count:
        tagged = keyed.join(F.broadcast(hot) if count <= BROADCAST_KEYS else hot, "key", "left")
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        mates = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64(F.col("key"), F.least(k, block), F.greatest(k, block)))
        # the start of the chain stays in the top byte of the group's key
        grouped = F.transform(mates, lambda h: F.shiftleft(F.shiftright("key", 56), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
        keyed = tagged.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(grouped)).alias("key"), "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []

        def settle(keys: np.ndarray, fps: list[bytes]) -> pa.RecordBatch:
            words = np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(-1, width)
            parent = _forest(keys, lambda a, b: ring.linked(words[a] ^ words[b], (keys[a] >> 56) & 255))
            rows = np.flatnonzero(parent != np.arange(len(keys)))
            found = pa.array(fps, pa.binary())
            return pa.RecordBatch.from_arrays([found.take(pa.array(rows)), found.take(pa.array(parent[rows]))], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 65536):
                batch = whole.slice(at, 65536)
                keys = batch.column(0).to_numpy()
                held.append((keys, batch.column(1).to_pylist()))
                keys = np.concatenate([k for k, _ in held])
                done = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if done:
                    fps_ = [x for _, f in held for x in f]
                    yield settle(keys[:done], fps_[:done])
                    held = [(keys[done:], fps_[done:])]
        if held:
            yield settle(np.concatenate([k for k, _ in held]), [x for _, f in held for x in f])
        held.clear()
        tidy()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, lanes: int = 1, distance: int = 2, segments: int = 6, run: int | None = None) -> DataFrame:
    """doc_id and text of ``docs`` -> doc_id, fp, component_id: the smallest doc_id that links can reach.

    Null and empty texts, and those without words, have the zero fingerprint and link like any other;
    long texts are read whole.  Equal fingerprints are one node, so copies and repeated rows are never
    compared with each other.  Null doc_ids stay as rows and are ignored in the minimum (a component of
    null ids alone has a null one); an empty table gives an empty table.  Other columns aren't looked at.
    """
    own = stored(fingerprints(docs, shingle, lanes))
    nodes = stored(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = connected_components(links(nodes, bits=64 * lanes, distance=distance, segments=segments, run=run))
    return _named(own, nodes, joined, "fp").select("doc_id", "fp", "component_id")


def _named(own: DataFrame, nodes: DataFrame, joined: DataFrame, by: str) -> DataFrame:
    """Rows of ``own`` with component_id, the smallest ``first`` of the nodes that theirs (column ``by``) is joined with."""
    groups = joined.join(nodes, joined.node == nodes[by]).select(nodes[by].alias("class"), "root", "first")
    lowest = groups.groupBy("root").agg(F.min("first").alias("low"))
    named = groups.select("class", "root").join(lowest, "root").select("class", "low")
    # stored, so that the engine can split the rows of a hot class in this join
    classes = stored(nodes.select(F.col(by).alias("class"), "first").join(named, "class", "left").select("class", F.coalesce("low", "first").alias("component_id")))
    return own.join(classes, F.col(by) == F.col("class"))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """MinHash keys of a set of grams: sets of Jaccard similarity s share one with a chance of 1 - (1 - s^DEPTH)^BANDS."""
    if not len(grams):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * DEPTH, 2**64 - 1, np.uint64)
    for at in range(0, len(grams), 512):
        low = np.minimum(low, ((grams[at : at + 512, None] ^ SALTS) * ODDS).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, DEPTH).T:
        key = (key ^ part) * np.uint64(LANES[1])
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _blocks(key: Column, n: Column, block: int) -> Column:
    """The groups in which a row of ``node`` meets the others of its key: blocks of about ``block`` rows, pairwise."""
    count = F.ceil(n / block).cast("int")
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.xxhash64(key, F.least(k, own), F.greatest(k, own)))


def near_copies(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id and text of ``docs`` -> doc_id, digest (of the text, as text_digest), component_id, kept.

    component_id is the smallest doc_id that links can reach, kept tells the one document of a component
    that stands for it: that of the smallest id, null last, then of the least digest.

    Nodes are the distinct sets of shingles.  Sets that share a MinHash key are candidates (at a
    similarity of 0.8 all but 5 in 100 million do): a distance of APART leaves no segment of the ring
    that must be equal, so the ring prunes candidates here but can't find them.  Those are linked whose
    fingerprints of shingles, each counted once, have a chain of CHAIN segments within its budgets and
    differ in at most APART bits of 256, and whose sets have a Jaccard similarity of 0.8 or more.
    Candidates are joined into components first; one of up to WHOLE sets is compared throughout, a larger
    one key by key.  Texts without words are copies of each other, null ones too; null ids are rows like
    any other, told apart by their texts; rows that repeat id and text are one document, and kept or not
    together; an empty table gives an empty table; other columns are not looked at.
    """
    ring = Ring(256, SEGMENTS, APART, None)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, "text"):
                yield described(batch, texts, [np.unique(shingle_hashes(x, shingle)) for x in texts])
        tidy()

    def described(batch: pa.RecordBatch, texts: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([hashlib.md5(x).hexdigest() for x in texts]), pa.array([xxhash.xxh3_128_digest(g.tobytes()) for g in sets], pa.binary()), pa.array([fingerprint(g, 4) for g in sets], pa.binary()), pa.array([band_keys(g) for g in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "digest", "node", "fp", "keys"])

    schema = docs.select("doc_id", F.lit("").alias("digest"), F.lit(b"").alias("node"), F.lit(b"").alias("fp"), F.array().cast("array<long>").alias("keys")).schema
    own = stored(docs.select("doc_id", "text").mapInArrow(describe, schema))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    nodes = stored(own.groupBy("node").agg(F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1")
    candidates = stored(connected_components(keyed.join(shared, "key").select(F.col("node").alias("a"), F.col("low").alias("b"))))
    sizes = candidates.groupBy("root").agg(F.count("*").alias("n"))
    placed = candidates.join(sizes, "root")
    whole = placed.filter(F.col("n") <= WHOLE).select(F.explode(_blocks(F.col("root"), F.col("n"), 256)).alias("group"), "node")
    large = keyed.join(placed.filter(F.col("n") > WHOLE).select("node"), "node", "left_semi").join(shared.select("key", "n"), "key")
    groups = whole.unionByName(large.select(F.explode(_blocks(F.col("key"), F.col("n"), 2048)).alias("group"), "node"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for _, texts in slices(whole, "text"):
                sets = [np.unique(shingle_hashes(x, shingle)).tobytes() for x in texts]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(g) for g in sets], pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["node", "grams"])
        tidy()

    # one document a node
    wanted = nodes.join(candidates, "node", "left_semi").select(F.col("first.doc_id").alias("wanted"), F.col("first.digest").alias("wanted_digest")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")) & (text_digest() == F.col("wanted_digest")), "left_semi").select("text")
    sets = stored(texts.mapInArrow(lay, "node binary, grams binary").join(candidates.select("node"), "node", "left_semi").dropDuplicates(["node"]))
    rows = groups.join(nodes.select("node", "fp").join(sets, "node"), "node").select("group", "node", "fp", "grams")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(held: pa.Table) -> pa.RecordBatch:
            words = np.frombuffer(b"".join(held["fp"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, 4)

            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in held["grams"]]
            sizes = np.array([len(x) for x in sets])

            def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                out = ring.chained(words[a] ^ words[b], CHAIN)
                held_ = np.flatnonzero(out)
                out[held_] = np.bitwise_count(words[a[held_]] ^ words[b[held_]]).sum(axis=1, dtype=np.int64) <= APART
                out &= 5 * np.minimum(sizes[a], sizes[b]) >= 4 * np.maximum(sizes[a], sizes[b])
                for k in np.flatnonzero(out):
                    common = len(np.intersect1d(sets[a[k]], sets[b[k]], assume_unique=True))
                    out[k] = 9 * common >= 4 * (sizes[a[k]] + sizes[b[k]])  # 0.8 of the union
                return out

            parent = _forest(held["group"].to_numpy(), near)
            found = np.flatnonzero(parent != np.arange(len(parent)))
            ends = held["node"].combine_chunks()
            return pa.RecordBatch.from_arrays([ends.take(pa.array(found)), ends.take(pa.array(parent[found]))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                group = batch.column(0).to_numpy()
                done = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if not done and held and held[-1].column(0)[-1].as_py() != group[-1]:
                    yield settle(pa.Table.from_batches(held))
                    held = []
                elif done:
                    yield settle(pa.Table.from_batches([*held, batch.slice(0, done)]))
                    held = []
                held.append(batch.slice(done))
        if held:
            yield settle(pa.Table.from_batches(held))
        tidy()

    found = rows.repartition("group").sortWithinPartitions("group").mapInArrow(join, "a binary, b binary")
    named = _named(own.select("doc_id", "digest", "node"), nodes, connected_components(found), "node")
    return named.select("doc_id", "digest", F.col("component_id.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("component_id.doc_id")) & (F.col("digest") == F.col("component_id.digest"))).alias("kept"))


def text_digest(text: str = "text") -> Column:
    """The digest by which near_copies tells documents of one id apart; null is empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def op4(spark, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint and the smallest id of its component."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
