"""Language-model scores by prediction by partial matching over bytes.

A trie of byte contexts holds, for every context of up to ORDER bytes, how often each symbol followed.
A symbol is coded in the longest context; where it never followed there an escape is coded, and the next
shorter context codes it with the symbols of the longer one excluded.  How likely an escape is depends
on the order, the total and the number of symbols of the context; it is estimated from the training
counts themselves, by leaving out one occurrence after the other: those that occur once would escape.  Since counts of a context are part of those of its suffix, the symbols to
exclude are just those of the context one byte longer; so each context needs only its total, its number
of symbols, and the mass that these have one level below.

Above the trained trie stands one adaptive level: a context of RECALL bytes that the document has had
before predicts the symbol that followed it last time.  Its escape probability is learned from the
training texts; after an escape that symbol is excluded from the trie's prediction.

Byte 0xFF, which UTF-8 never has, stands for the start (as context) and for the end of a text.

The trie is built once, piece by piece, into a file that executors get from the driver and map: its pages
are shared by their workers and given back when memory is short, so it costs a task no memory of its own.

A word unigram model with add-half smoothing is scored beside it.  Its counts are kept as a table: the
most frequent words travel to the executors, the others are joined.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.quality import remainder
from tidemark.llm.shared import slices, stored, table, tidy

ORDER = 5
#: Bytes of the document's own contexts (8 to 16).
RECALL = 16
#: A trie of up to so many leaves (about 60 bytes each) is sent as a file; a larger one is joined level by level.
MAPPED_LEAVES = 1 << 26
#: Leaves that the trie's builder holds in memory at once.
PIECE = 1 << 18
#: So many of the most frequent words are broadcast; all others are joined.
HEAD_WORDS = 100_000
PAD, END = b"\xff" * ORDER, b"\xff"
END_TOKEN = b"\n"  # no word has white space
#: Texts are read in blocks of up to so many bytes, and so many bytes of blocks at once.  A block knows
#: the context before it; what a document's own contexts predict is remembered within a block.
BLOCK, CHUNK = 1 << 19, 1 << 18
HELD_WORDS, HELD_LEAVES = 100_000, 1_500_000


def blocks(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Whole texts as blocks, about CHUNK bytes of them together: the text's index, the ORDER bytes before, the block; the end symbol is in a text's last block."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) + 1, BLOCK):
            body = t[at : at + BLOCK] + (END if at + BLOCK > len(t) else b"")
            held.append((k, (PAD + t[max(0, at - ORDER) : at])[-ORDER:], body))
            size += len(body)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def grams(own: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Codes of all contexts of blocks with their symbol (the lowest byte)."""
    raw = np.frombuffer(b"".join(x for _, before, body in own for x in (before, body)), np.uint8).astype(np.uint64)
    code = raw[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= raw[ORDER - k : len(raw) - k] << np.uint64(8 * k)
    sizes = np.fromiter((len(body) for _, _, body in own), np.int64, len(own))
    # between two blocks lie ORDER codes that have the next block's context as their symbol
    return code[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(own)) * ORDER, sizes)]


def recalled(own: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of blocks the one that followed the last RECALL bytes when the block had them before, or -1; and the symbol itself."""
    raw = b"".join(body for _, _, body in own)
    symbols = np.frombuffer(raw, np.uint8).astype(np.int64)
    sizes = np.fromiter((len(body) for _, _, body in own), np.int64, len(own))
    owner = np.repeat(np.arange(len(own)), sizes)
    found = np.full(len(symbols), -1, np.int64)
    late = np.flatnonzero(np.arange(len(symbols)) - (np.cumsum(sizes) - sizes)[owner] >= RECALL)
    if not len(late):
        return found, symbols
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).astype(np.uint64)
    h = words[late - 8] * np.uint64(0x9E3779B97F4A7C15)
    h = ((h ^ h >> np.uint64(29)) + words[late - RECALL]) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = ((h ^ h >> np.uint64(32)) + owner[late].astype(np.uint64)) * np.uint64(0x165667B19E3779F9)
    bits = np.uint64(int(len(late)).bit_length())
    key = h >> bits << bits | np.arange(len(late), dtype=np.uint64)
    key.sort()
    at = late[(key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)]
    key >>= bits
    again = np.flatnonzero(key[1:] == key[:-1])
    now, before = at[again + 1], at[again]
    equal = words[now - 8] == words[before - 8]
    equal &= (words[now - RECALL] == words[before - RECALL]) & (owner[now] == owner[before])
    found[now[equal]] = symbols[before[equal]]
    return found, symbols


Room = Callable[[str, type, int], np.ndarray]


def _memory(name: str, kind: type, size: int) -> np.ndarray:
    return np.empty(size, kind)


class Table:
    """Unsigned 64-bit keys -> index, by open addressing; looked up for many keys at once."""

    def __init__(self, keys: np.ndarray, index: np.ndarray | None = None, *, room: Room = _memory, name: str = ""):
        self.keys = keys
        if index is not None:  # built before
            self.index, self.bits = index, len(index).bit_length() - 1
            return
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.index = room(name, np.int32, 1 << self.bits)
        self.index[:] = -1
        for at in range(0, len(keys), PIECE):
            left = np.arange(at, min(at + PIECE, len(keys)))
            slot = self._slot(keys[left])
            while len(left):
                free = self.index[slot] < 0
                self.index[slot[free]] = left[free]  # the last of several stays
                open_ = self.index[slot] != left
                left, slot = left[open_], slot[open_] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1: absent."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self._slot(keys)
        own = self.index[slot]
        out = np.where(own < 0, -1, np.where(self.keys[own] == keys, own, -2))
        left = np.flatnonzero(out == -2)
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            own = self.index[slot[left]]
            out[left] = np.where(own < 0, -1, np.where(self.keys[own] == keys[left], own, -2))
            left = left[out[left] == -2]
        return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[firsts], np.add.reduceat(values, firsts) if len(keys) else values


TOTALS, KINDS = 32, 16  # classes of contexts
PRIOR = 2.0


def class_of(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Class of contexts by total (exact below 16, then by powers of two) and number of symbols (below 8, then by powers of two)."""
    t = np.where(total < 16, total, np.minimum(TOTALS - 1, 12 + np.log2(np.maximum(total, 1)).astype(np.int64)))
    k = np.where(kinds < 8, kinds, np.minimum(KINDS - 1, 5 + np.log2(np.maximum(kinds, 1)).astype(np.int64)))
    return t * KINDS + k


def class_column(total: Column, kinds: Column) -> Column:
    """class_of for columns."""
    t = F.when(total < 16, total).otherwise(F.least(F.lit(TOTALS - 1), 12 + F.floor(F.log2(total))))
    k = F.when(kinds < 8, kinds).otherwise(F.least(F.lit(KINDS - 1), 5 + F.floor(F.log2(kinds))))
    return t * KINDS + k


def escapes(escaped: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Escape probability of each class, from how often an occurrence left out was the only one, and how often one was left out.

    Where there is little to learn it leans to symbols / (total + symbols).
    """
    total, kinds = np.divmod(np.arange(TOTALS * KINDS), KINDS)
    total = np.where(total < 16, total, 2.0 ** (total - 12))
    kinds = np.where(kinds < 8, kinds, 2.0 ** (kinds - 5))
    guess = np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 0.5)
    return np.clip((escaped + PRIOR * guess) / (seen + PRIOR), 1e-6, 1 - 1e-6)


def tallies(total: np.ndarray, kinds: np.ndarray, single: np.ndarray) -> np.ndarray:
    """What escapes() takes, of contexts: their totals, numbers of symbols, and of symbols that occur once."""
    size = TOTALS * KINDS
    fewer, same = class_of(total - 1, kinds - 1), class_of(total - 1, kinds)
    escaped = np.bincount(fewer, single, size)
    return np.stack([escaped, escaped + np.bincount(same, total - single, size)])


def left_out(total: np.ndarray, kinds: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Escape probabilities learned from contexts."""
    return escapes(*tallies(total, kinds, single))


class Parts:
    """Arrays that are written piece by piece, as files of a folder."""

    def __init__(self, folder: str):
        self.folder, self.kinds = folder, {}

    def add(self, name: str, piece: np.ndarray) -> None:
        self.kinds[name] = piece.dtype
        with open(os.path.join(self.folder, name), "ab") as f:
            f.write(np.ascontiguousarray(piece))

    def room(self, name: str, kind: type, size: int) -> np.ndarray:
        """An array of any content, to be filled in place."""
        self.kinds[name] = np.dtype(kind)
        with open(os.path.join(self.folder, name), "wb") as f:
            f.truncate(size * self.kinds[name].itemsize)
        return self.get(name)

    def get(self, name: str, kind: type = np.int64) -> np.ndarray:
        """The array, mapped; one that nothing was added to is empty."""
        path = os.path.join(self.folder, name)
        if name not in self.kinds:
            self.add(name, np.zeros(0, kind))
        if not os.path.getsize(path):
            return np.zeros(0, self.kinds[name])
        with open(path, "r+b") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0), self.kinds[name])

    def drop(self, *names: str) -> None:
        for name in names:
            del self.kinds[name]
            os.remove(os.path.join(self.folder, name))

    def pack(self, path: str) -> dict[str, tuple[str, int, int]]:
        """All arrays in one file; returns kind, offset and length of each."""
        layout = {}
        with open(path, "wb") as out:
            for name, kind in self.kinds.items():
                out.seek(-out.tell() % 64, os.SEEK_CUR)
                with open(os.path.join(self.folder, name), "rb") as f:
                    size = os.fstat(f.fileno()).st_size
                    layout[name] = kind.str, out.tell(), size // kind.itemsize
                    shutil.copyfileobj(f, out, 1 << 20)
        return layout


def _summed(parts: Parts, gram: np.ndarray, n: np.ndarray, bits: int, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``n`` by the lowest ``bits`` of ``gram``, in ascending order; ranges of them are sorted one by one."""
    mask = np.uint64((1 << bits) - 1)
    pieces = len(gram) // PIECE + 1
    sample = np.sort(gram[:: max(1, len(gram) >> 16)] & mask)
    edges = np.unique(sample[np.arange(1, pieces) * len(sample) // pieces])
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        held = []
        for at in range(0, len(gram), PIECE):
            g = gram[at : at + PIECE] & mask
            own = np.ones(len(g), bool) if low is None else g >= low
            own &= True if high is None else g < high
            held.append((g[own], n[at : at + PIECE][own]))
        keys, sums = _grouped(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held])) if held else (gram, n)
        parts.add(names[0], keys.astype(np.uint64))
        parts.add(names[1], sums.astype(np.int64))
    return parts.get(names[0]), parts.get(names[1])


def _shrunk(parts: Parts, name: str, into: str) -> None:
    """Counts in 4 bytes where they fit."""
    counts = parts.get(name)
    kind = np.int32 if counts.max(initial=0) < 1 << 31 else np.int64
    for at in range(0, max(1, len(counts)), PIECE):
        parts.add(into, counts[at : at + PIECE].astype(kind))
    parts.drop(name)


def build(parts: Parts, leaves: np.ndarray, counts: np.ndarray) -> None:
    """Writes all levels of the trie; a few arrays of PIECE leaves are all that is in memory."""
    gram, n = _summed(parts, leaves, counts, 64 - 1, (f"gram{ORDER}", f"sum{ORDER}"))
    for k in range(ORDER, -1, -1):
        below = fewer = None
        if k:
            below, fewer = _summed(parts, gram, n, 8 * k, (f"gram{k - 1}", f"sum{k - 1}"))
        tally, at = np.zeros((2, TOTALS * KINDS)), 0
        while at < len(gram):
            end = min(at + PIECE, len(gram))
            end += int((gram[end : end + 256] >> np.uint64(8) == gram[end - 1] >> np.uint64(8)).sum())  # whole contexts
            g, own = gram[at:end], n[at:end]
            context = g >> np.uint64(8)
            firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            total, kinds = np.add.reduceat(own, firsts), np.diff(np.append(firsts, len(g)))
            mass = np.add.reduceat(fewer[np.searchsorted(below, g & np.uint64((1 << 8 * k) - 1))], firsts) if k else np.zeros(len(firsts), np.int64)
            tally += tallies(total, kinds, np.add.reduceat((own == 1).astype(np.int64), firsts))
            for name, piece in (("context", context[firsts]), ("all", total), ("kinds", kinds.astype(np.int16)), ("mass", mass)):
                parts.add(f"{name}{k}", piece)
            at = end
        escape = escapes(*tally)
        parts.add(f"escape{k}", escape)
        contexts, total, kinds = parts.get(f"context{k}", np.uint64), parts.get(f"all{k}"), parts.get(f"kinds{k}", np.int16)
        if k == ORDER:  # all that is looked up of the longest contexts' symbols is their cost
            at = 0
            for c in range(0, len(contexts), PIECE // 16):
                t, d = total[c : c + PIECE // 16], kinds[c : c + PIECE // 16].astype(np.int64)
                own = n[at : at + int(d.sum())]
                parts.add("top", np.log10(own / np.repeat(t, d) * (1 - np.repeat(escape[class_of(t, d)], d))))
                at += len(own)
            parts.get("top", np.float64)
        Table(gram, room=parts.room, name=f"gram_index{k}")
        Table(contexts, room=parts.room, name=f"context_index{k}")
        parts.get(f"mass{k}")
        _shrunk(parts, f"all{k}", f"total{k}")
        _shrunk(parts, f"mass{k}", f"below{k}")
        if k < ORDER:
            _shrunk(parts, f"sum{k}", f"n{k}")
        else:
            parts.drop(f"sum{k}")
        gram, n = below, fewer


class Trie:
    """All levels of a context trie, from the counts of its leaves or from a file of them."""

    def __init__(self, leaves: np.ndarray, counts: np.ndarray):
        with tempfile.TemporaryDirectory() as folder:  # what is mapped outlives its name
            parts = Parts(folder)
            build(parts, leaves.astype(np.uint64), counts.astype(np.int64))
            self._levels({name: parts.get(name) for name in list(parts.kinds)})

    @classmethod
    def mapped(cls, path: str, layout: dict[str, tuple[str, int, int]]) -> Trie:
        with open(path, "rb") as f:
            whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        out = cls.__new__(cls)
        out._levels({name: np.frombuffer(whole, kind, size, offset) if size else np.zeros(0, kind) for name, (kind, offset, size) in layout.items()})
        return out

    def _levels(self, a: dict[str, np.ndarray]) -> None:
        self.top = a["top"]
        self.levels = [
            (Table(a[f"gram{k}"], a[f"gram_index{k}"]), a.get(f"n{k}"), Table(a[f"context{k}"], a[f"context_index{k}"]), a[f"total{k}"], a[f"kinds{k}"], a[f"below{k}"], a[f"escape{k}"])
            for k in range(ORDER, -1, -1)
        ]

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol in its context."""
        out = np.zeros(len(codes))
        found = self.levels[0][0].find(codes)
        seen = found >= 0
        out[seen] = self.top[found[seen]]
        rest = np.flatnonzero(~seen)
        code = codes[rest]
        mass, kinds = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        for k, (leaves, n, contexts, total, distinct, below, escape) in zip(range(ORDER, -1, -1), self.levels, strict=True):
            if not len(rest):
                return out
            gram = code & np.uint64((1 << 8 * (k + 1)) - 1)
            at = contexts.find(gram >> np.uint64(8))
            known = at >= 0
            left = np.where(known, total[at] - mass, 0) if len(total) else np.zeros(len(rest), np.int64)
            other = np.where(known, distinct[at] - kinds, 0) if len(total) else np.zeros(len(rest), np.int64)
            own = leaves.find(gram)
            hit = own >= 0
            chance = escape[class_of(left, other)]
            if n is not None:  # what the longest contexts hold is found by now
                out[rest[hit]] += np.log10(n[own[hit]] / left[hit] * (1 - chance[hit]))
            escaped = ~hit & (other > 0)
            out[rest[escaped]] += np.log10(chance[escaped])
            mass, kinds = (np.where(known, below[at], mass), np.where(known, distinct[at], kinds)) if len(total) else (mass, kinds)
            rest, code, mass, kinds = rest[~hit], code[~hit], mass[~hit], kinds[~hit]
        out[rest] -= np.log10(256 - kinds)
        return out


#: In place of codes: how often a document's own context predicted, and how often it was right.
GUESSED, RIGHT = -1, -2


def corpus_counts(docs: DataFrame) -> DataFrame:
    """text -> (gram, word, n): counts of trie leaves (word null) and of words (gram null), summed within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TRIES.clear()  # of an earlier model
        tidy()
        words, held = Counter(), []
        guessed = right = 0

        def rows(gram, word, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["gram", "word", "n"])

        def word_rows() -> pa.RecordBatch:
            out = rows([None] * len(words), list(words), list(words.values()))
            words.clear()
            return out

        def leaf_rows() -> pa.RecordBatch:
            keys, n = _grouped(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))
            held.clear()
            return rows(keys.astype(np.int64), [None] * len(keys), n)

        for batch in batches:
            for _, texts in slices(batch, "text"):
                texts = [t.lower() for t in texts]
                for own in blocks(texts):
                    held.append(np.unique(grams(own), return_counts=True))
                    guess, symbols = recalled(own)
                    guessed += int((guess >= 0).sum())
                    right += int((guess == symbols).sum())
                    if sum(len(k) for k, _ in held) > 2 * HELD_LEAVES:
                        held[:] = [_grouped(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]))]
                        if len(held[0][0]) > HELD_LEAVES:
                            yield leaf_rows()
                for t in texts:
                    words.update(t.split())
                    if len(words) > HELD_WORDS:
                        yield word_rows()
                words[END_TOKEN] += len(texts)
        if held:
            yield leaf_rows()
        if words:
            yield word_rows()
        yield rows([GUESSED, RIGHT], [None, None], [guessed, right])
        tidy()

    return docs.select("text").mapInArrow(run, "gram long, word binary, n long")


class Model:
    """Counts of a training corpus as tables."""

    def __init__(self, docs: DataFrame):
        raw = stored(corpus_counts(docs))
        self.leaves = stored(raw.filter("gram >= 0").groupBy("gram").agg(F.sum("n").alias("n")))
        self.words = stored(raw.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
        own = {r.gram: r.n for r in raw.filter("gram < 0").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        self.miss = (own.get(GUESSED, 0) - own.get(RIGHT, 0) + 1) / (own.get(GUESSED, 0) + 2)
        row = self.words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
        self.kinds, self.tokens = row.v, row.n or 0
        self.denominator = self.tokens + 0.5 * (self.kinds + 1)

    def trie(self) -> tuple[str, dict[str, tuple[str, int, int]]]:
        """The trie as a file on the driver's disk, and its layout; the leaves come partition by partition."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy().tobytes()], pa.binary()) for k in range(2)], names=["gram", "n"])

        folder = tempfile.mkdtemp(prefix="tidemark-trie-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors may come for the file as long as the driver lives
        path = os.path.realpath(os.path.join(folder, uuid.uuid4().hex))
        with tempfile.TemporaryDirectory(dir=folder) as scratch:
            parts = Parts(scratch)
            for row in self.leaves.select("gram", "n").mapInArrow(run, "gram binary, n binary").toLocalIterator():
                parts.add("leaves", np.frombuffer(row.gram, np.uint64))
                parts.add("counts", np.frombuffer(row.n, np.int64))
            build(parts, parts.get("leaves", np.uint64), parts.get("counts"))
            parts.drop("leaves", "counts")
            return path, parts.pack(path)

    def head(self) -> dict[bytes, float]:
        rows = self.words.orderBy(F.col("n").desc(), "word").limit(HEAD_WORDS).toArrow()
        return dict(zip(rows.column("word").to_pylist(), np.log10((rows.column("n").to_numpy() + 0.5) / self.denominator).tolist(), strict=True))


def _joined_escapes(contexts: DataFrame) -> np.ndarray:
    """left_out for a table of contexts; the classes are few."""
    fewer, same = class_column(F.col("total") - 1, F.col("distinct") - 1), class_column(F.col("total") - 1, F.col("distinct"))
    sides = F.array(F.struct(fewer.cast("long").alias("c"), F.col("single").alias("e"), F.col("single").alias("s")), F.struct(same.cast("long").alias("c"), F.lit(0).cast("long").alias("e"), (F.col("total") - F.col("single")).alias("s")))
    escaped, seen = np.zeros(TOTALS * KINDS), np.zeros(TOTALS * KINDS)
    for row in contexts.select(F.inline(sides)).groupBy("c").agg(F.sum("e").alias("e"), F.sum("s").alias("s")).collect():
        escaped[row.c], seen[row.c] = row.e, row.s
    return escapes(escaped, seen)


def _joined_score(model: Model, uses: DataFrame) -> DataFrame:
    """(key, gram, uses, item, role) -> (key, trie_score) where the trie is too large to broadcast: its levels are joined one after the other."""
    leaves, rest, parts = model.leaves, uses, []
    once = F.sum((F.col("n") == 1).cast("long"))
    rest = rest.select("key", "gram", "uses", "item", "role", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("mass"), F.lit(0).cast("long").alias("kinds"))
    for k in range(ORDER, -1, -1):
        mask = F.lit((1 << 8 * (k + 1)) - 1).cast("long")
        below = leaves.groupBy(F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.sum("n").alias("n")) if k else None
        inner = leaves.withColumn("m", F.lit(0).cast("long"))
        if k:
            inner = leaves.withColumn("low", F.col("gram").bitwiseAND((1 << 8 * k) - 1)).join(below.select(F.col("gram").alias("low"), F.col("n").alias("m")), "low")
        contexts = inner.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("m").alias("below"), once.alias("single"))
        contexts = stored(contexts)
        escape = F.array(*(F.lit(float(x)) for x in _joined_escapes(contexts)))
        own = leaves.select(F.col("gram").alias("own"), F.col("n").alias("hits"))
        # few keys, so hot ones: 256 at most to the power of a context's length, or one more for its symbols
        contexts, own = F.broadcast(contexts) if k <= 2 else contexts, F.broadcast(own) if k <= 1 else own
        now = rest.withColumn("own", F.col("gram").bitwiseAND(mask)).join(own, "own", "left").withColumn("context", F.shiftright("own", 8)).join(contexts, "context", "left")
        left, other = F.col("total") - F.col("mass"), F.col("distinct") - F.col("kinds")
        now = now.withColumns({"left": left, "other": other})
        now = now.withColumn("chance", F.element_at(escape, (class_column(F.col("left"), F.col("other")) + 1).cast("int")))
        parts.append(now.filter("hits IS NOT NULL").select("key", "item", "role", (F.col("uses") * (F.col("log") + F.log10(F.col("hits") / F.col("left") * (1 - F.col("chance"))))).alias("s")))
        escape = F.when(F.col("other") > 0, F.log10("chance")).otherwise(0.0)
        rest = stored(now.filter("hits IS NULL").select("key", "gram", "uses", "item", "role", (F.col("log") + escape).alias("log"), F.coalesce("below", "mass").alias("mass"), F.coalesce("distinct", "kinds").alias("kinds")))
        leaves = stored(below) if k else None
    parts.append(rest.select("key", "item", "role", (F.col("uses") * (F.col("log") - F.log10(256 - F.col("kinds")))).alias("s")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = whole.groupBy("key", "item").agg(F.sum(F.when(F.col("role") == 0, F.col("s"))).alias("own"), F.sum(F.when(F.col("role") == 1, F.col("s"))).alias("other"))
    left = F.when(F.col("item") >= 0, F.log10(1 - F.pow(F.lit(10.0), F.col("other")))).otherwise(0.0)
    return whole.groupBy("key").agg(F.sum(F.col("own") - left).alias("trie_score"))


_TRIES: dict[str, Trie] = {}


def _trie(name: str, layout: dict) -> Trie:
    """The trie of a file that executors were sent, mapped once by each worker."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie.mapped(SparkFiles.get(name), layout)
    return _TRIES[name]


def score(docs: DataFrame, model: Model, *, leaves_limit: int = MAPPED_LEAVES) -> DataFrame:
    """doc_id and text of ``docs`` -> doc_id, n_tokens, n_known, base_score, score (log10 probabilities of the lower-cased text).

    Null texts are empty; an empty text has one token, its end.  Rows are told apart by their place,
    so null and repeated ids, and repeated rows and ties, give a row each.  Without training texts the
    model is uniform; an empty table gives an empty table.  Texts of any length are read whole, block by
    block.  Other columns of ``docs`` are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    small = model.leaves.count() <= leaves_limit
    path, layout = model.trie() if small else ("", {})
    if small:
        spark.sparkContext.addFile(path)
    shared = spark.sparkContext.broadcast(model.head())
    name, miss, id_kind = os.path.basename(path), model.miss, dict(docs.dtypes)["doc_id"]
    fields = {"key": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "tail": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "gram": pa.int64(), "uses": pa.int64(), "item": pa.int64(), "role": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(name, layout) if small else None
        get = shared.value.get
        row = TaskContext.get().partitionId() << 40

        def rows(ids: pa.Array, **columns) -> pa.RecordBatch:
            """Rows with these columns, the others null."""
            return pa.RecordBatch.from_arrays([ids, *(pa.array(columns[c], k) if c in columns else pa.nulls(len(ids), k) for c, k in fields.items())], names=["doc_id", *fields])

        for batch in batches:
            for part, texts in slices(batch, "text"):
                texts = [t.lower() for t in texts]
                scores = np.zeros(len(texts))
                first = 0  # symbols of the blocks before
                for own in blocks(texts):
                    codes = grams(own)
                    guess, symbols = recalled(own)
                    wrong = np.flatnonzero((guess >= 0) & (guess != symbols))
                    other = codes[wrong] & ~np.uint64(255) | guess[wrong].astype(np.uint64)
                    logs = np.where(guess == symbols, np.log10(1 - miss), 0.0)
                    logs[wrong] = np.log10(miss)
                    open_ = guess != symbols
                    owner = np.repeat([k for k, _, _ in own], [len(body) for _, _, body in own])
                    if trie:
                        logs[open_] += trie.log10(codes[open_])
                        logs[wrong] -= np.log10(1 - 10 ** trie.log10(other))
                    else:
                        # symbols after an escape are looked up one by one, with the excluded symbol; the others by kind
                        after = np.zeros(len(codes), bool)
                        after[wrong] = True
                        plain = np.flatnonzero(open_ & ~after)
                        plain = plain[np.lexsort((codes[plain], owner[plain]))]
                        one = np.flatnonzero(np.append(True, (codes[plain][1:] != codes[plain][:-1]) | (owner[plain][1:] != owner[plain][:-1]))[: len(plain)])
                        picked = np.concatenate([plain[one], wrong, wrong])
                        role = np.repeat([0, 1], [len(picked) - len(wrong), len(wrong)])
                        item = np.concatenate([np.full(len(one), -1), first + wrong, first + wrong])
                        gram = np.concatenate([codes[plain[one]], codes[wrong], other]).astype(np.int64)
                        times = np.concatenate([np.diff(np.append(one, len(plain))), np.ones(2 * len(wrong), np.int64)])
                        yield rows(pa.nulls(len(picked), part.column(0).type), key=row + owner[picked], gram=gram, uses=times, item=item, role=role)
                    scores += np.bincount(owner, logs, len(texts))
                    first += len(codes)
                tokens, known, base, tails, counts = [], [], [], [], []
                for t in texts:
                    words = [*t.split(), END_TOKEN]
                    logs = [*map(get, words)]
                    found = [x for x in logs if x is not None]
                    tail = Counter([w for w, x in zip(words, logs, strict=True) if x is None]) if len(found) < len(words) else {}
                    tokens.append(len(words))
                    known.append(len(found))
                    base.append(sum(found))
                    tails.append(list(tail))
                    counts.append(list(tail.values()))
                yield rows(part.column(0), key=np.arange(row, row + len(texts)), n_tokens=tokens, known=known, base=base, score=scores, tail=tails, counts=counts)
                row += len(texts)
        tidy()

    kinds = "key long, n_tokens long, known long, base double, score double, tail array<binary>, counts array<long>, gram long, uses long, item long, role long"
    whole = stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_kind}, {kinds}"))
    uses = whole.filter("gram IS NOT NULL").select("key", "gram", "uses", "item", "role")  # where levels are joined
    scored = whole.filter("gram IS NULL").drop("gram", "uses", "item", "role")
    tail = scored.select("key", F.explode(F.arrays_zip("tail", "counts")).alias("t")).select("key", F.col("t.tail").alias("word"), F.col("t.counts").alias("uses"))
    tail = tail.join(model.words, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(model.denominator))
    tail = tail.groupBy("key").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("uses")).otherwise(0)).alias("tail_known"), F.sum(F.col("uses") * log).alias("tail_base"))
    out = scored.drop("tail", "counts").join(tail, "key", "left")
    if not small:
        out = out.join(_joined_score(model, uses), "key", "left").withColumn("score", F.col("score") + F.coalesce("trie_score", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), (F.col("base") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"), "score")


def held_out() -> Column:
    return remainder(5) == 1


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = Model(docs.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
