"""Byte-level BPE by ranks, with a hierarchical-bitmap rank queue.

Pairs wait in one bucket per merge rank; a bucket holds positions of the linked list of parts.  A
two-level bitmap tells which buckets have entries, and find-first-set picks the lowest rank, so a
pre-token of n bytes takes O(n log n) whatever its length.  An entry whose pair has changed since is
stale and skipped when it comes up.

Many pre-tokens share one queue: their lists are laid side by side with a gap between them.  The lowest
rank of all is the lowest of each list that has it, so every list merges as if it were alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import replacing, slices, table, tidy

#: A word of the lower bitmap has 2^8 bits.
WORD_BITS, WORD_MASK = 8, 255
#: Bytes of merged pre-tokens in one of the two generations that a worker remembers.
MEMORY = 80 << 20
#: Bytes of pre-tokens that share a queue, unless one is longer.
QUEUE = 1 << 17
#: UTF-8 bytes of text encoded before rows go back to Spark.
FLUSH = 4 << 20


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class Encoder:
    """Splits texts and merges their pre-tokens; remembers merges in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pairs = np.full(1 << 16, -1, np.int32)  # two bytes -> rank
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.young: dict[str, bytes] = {}  # pre-token -> its ids, as int32 bytes
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.split = regex.compile(pattern).findall
        self.split_ascii = None
        if r"\p{L}" in pattern:  # the same pattern over ASCII alone, for the faster engine
            narrow = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\r0-9A-Za-z]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]")
            if r"\p" not in narrow:
                self.split_ascii = re.compile(narrow).findall

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as int32 bytes."""
        ranks = self.ranks
        out = [b""] * len(pieces)
        open_ = []
        for k, piece in enumerate(pieces):
            if (whole := ranks.get(piece)) is not None:
                out[k] = array("i", (whole,)).tobytes()
            elif piece:
                open_.append(k)
        first = 0
        while first < len(open_):
            last, size = first, 0
            while last < len(open_) and (size == 0 or size + len(pieces[open_[last]]) <= QUEUE):
                size += len(pieces[open_[last]])
                last += 1
            own = open_[first:last]
            for k, ids in zip(own, self._queue([pieces[k] for k in own]), strict=True):
                out[k] = ids
            first = last
        return out

    def _queue(self, pieces: list[bytes]) -> Iterator[bytes]:
        ranks = self.ranks
        joined = b"".join(x for piece in pieces for x in (piece, b"\0"))  # a gap behind each piece
        n = len(joined)
        stops = np.cumsum([len(piece) + 1 for piece in pieces]) - 1  # the gaps
        gap = bytearray(n)
        np.frombuffer(gap, np.uint8)[stops] = 1
        codes = np.frombuffer(joined, np.uint8).astype(np.int32)
        first = np.full(n, -1, np.int32)
        first[:-1] = self.pairs[codes[:-1] << 8 | codes[1:]]
        first[stops] = first[stops - 1] = -1
        pending = array("i", first.tobytes())  # rank of the pair that starts there; -1: none
        end = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())  # where the part that starts there ends, and the next one starts
        back = np.arange(-1, n, dtype=np.int32)  # start of the part before
        back[stops + 1] = -1
        before = array("i", back.tobytes())
        places = np.flatnonzero(first >= 0)
        order = places[np.argsort(first[places], kind="stable")]  # ascending within a bucket, so a heap
        buckets: dict[int, list[int]] = {}
        low: dict[int, int] = {}  # word -> bitmap of its ranks that have a bucket
        top = 0  # bitmap of the words
        if len(order):
            cuts = np.flatnonzero(np.diff(first[order])) + 1
            kinds = first[order[np.concatenate([[0], cuts])]].tolist()
            buckets = dict(zip(kinds, map(np.ndarray.tolist, np.split(order, cuts)), strict=True))
            for rank in kinds:
                low[rank >> WORD_BITS] = low.get(rank >> WORD_BITS, 0) | 1 << (rank & WORD_MASK)
            for word in low:
                top |= 1 << word
        get = ranks.get
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            bit = bits & -bits
            rank = (word << WORD_BITS) + bit.bit_length() - 1
            bucket = buckets[rank]
            lower = False  # a merge has made a pair of lower rank, which goes first
            while bucket and not lower:
                i = heappop(bucket)
                if pending[i] != rank:
                    continue  # stale
                middle = end[i]
                pending[middle] = -1
                end[i] = stop = end[middle]
                right = -1
                if not gap[stop]:
                    before[stop] = i
                    right = get(joined[i : end[stop]], -1)
                pending[i] = right
                fresh = () if right < 0 else ((right, i),)
                if (left := before[i]) >= 0:
                    new = get(joined[left:stop], -1)
                    if new != pending[left]:
                        pending[left] = new
                        if new >= 0:
                            fresh += ((new, left),)
                for made, at in fresh:
                    if made in buckets:
                        heappush(buckets[made], at)
                    else:
                        buckets[made] = [at]
                        part = made >> WORD_BITS
                        low[part] = low.get(part, 0) | 1 << (made & WORD_MASK)
                        top |= 1 << part
                    lower |= made < rank
            if not bucket:
                del buckets[rank]
                low[word] &= ~bit
                if not low[word]:
                    top &= ~(1 << word)
        at = 0
        for piece in pieces:
            ids, stop = array("i"), at + len(piece)
            while at < stop:
                ids.append(ranks[joined[at : end[at]]])
                at = end[at]
            at += 1
            yield ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        split, narrow = self.split, self.split_ascii
        pieces = [narrow(t) if narrow and t.isascii() else split(t) for t in texts]
        new = set().union(*pieces).difference(self.young)
        if new:
            if self.size > MEMORY:
                self.old, self.young, self.size = self.young, {}, 0
                new = set().union(*pieces)
            found = {x: self.old[x] for x in new if x in self.old}
            open_ = list(new.difference(found))
            found.update(zip(open_, self.merge([x.encode() for x in open_]), strict=True))
            self.young.update(found)
            self.size += sum(len(x) + len(ids) for x, ids in found.items()) + 190 * len(found)
        get = self.young.__getitem__
        return [b"".join(map(get, own)) for own in pieces]


class Decoder:
    """Ids -> the bytes of their tokens, and their decimal names."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [b"%d" % k for k in range(len(self.tokens))]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def listed(self, ids: list[int]) -> bytes:
        return b",".join(map(self.names.__getitem__, ids))


_CODERS: dict[tuple[int, str], tuple[Encoder, Decoder]] = {}


def _coder(content: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """The coder of a vocabulary, kept by a worker from task to task."""
    key = (hash(content), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        ranks = read_ranks(content)
        _CODERS[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _CODERS[key]


def vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and text of ``docs`` -> the columns ``keep`` and ids array<int>.

    Null and empty texts have no ids; repeated rows, ties and null keys are kept as they are, each row by
    itself; an empty table gives an empty table; a text is always encoded whole, however long.  Other
    columns of ``docs`` are not looked at; a kept column named ids gives way to the result.  The
    vocabulary (under 1 MB) goes to the executors as a broadcast.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    keep = tuple(c for c in keep if c.lower() != "ids")
    narrow = docs.select(*(F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)), "text")  # names of kept columns are free
    schema = docs.select(*(F.col(f"`{c}`") for c in keep), F.array().cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _coder(content.value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text", FLUSH):
                out = encoder.encode([t.decode() for t in texts])
                offsets = np.cumsum([0, *(len(x) // 4 for x in out)])
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(out), np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], names=schema.names)
        tidy()

    return narrow.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """All columns of ``encoded`` -> the same, and decoded binary, the bytes of ids array<int>.

    Null ids decode to no bytes, null ids within a list to none either; rows are independent, so ties,
    repeated rows and empty tables need no care; a column decoded of the input gives way to the result.
    """
    content = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    encoded = replacing(encoded, "decoded")
    schema = encoded.withColumn("decoded", F.lit(b"")).schema
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(read_ranks(content.value))
        for whole in batches:
            counts = whole.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(counts, dtype=np.int64) // (FLUSH // 4))) + 1).tolist(), whole.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = whole.slice(a, b - a)
                found = [decoder.decode([i for i in ids or () if i is not None]) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=schema.names)
        tidy()

    return encoded.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text -> doc_id, n_tokens, and digests of the listed ids and of the bytes that these decode to, in one pass.

    Nulls, repeated rows, ties, empty and very long texts as in ``encode``; nothing but the digests
    of a text leaves its task.
    """
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _coder(content.value, pattern)
        for batch in batches:
            for part, texts in slices(batch, "text", FLUSH):
                rows = []
                for found in encoder.encode([t.decode() for t in texts]):
                    ids = array("i", found).tolist()
                    rows.append((len(ids), hashlib.sha256(decoder.listed(ids)).hexdigest(), hashlib.sha256(decoder.decode(ids)).hexdigest()))
                columns = (pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def multilingual() -> tuple[str, str]:
    """The production vocabulary: path of its rank file, and its splitting pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op10(spark, sf_dir: str) -> DataFrame:
    """One row per document: token count, digest of its ids, digest of their bytes."""
    return digests(table(spark, sf_dir, "documents"), *multilingual())
