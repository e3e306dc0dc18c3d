"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

The width of an LZW code follows from how many codes came since the last clear code, so a whole run
of codes is cut out of the bit stream at once; and a code stands for an earlier stretch of the
output, so strings are resolved for all codes together, one byte of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import replacing, slices, stored, table, tidy

#: A payload is stored 64 samples to a row, up to 1024 rows to a frame.
ROW, ROWS = 64, 1024
BINS = 8
#: Payload bytes handled before rows go back to Spark.
FLUSH = 4 << 20


@dataclass
class Frame:
    """One image of a GIF: its place on the canvas, colour numbers, and how it is shown."""

    pixels: np.ndarray  # height x width colour numbers
    palette: np.ndarray  # colours x 3
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = 0  # 2: back to the background, 3: back to what was before
    transparent: int | None = None
    interlaced: bool = False


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame] = field(default_factory=list)


def _widths(codes: int, size: int) -> np.ndarray:
    """Bits of each code since a clear code: the table has 2^size + 2 entries, then one more for each code but the first."""
    entries = (1 << size) + 1 + np.arange(codes)
    entries[:1] += 1
    widths = np.full(codes, size + 1)
    for bits in range(size + 1, 12):
        widths[entries >= 1 << bits] = bits + 1
    return widths


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The LZW code stream of colour numbers below 2^size (2 to 8), with a clear code whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    runs: list[list[int]] = []
    codes: list[int] = []
    if data:
        known: dict[int, int] = {}
        find, add, free, prefix = known.get, codes.append, end + 1, data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            code = find(key)
            if code is None:
                add(prefix)
                if free < 4096:
                    known[key] = free
                    free += 1
                else:
                    runs.append(codes)
                    codes, known, free = [], {}, end + 1
                    find, add = known.get, codes.append
                prefix = byte
            else:
                prefix = code
        add(prefix)
    runs.append(codes)
    values, widths = [np.array([clear])], [np.array([size + 1])]
    for k, run in enumerate(runs):
        values.append(np.array([*run, end if k + 1 == len(runs) else clear]))
        widths.append(_widths(len(run) + 1, size))
    value, width = np.concatenate(values), np.concatenate(widths)
    bits = (value[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


def _cut(stream: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All codes of a stream but clear and end, and how many runs of codes came before each."""
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int32)
    clear, end, total = 1 << size, (1 << size) + 1, len(stream) * 8
    widths = _widths(4096, size)
    starts = np.cumsum(widths) - widths
    at, run, filled, codes, runs = 0, 0, 0, [], []
    while at + size + 1 <= total:
        if filled:  # a full table that goes on without a clear code
            offsets, width = at + 12 * np.arange(4096), np.full(4096, 12)
        else:
            offsets, width = at + starts, widths
        keep = offsets + width <= total
        offsets, width = offsets[keep], width[keep]
        if not len(offsets):
            break
        b = offsets >> 3
        got = (raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (offsets & 7) & (1 << width) - 1
        special = np.flatnonzero((got == clear) | (got == end))
        stop = special[0] if len(special) else len(got)
        codes.append(got[:stop])
        runs.append(np.full(stop, run))
        if len(special) and got[stop] == end:
            break
        at = int(offsets[stop] + width[stop]) if len(special) else int(offsets[-1] + width[-1])
        if len(special):
            run, filled = run + 1, 0
        else:
            filled = 1
            if len(got) < 4096:
                break
    empty = np.zeros(0, np.int64)
    return np.concatenate([*codes, empty]).astype(np.int64), np.concatenate([*runs, empty]).astype(np.int64)


def lzw_decode(streams: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The colour numbers of LZW streams, decoded together.  A broken stream raises ValueError."""
    parts = [_cut(s, k) for s, k in zip(streams, sizes, strict=True)]
    counts = np.array([len(c) for c, _ in parts])
    if not counts.sum():
        return [np.zeros(0, np.uint8) for _ in streams]
    code = np.concatenate([c for c, _ in parts])
    n = len(code)
    owner = np.repeat(np.arange(len(parts)), counts)
    base = np.array([1 << k for k in sizes])[owner]  # literals are below
    run = np.concatenate([r for _, r in parts])
    first = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])]))
    begin = np.repeat(first, np.diff(np.concatenate([first, [n]])))  # index of the first code of the run
    literal = code < base
    source = np.where(literal, -1, begin + code - base - 2)  # the code whose string, with one byte more, this one stands for
    if np.any(~literal & ((code < base + 2) | (source >= np.arange(n)))):
        raise ValueError("broken LZW stream")
    lengths, head = np.ones(n, np.int64), np.arange(n)
    active = np.flatnonzero(~literal)
    while len(active):
        head[active] = source[head[active]]
        lengths[active] += 1
        active = active[source[head[active]] >= 0]
    leading = code[head].astype(np.uint8)
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]), np.uint8)
    at, now, place = np.arange(n), np.arange(n), ends - 1
    while len(at):
        up = source[now]
        done = up < 0
        out[place[done]] = leading[now[done]]
        at, up, place = at[~done], up[~done], place[~done]
        out[place] = leading[up + 1]
        now, place = up, place - 1
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def _rows(height: int) -> np.ndarray:
    """Rows in the order in which an interlaced image has them."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def write_gif(gif: Gif) -> bytes:
    out = [b"GIF89a", struct.pack("<HHBBB", gif.width, gif.height, 0x70, 0, 0)]
    shared = gif.frames[0].palette if gif.frames else np.zeros((2, 3), np.uint8)
    bits = max(1, (len(shared) - 1).bit_length())
    out[1] = struct.pack("<HHBBB", gif.width, gif.height, 0xF0 | bits - 1, 0, 0)
    out.append(np.resize(np.vstack([shared, np.zeros(((1 << bits) - len(shared), 3), np.uint8)]), (1 << bits, 3)).astype(np.uint8).tobytes())
    for f in gif.frames:
        own = f.palette is not shared and not np.array_equal(f.palette, shared)
        bits = max(1, (len(f.palette) - 1).bit_length())
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_ms // 10, f.transparent or 0) + b"\0")
        height, width = f.pixels.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, width, height, (0x80 | bits - 1) * own | 0x40 * f.interlaced))
        if own:
            out.append(np.vstack([f.palette, np.zeros(((1 << bits) - len(f.palette), 3), np.uint8)]).astype(np.uint8).tobytes())
        size = max(2, bits)
        pixels = f.pixels[_rows(height)] if f.interlaced else f.pixels
        out += [bytes([size]), _blocks(lzw_encode(pixels.astype(np.uint8).tobytes(), size))]
    return b"".join([*out, b"\x3b"])


def read_gifs(files: list[bytes]) -> list[Gif]:
    """Parses GIF 87a and 89a files and decodes all their images.  What isn't a GIF raises ValueError."""
    gifs, waiting = [], []
    for data in files:
        if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
            raise ValueError("not a GIF")
        width, height, flags = struct.unpack_from("<HHB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        gif, shown = Gif(width, height), (0, 0, None)
        while at < len(data) and data[at] != 0x3B:
            kind, at = data[at], at + 1
            if kind == 0x2C:
                left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
                at += 9
                palette = shared
                if flags & 0x80:
                    n = 2 << (flags & 7)
                    palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
                    at += 3 * n
                if palette is None:
                    raise ValueError("an image without a palette")
                size, at = data[at], at + 1
            elif kind == 0x21:
                label, at = data[at], at + 1
            else:
                raise ValueError("broken GIF")
            chunks = []
            while n := data[at]:
                chunks.append(data[at + 1 : at + 1 + n])
                at += 1 + n
            at += 1
            if kind == 0x2C:
                gif.frames.append(Frame(np.zeros((h, w), np.uint8), palette, left, top, shown[0] * 10, shown[1], shown[2], bool(flags & 0x40)))
                waiting.append((gif.frames[-1], b"".join(chunks), size))
                shown = (0, 0, None)
            elif label == 0xF9 and chunks:
                flags, delay, clear = struct.unpack_from("<BHB", chunks[0])
                shown = (delay, flags >> 2 & 7, clear if flags & 1 else None)
        gifs.append(gif)
    for (frame, *_), samples in zip(waiting, lzw_decode([s for _, s, _ in waiting], [k for *_, k in waiting]), strict=True):
        h, w = frame.pixels.shape
        flat = np.zeros(h * w, np.uint8)
        flat[: len(samples)] = samples[: h * w]
        frame.pixels = flat.reshape(h, w)
        if frame.interlaced:
            pixels = np.empty_like(frame.pixels)
            pixels[_rows(h)] = frame.pixels
            frame.pixels = pixels
    return gifs


def compose(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas, height x width x RGBA, as each frame shows it."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        h, w = f.pixels.shape
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        pixels = f.pixels[: area.shape[0], : area.shape[1]]
        table_ = np.full((256, 4), 255, np.uint8)
        table_[: len(f.palette), :3] = f.palette
        table_[len(f.palette) :, :3] = 0
        if f.transparent is None:
            area[:] = table_[pixels]
        else:
            seen = pixels != f.transparent
            area[seen] = table_[pixels[seen]]
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """BINS counts for each of red, green and blue, over the pixels that aren't transparent."""
    seen = canvas.reshape(-1, 4)
    if not seen[:, 3].all():
        seen = seen[seen[:, 3] > 0]
    return np.concatenate([np.bincount(seen[:, k] >> 5, minlength=BINS) for k in range(3)])


FRAME_COLUMNS = "frame int, delay_ms int, width int, height int, disposal int, transparent int, rgba binary, histogram array<long>"


def frames(media: DataFrame, column: str = "media") -> DataFrame:
    """A GIF column -> one row for each frame: the other columns, its timing, the composed canvas, its colour histogram.

    Null, empty and broken files have one row with null frame columns; a GIF without images has none.
    Rows are independent: null ids, ties and repeated rows need no care; an empty table gives an empty
    table; other columns named as a frame column give way to it.
    """
    media = replacing(media, *(x.split()[0] for x in FRAME_COLUMNS.split(", ") if x.split()[0] != column))
    keep = [c for c in media.columns if c != column]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in media.select(*keep).dtypes), FRAME_COLUMNS])
    kinds = media.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(batch.schema.get_field_index(column)).to_pylist()
            for i, data in enumerate(files):
                own = [batch.column(batch.schema.get_field_index(c))[i].as_py() for c in keep]
                rows = []
                try:
                    gif = read_gifs([data or b""])[0]
                    for k, (f, canvas) in enumerate(zip(gif.frames, compose(gif), strict=True)):
                        rows.append([*own, k, f.delay_ms, gif.width, gif.height, f.disposal, f.transparent, canvas.tobytes(), histogram(canvas).tolist()])
                except (ValueError, IndexError, struct.error):
                    rows = [[*own, *[None] * 8]]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return media.mapInArrow(run, kinds)


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def pack(payload: bytes) -> bytes:
    """Bytes, a multiple of 64, as the 8-bit samples of a grey GIF; each further frame holds the next 64 KiB."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    parts = [samples[i : i + ROWS] for i in range(0, len(samples), ROWS)]
    return write_gif(Gif(ROW, min(len(samples), ROWS), [Frame(p, GREY, delay_ms=100) for p in parts]))


def unpack(gif: Gif) -> bytes:
    return b"".join(f.palette[:, 0][f.pixels].tobytes() for f in gif.frames)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text -> doc_id, n_bytes, payload_bytes, media: the UTF-8 text, zero-padded to a positive multiple of 64, as a GIF.

    Null is the empty text; a long text has as many frames as it needs; rows are independent, so null
    and repeated ids, ties and repeated rows give a row each; an empty table gives an empty table; other
    columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "text", FLUSH):
                padded = [t + bytes(-len(t) % ROW if t else ROW) for t in texts]
                columns = (pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, padded)), pa.int64()), pa.array(list(map(pack, padded)), pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_bytes", "payload_bytes", "media"])
        tidy()

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("payload_bytes"), F.lit(b"").alias("media")).schema
    return docs.select("doc_id", "text").mapInArrow(run, schema)


TIMED = "array<struct<frame: int, delay_ms: int, disposal: int, transparent: int, histogram: array<bigint>>>"


def read_back(media: DataFrame) -> DataFrame:
    """What store_texts wrote -> digests of the payload that the stored files hold, their timed frames with colour histograms, and a feature string of these.

    Files are read by bytes, not by rows; nulls, ties and repeated rows as in ``store_texts``.
    """
    shape = pa.list_(pa.struct([("frame", pa.int32()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("histogram", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), shape)
        for whole in batches:
            for batch, files in slices(whole, "media", FLUSH // 4):
                out = []
                for data, gif in zip(files, read_gifs(files), strict=True):
                    payload = unpack(gif)
                    timed = [{"frame": k, "delay_ms": f.delay_ms, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(canvas)} for k, (f, canvas) in enumerate(zip(gif.frames, compose(gif), strict=True))]
                    colours = sum((t["histogram"] for t in timed), np.zeros(3 * BINS, np.int64))
                    feature = f"frames={len(timed)};ms={sum(t['delay_ms'] for t in timed)};rgb={','.join(map(str, colours.tolist()))}"
                    out.append((hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, timed))
                columns = (pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)
        tidy()

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    kinds = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {TIMED}"
    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(run, f"doc_id {dict(media.dtypes)['doc_id']}, {kinds}")


def op1(spark, sf_dir: str) -> DataFrame:
    """One row per document: its text stored as a GIF and read back, digests, and its timed frames."""
    return read_back(stored(store_texts(table(spark, sf_dir, "documents"))))
