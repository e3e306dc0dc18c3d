"""GIF: exact round trips, frames by the rules, stored texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import gif as X

RGB = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)


@pytest.mark.parametrize("size", [2, 3, 5, 8])
def test_code_streams(size):
    rng = random.Random(size)
    for data in (b"", b"\0", b"\1" * 70_000, b"\0\1" * 9_000, bytes(rng.randrange(1 << size) for _ in range(30_000))):
        assert X.lzw_decode([X.lzw_encode(data, size)], [size])[0].tobytes() == data


def test_a_full_table_without_clear_code():
    """Codes may go on at 12 bits when the table is full and no clear code comes."""
    data = bytes(random.Random(3).randrange(256) for _ in range(6000))
    known, free, prefix, codes = {}, 258, data[0], []
    for byte in data[1:]:
        code = known.get(prefix << 8 | byte)
        if code is None:
            codes.append(prefix)
            if free < 4096:
                known[prefix << 8 | byte] = free
                free += 1
            prefix = byte
        else:
            prefix = code
    codes += [prefix, 257]
    bits, count = 256, 9
    for k, c in enumerate(codes):
        entries = 258 + max(0, k - 1)
        bits |= c << count
        count += min(12, max(9, entries.bit_length()))
    stream = bits.to_bytes((count + 7) // 8, "little")
    assert X.lzw_decode([stream], [8])[0].tobytes() == data


def test_broken_streams():
    with pytest.raises(ValueError):
        X.lzw_decode([(256 | 300 << 9).to_bytes(4, "little")], [8])
    for bad in (b"", b"GIF89a", b"PNG" * 10):
        with pytest.raises((ValueError, IndexError)):
            X.read_gifs([bad])


def test_frames_palettes_disposal_and_transparency():
    full = np.ones((4, 4), np.uint8)
    spot = np.array([[2, 0], [0, 2]], np.uint8)
    made = X.Gif(4, 4, [X.Frame(full, RGB, delay_ms=50), X.Frame(spot, RGB, 1, 1, 100, disposal=2, transparent=0), X.Frame(spot, RGB[::-1], 2, 2, 30, disposal=3), X.Frame(spot[:1, :1], RGB, 0, 0, 10)])
    back = X.read_gifs([X.write_gif(made)])[0]
    assert [(f.left, f.top, f.delay_ms, f.disposal, f.transparent) for f in back.frames] == [(0, 0, 50, 0, None), (1, 1, 100, 2, 0), (2, 2, 30, 3, None), (0, 0, 10, 0, None)]
    a, b, c, d = (x.copy() for x in X.compose(back))
    assert (a == [255, 0, 0, 255]).all()
    assert b[1, 1].tolist() == [0, 255, 0, 255] and b[1, 2].tolist() == [255, 0, 0, 255]  # transparent keeps what is below
    assert c[1, 1, 3] == 0 and c[0, 0].tolist() == [255, 0, 0, 255]  # back to the background
    assert c[2, 3].tolist() == [0, 0, 255, 255] and c[2, 2].tolist() == [255, 0, 0, 255]  # its own palette
    assert d[2, 3].tolist() == [255, 0, 0, 255] and d[0, 0].tolist() == [0, 255, 0, 255]  # back to what was before
    assert X.histogram(c).sum() == 3 * (c[..., 3] > 0).sum()


def test_interlaced():
    pixels = np.arange(13 * 3, dtype=np.uint8).reshape(13, 3) % 4
    back = X.read_gifs([X.write_gif(X.Gif(3, 13, [X.Frame(pixels, RGB, interlaced=True)]))])[0]
    assert (back.frames[0].pixels == pixels).all()


def test_frames_table(spark):
    good = X.write_gif(X.Gif(2, 2, [X.Frame(np.ones((2, 2), np.uint8), RGB, delay_ms=k * 10) for k in range(3)]))
    rows = spark.createDataFrame([(1, good, "x"), (2, None, "y"), (3, b"no gif", "z"), (1, good, "x")], "doc_id long, media binary, width_note string")
    got = sorted(X.frames(rows).collect(), key=lambda r: (r.doc_id, r.frame or 0))
    assert [(r.doc_id, r.frame, r.delay_ms) for r in got] == [(1, 0, 0), (1, 0, 0), (1, 1, 10), (1, 1, 10), (1, 2, 20), (1, 2, 20), (2, None, None), (3, None, None)]
    assert got[0].histogram[7] == 4 and len(got[0].rgba) == 16
    assert X.frames(rows.limit(0)).isEmpty()


def test_stored_texts(spark):
    texts = [None, "", "a", "é" * 500, "long " * 40_000, "a"]
    docs = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in X.read_back(X.store_texts(docs)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[2].media_sha256 == got[5].media_sha256 and got[4].feature.startswith("frames=4;")
    assert X.read_back(X.store_texts(docs.limit(0))).isEmpty()


def plain_gif(data):
    """Grey samples of all frames, and the delays, read byte by byte and code by code."""
    assert data[:6] == b"GIF89a"
    at, palette = 13, None
    if data[10] & 0x80:
        palette = data[13 : 13 + 3 * (2 << (data[10] & 7))]
        at += len(palette)
    samples, delays = b"", []
    while data[at] != 0x3B:
        kind, at = data[at], at + 1
        own = palette
        if kind == 0x2C:
            flags, at = data[at + 8], at + 9
            if flags & 0x80:
                own = data[at : at + 3 * (2 << (flags & 7))]
                at += len(own)
            size, at = data[at], at + 1
        else:
            label, at = data[at], at + 1
        body = b""
        while data[at]:
            body += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        if kind == 0x21:
            if label == 0xF9:
                delays.append(10 * int.from_bytes(body[1:3], "little"))
            continue
        bits, count, width, table, last = int.from_bytes(body, "little"), 0, size + 1, {}, None
        out = bytearray()
        while True:
            code = bits >> count & (1 << width) - 1
            count += width
            if code == 1 << size:
                table, last, width = {k: bytes([k]) for k in range(1 << size)} | {1 << size: b"", (1 << size) + 1: b""}, None, size + 1
                continue
            if code == (1 << size) + 1:
                break
            said = table[code] if code in table else last + last[:1]
            out += said
            if last is not None and len(table) < 4096:
                table[len(table)] = last + said[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
            last = said
        samples += bytes(own[3 * x] for x in out)
    return samples, delays


def test_stored_files_hold_for_a_plain_reader(spark):
    """Samples, sizes, digests, delays and histograms of what is stored, read another way."""
    texts = [None, "abc", "é ñ 中文 " * 300, "x" * 70_000, "".join(random.Random(2).choices("abcdefgh \n", k=9000))]
    stored = X.store_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    for r in X.read_back(stored).collect():
        samples, delays = plain_gif(files[r.doc_id])
        raw = (texts[r.doc_id] or "").encode()
        assert samples.rstrip(b"\0") == raw and len(samples) == r.payload_bytes
        assert (r.media_bytes, r.media_sha256) == (len(files[r.doc_id]), hashlib.sha256(files[r.doc_id]).hexdigest())
        assert [f.delay_ms for f in r.frames] == delays and [f.frame for f in r.frames] == list(range(len(delays)))
        canvas, total = np.frombuffer(samples[:65536], np.uint8).copy(), np.zeros(8, int)
        for k, f in enumerate(r.frames):  # a later frame is laid over the earlier ones
            own = samples[65536 * k :][:65536]
            canvas[: len(own)] = np.frombuffer(own, np.uint8)
            assert list(f.histogram) == np.bincount(canvas >> 5, minlength=8).tolist() * 3
            total += np.bincount(canvas >> 5, minlength=8)
        counts = total.tolist()
        assert r.feature == f"frames={len(delays)};ms={sum(delays)};rgb={','.join(map(str, counts * 3))}"


def test_clashing_frame_columns(spark):
    good = X.write_gif(X.Gif(2, 2, [X.Frame(np.ones((2, 2), np.uint8), RGB)]))
    got = X.frames(spark.createDataFrame([(good, "own", 5)], "media binary, Frame string, rgba int")).collect()
    assert got[0].asDict().keys() == {x.split()[0] for x in X.FRAME_COLUMNS.split(", ")} and got[0].frame == 0
