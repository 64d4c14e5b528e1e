import struct
import zlib

import numpy as np
import pytest

from paperloom.sources import images as im

KINDS = [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 2), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)]


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def filtered(rows, step, kind):
    """Rows of bytes under one filter, written out by its definition."""
    out, above = b"", [0] * len(rows[0]) if rows else []
    for y, row in enumerate(rows):
        f = kind if kind < 5 else y % 5
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, best)[f]) % 256)
        out += bytes([f, *line])
        above = row
    return out


def png(samples, colour, depth, kind=5, palette=None, laced=False):
    """samples: height x width x channels of values below 2 ** depth."""
    h, w, channels = samples.shape

    def rows_of(part):
        bits = np.unpackbits(part.astype(">u2").view(np.uint8).reshape(*part.shape, 2), axis=-1)[..., 16 - depth :].reshape(part.shape[0], -1)
        return np.packbits(bits, axis=1).tolist()

    passes = [(0, 0, 1, 1)] if not laced else [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
    data = b"".join(filtered(rows_of(p), max(1, channels * depth // 8), kind) for y, x, dy, dx in passes if (p := samples[y::dy, x::dx]).size)
    packed = zlib.compress(data)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced)) + (chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b"") + chunk(b"tEXt", b"x\0y") + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")


def picture(seed, h, w, colour, depth):
    r = np.random.default_rng(seed)
    palette = r.integers(0, 256, (1 << depth, 3)) if colour == 3 else None
    samples = r.integers(0, 1 << depth, (h, w, im._CHANNELS[colour]))
    top = (1 << depth) - 1
    eight = samples >> 8 if depth == 16 else samples * 255 // top
    rgb = palette[samples[..., 0]] if colour == 3 else eight[..., :3] if colour in (2, 6) else np.repeat(eight[..., :1], 3, axis=2)
    return samples, palette, rgb


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("colour, depth", KINDS)
def test_png_of_every_kind(colour, depth, laced):
    for seed, (h, w) in enumerate([(1, 1), (3, 5), (9, 17), (16, 2)]):
        samples, palette, rgb = picture(seed, h, w, colour, depth)
        for kind in range(6):
            assert (im.decode_png(png(samples, colour, depth, kind, palette, laced)) == rgb).all()


def decode_jpeg(data):
    """A plain decoder of baseline files without subsampling, by the standard's procedures."""
    at, quant, huff, shape = 2, {}, {}, None
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif marker == 0xC0:
            shape = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            code, k, table = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            assert k == len(body) and not any(c == (1 << n) - 1 for n, c in table)
            huff[body[0]] = table
        elif marker == 0xDA:
            break
    bits = iter("".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff")))

    def take(n):
        return int("".join(next(bits) for _ in range(n)) or "0", 2)

    def symbol(table):
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError

    def value(n):
        v = take(n)
        return v if n == 0 or v >= 1 << (n - 1) else v - (1 << n) + 1

    h, w = shape
    rows, columns, before = -(-h // 8), -(-w // 8), [0, 0, 0]
    planes = np.zeros((3, rows * 8, columns * 8))
    for place in range(rows * columns):
        for c in range(3):
            t, z = int(c > 0), np.zeros(64)
            before[c] += value(symbol(huff[t]))
            z[0], k = before[c], 1
            while k < 64:
                s = symbol(huff[0x10 + t])
                if s == 0:
                    break
                k += s >> 4
                z[k] = value(s & 15)
                k += 1
            block = np.zeros(64)
            block[im.ZIGZAG] = z * quant[t]
            y, x = place // columns * 8, place % columns * 8
            planes[c, y : y + 8, x : x + 8] = im._DCT.T @ block.reshape(8, 8) @ im._DCT
    y, cb, cr = planes[:, :h, :w]
    y = y + 128
    return np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x * 3 + y * 2) % 256 * 0 + 60 + x], axis=2).clip(0, 255).astype(np.uint8)


def test_zigzag():
    assert im.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(im.ZIGZAG) == list(range(64)) and im.ZIGZAG[-3:].tolist() == [55, 62, 63]


@pytest.mark.parametrize("h, w", [(1, 1), (8, 8), (17, 30), (40, 9)])
def test_jpeg_round_trip(h, w):
    for rgb, worst, mean in ((smooth(h, w), 24, 4), (np.full((h, w, 3), 200, np.uint8), 2, 2), (np.zeros((h, w, 3), np.uint8), 2, 2)):
        error = np.abs(decode_jpeg(im.encode_jpeg(rgb)) - rgb)
        assert error.max() <= worst and error.mean() <= mean
    noise = np.random.default_rng(1).integers(0, 256, (h, w, 3)).astype(np.uint8)
    for quality, mean in ((100, 1.0), (95, 6), (10, 80)):
        assert np.abs(decode_jpeg(im.encode_jpeg(noise, quality)) - noise).mean() <= mean


def test_long_runs_and_long_codes():
    """Single waves of high frequency leave runs of zeros of more than sixteen; skewed counts need codes cut to 16 bits."""
    block = np.zeros((64,))
    block[63] = 900
    rgb = np.repeat(np.clip(128 + im._DCT.T @ block.reshape(8, 8) @ im._DCT, 0, 255)[:, :, None], 3, axis=2).astype(np.uint8)
    assert np.abs(decode_jpeg(im.encode_jpeg(np.tile(rgb, (3, 2, 1)), 90)) - np.tile(rgb, (3, 2, 1))).mean() < 8
    lengths = im._code_lengths({s: 2**s for s in range(30)})
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) <= 1 and lengths[256] == 16


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", png(np.zeros((4, 4, 1)), 0, 8)[:60], png(np.zeros((4, 4, 1)), 0, 8).replace(b"IDAT", b"IDAX"), png(np.full((2, 2, 1), 3), 3, 2, palette=np.zeros((2, 3)))])
def test_broken_images(data):
    with pytest.raises(im.NotAnImage):
        im.to_jpeg(data)


def test_table(spark):
    rgb = smooth(12, 20)
    good, jpeg = png(rgb, 2, 8), im.encode_jpeg(rgb)
    rows = [(1, good), (2, jpeg), (3, b"II*\0tiff"), (4, None), (5, png(np.zeros((300, 300, 1)), 0, 1))]
    df = spark.createDataFrame(rows, "k int, content binary")
    got = {r.k: (None if r.jpeg is None else bytes(r.jpeg), r.error) for r in im.jpeg_table(df, "k").collect()}
    assert got[1] == got[2] == (jpeg, None) and got[3] == (None, "not a PNG") and got[4] == (None, "no content") and got[5][1] is None
    other = {r.k: r.jpeg for r in im.jpeg_table(df, "k", other=lambda: lambda d: b"made").collect()}
    assert bytes(other[3]) == b"made"
    with pytest.raises(im.NotAnImage, match="pixels"):
        im.decode_png(good, max_pixels=100)


def test_pages_become_images_in_small_batches(spark, sf_dir):
    """No batch of ten thousand images is held: they leave the making task every few megabytes."""
    from paperloom.plans import query_documents

    made = query_documents.page_images(spark, sf_dir)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    for r in made.join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect():
        assert bytes(r.content) == r.html.encode() if r.page_id % 5 == 4 else im.decode_png(bytes(r.content))[..., 0].tobytes().rstrip(b"\0") == r.html.encode()
