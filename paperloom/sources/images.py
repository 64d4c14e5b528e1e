"""Images made ready for a recognition model: PNG to RGB, and RGB to baseline JPEG, on arrays inside Arrow batches.

`to_jpeg` passes JPEG files on as they are and converts PNG files of any colour type, depth and interlacing. Alpha is
dropped, palettes are looked up, grey becomes three equal channels, 16-bit samples keep their upper byte. Types that
need other decoders (TIFF, WebP) go to a caller's function, or are errors.

Cases: broken files and missing contents are rows with an error, never exceptions. A row is one image, a file of
bounded size; `max_pixels` bounds what a small file may unpack to.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_PIXELS = 1 << 28
QUALITY = 75
#: Quantisation of luminance and chrominance at quality 50, row by row, as the JPEG standard proposes it.
_LUMA = "16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62 18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99"
_CHROMA = "17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99" + " 99" * 32
#: Channels of each PNG colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The places of an 8 x 8 block along its diagonals, to and fro.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class NotAnImage(ValueError):
    pass


def _unfiltered(data: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """Rows of samples (height x width x channels) of one PNG pass."""
    bits = width * channels * depth
    size, step = (bits + 7) // 8, max(1, channels * depth // 8)
    if len(data) < height * (size + 1):
        raise NotAnImage("too few samples")
    rows = np.frombuffer(data, dtype=np.uint8, count=height * (size + 1)).reshape(height, size + 1)
    out, above = np.zeros((height, size), dtype=np.uint8), np.zeros(size, dtype=np.uint8)
    for y in range(height):
        kind, row = rows[y, 0], rows[y, 1:]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            for c in range(step):
                out[y, c::step] = np.cumsum(row[c::step], dtype=np.uint8)
        elif kind == 2:
            out[y] = row + above
        elif kind in (3, 4):
            out[y] = _predicted(row.tolist(), above.tolist(), step, kind == 4)
        else:
            raise NotAnImage("an unknown filter")
        above = out[y]
    if depth == 16:
        return out.reshape(height, width, channels, 2)[..., 0]
    if depth == 8:
        return out.reshape(height, width, channels)
    places = np.unpackbits(out, axis=1)[:, :bits].reshape(height, width * channels, depth)
    return (places @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8).reshape(height, width, channels)


def _predicted(row: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    """Each byte plus what its neighbours to the left and above predict."""
    out = [0] * len(row)
    for x, value in enumerate(row):
        b = above[x]
        a, c = (out[x - step], above[x - step]) if x >= step else (0, 0)
        if paeth:
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        else:
            guess = (a + b) // 2
        out[x] = (value + guess) & 255
    return out


def decode_png(data: bytes, max_pixels: int = MAX_PIXELS) -> np.ndarray:
    """height x width x 3, bytes."""
    if data[:8] != _SIGNATURE:
        raise NotAnImage("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR" and len(body) == 13:
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], dtype=np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None:
        raise NotAnImage("no header")
    width, height, depth, colour, _, _, laced = head
    if colour not in _CHANNELS or depth not in (1, 2, 4, 8, 16) or not width or not height or laced > 1:
        raise NotAnImage("an unknown form")
    if width * height > max_pixels:
        raise NotAnImage(f"over {max_pixels} pixels")
    channels = _CHANNELS[colour]
    passes = [(0, 0, 1, 1)] if not laced else [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
    shapes = [(-(-(height - y) // dy), -(-(width - x) // dx)) for y, x, dy, dx in passes]
    needed = [h * ((w * channels * depth + 7) // 8 + 1) if h > 0 and w > 0 else 0 for h, w in shapes]
    plain = zlib.decompressobj().decompress(b"".join(packed), sum(needed) + 1)
    samples, low = np.zeros((height, width, channels), dtype=np.uint8), 0
    for (y, x, dy, dx), (h, w), n in zip(passes, shapes, needed):
        if n:
            samples[y::dy, x::dx] = _unfiltered(plain[low : low + n], w, h, channels, depth)
            low += n
    if colour == 3:
        if palette is None or int(samples.max()) >= len(palette):
            raise NotAnImage("a colour beyond the palette")
        return palette[samples[..., 0]]
    if depth < 8:
        samples = samples * np.uint8(255 // ((1 << depth) - 1))
    return np.repeat(samples[..., :1], 3, axis=2) if colour in (0, 4) else samples[..., :3]


def quantisers(quality: int) -> tuple[np.ndarray, np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(t.split(), dtype=np.int64) * scale + 50) // 100, 1, 255) for t in (_LUMA, _CHROMA))


def _code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of a prefix code of at most 16 bits, none of which is all ones: a symbol that never occurs takes that one."""
    counts = {s: n for s, n in counts.items() if n} | {256: 0}
    while True:
        heap = [(n, s, (s,)) for s, n in counts.items()]
        heapq.heapify(heap)
        lengths = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(lengths.values()) <= 16:
            return lengths
        counts = {s: n // 2 + (s != 256) for s, n in counts.items()}  # flatter, so shorter


def _table(counts: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A Huffman table as the file has it, and of each symbol its code and length."""
    lengths = _code_lengths(counts)
    order = sorted(lengths, key=lambda s: (lengths[s], s))  # the missing symbol is the last of the longest
    code, before, codes, sizes = 0, 0, np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        if s < 256:
            codes[s], sizes[s] = code, before
        code += 1
    real = [s for s in order if s < 256]
    return bytes(sum(lengths[s] == n for s in real) for n in range(1, 17)) + bytes(real), codes, sizes


def _bits_of(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


def _symbols(blocks: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a stream of zigzag blocks: table (0, 1 for DC; 2, 3 for AC), symbol, extra bits, and their number, in order."""
    n = len(blocks)
    dc = blocks[:, 0].copy()
    for c in range(3):
        mine = np.flatnonzero(component == c)
        dc[mine] = np.diff(blocks[mine, 0], prepend=0)
    chroma = (component > 0).astype(np.int64)
    size = _bits_of(dc)
    parts = [(np.arange(n) * 256, chroma, size, np.where(dc < 0, dc + (1 << size) - 1, dc), size)]
    row, k = np.nonzero(blocks[:, 1:])
    value = blocks[row, k + 1]
    previous = np.where(np.append(True, row[1:] != row[:-1]) if len(row) else np.empty(0, bool), -1, np.append(0, k[:-1]) if len(k) else k)
    run = k - previous - 1
    size = _bits_of(value)
    parts.append((row * 256 + 2 * k + 2, 2 + chroma[row], (run % 16) * 16 + size, np.where(value < 0, value + (1 << size) - 1, value), size))
    long = np.repeat(np.arange(len(run)), run // 16)  # sixteen zeros each, before the value they lead to
    parts.append((row[long] * 256 + 2 * k[long] + 1, 2 + chroma[row[long]], np.full(len(long), 0xF0), np.zeros(len(long), np.int64), np.zeros(len(long), np.int64)))
    last = np.full(n, -1)
    last[row] = k  # ascending, so the last one stays
    ended = np.flatnonzero(last < 62)
    parts.append((ended * 256 + 255, 2 + chroma[ended], np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64), np.zeros(len(ended), np.int64)))
    joined = [np.concatenate(x) for x in zip(*parts)]
    order = np.argsort(joined[0], kind="stable")
    return tuple(x[order] for x in joined[1:])


def _packed(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of so many bits each, one after the other; the last byte is filled with ones, and a byte of ones gets a zero behind it."""
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    bits = (np.repeat(values, sizes) >> (np.repeat(sizes, sizes) - 1 - place)) & 1
    out = np.packbits(np.concatenate((bits, np.ones(-total % 8, dtype=np.int64))).astype(np.uint8))
    return np.insert(out, np.flatnonzero(out == 255) + 1, 0).tobytes()


def encode_jpeg(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """A baseline JPEG without subsampling, its Huffman tables made for the image."""
    height, width = rgb.shape[:2]
    if not 0 < height < 65_536 or not 0 < width < 65_536:
        raise NotAnImage("a size that JPEG does not have")
    padded = np.pad(rgb.astype(np.float64), ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    r, g, b = np.moveaxis(padded, 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = np.stack([y - 128, (b - y) / 1.772, (r - y) / 1.402])
    rows, columns = planes.shape[1] // 8, planes.shape[2] // 8
    blocks = planes.reshape(3, rows, 8, columns, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 8, 8)  # Y, Cb, Cr of each place
    component = np.tile(np.arange(3), rows * columns)
    tables = quantisers(quality)
    step = np.stack([tables[0], tables[1], tables[1]])[component].reshape(-1, 8, 8)
    levels = np.rint((_DCT @ blocks @ _DCT.T) / step).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
    table, symbol, extra, size = _symbols(levels, component)
    head = [b"\xff\xd8\xff\xe0", struct.pack(">H5sHBHHBB", 16, b"JFIF\0", 0x0101, 0, 1, 1, 0, 0)]
    for k, t in enumerate(tables):
        head += [b"\xff\xdb", struct.pack(">HB", 67, k), t[ZIGZAG].astype(np.uint8).tobytes()]
    head += [b"\xff\xc0", struct.pack(">HBHHB", 17, 8, height, width, 3), bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])]
    codes, lengths = np.zeros(len(symbol), dtype=np.int64), np.zeros(len(symbol), dtype=np.int64)
    for k, name in enumerate((0x00, 0x01, 0x10, 0x11)):
        mine = table == k
        listed, code, long = _table(dict(enumerate(np.bincount(symbol[mine], minlength=256).tolist())))
        codes[mine], lengths[mine] = code[symbol[mine]], long[symbol[mine]]
        head += [b"\xff\xc4", struct.pack(">HB", 3 + len(listed), name), listed]
    head += [b"\xff\xda", struct.pack(">HB", 12, 3), bytes([1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])]
    values, sizes = np.stack([codes, extra], axis=1).reshape(-1), np.stack([lengths, size], axis=1).reshape(-1)
    return b"".join(head) + _packed(values, sizes) + b"\xff\xd9"


def to_jpeg(data: bytes, quality: int = QUALITY, max_pixels: int = MAX_PIXELS) -> bytes:
    """JPEG files as they are, PNG files converted."""
    if data[:3] == b"\xff\xd8\xff":
        return data
    try:
        return encode_jpeg(decode_png(data, max_pixels), quality)
    except (zlib.error, struct.error) as e:
        raise NotAnImage(f"broken: {e}") from e


def jpeg_table(files: DataFrame, key: str, content: str = "content", other: Callable[[], Callable[[bytes], bytes]] | None = None, quality: int = QUALITY) -> DataFrame:
    """key, jpeg, error of every image; files that are neither JPEG nor PNG go through `other`, a factory called once a task, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        convert = other() if other else None
        for batch in batches:
            for k in range(batch.num_rows):
                made, error = None, None
                try:
                    data = batch.column(1)[k].as_py()
                    if data is None:
                        raise NotAnImage("no content")
                    known = data[:8] == _SIGNATURE or data[:3] == b"\xff\xd8\xff"
                    made = to_jpeg(data, quality) if known or convert is None else convert(data)
                except Exception as e:
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([made], pa.binary()), pa.array([error], pa.string())], names=[key, "jpeg", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, jpeg binary, error string")


def rgb_table(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, width, height, rgb, error of every PNG image: three bytes a pixel, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rgb, error = None, None
                try:
                    rgb = decode_png(batch.column(1)[k].as_py() or b"")
                except (NotAnImage, zlib.error, struct.error) as e:
                    error = str(e)
                height, width = rgb.shape[:2] if rgb is not None else (None, None)
                columns = [pa.array([width], pa.int64()), pa.array([height], pa.int64()), pa.array([None if rgb is None else rgb.tobytes()], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *columns], names=[key, "width", "height", "rgb", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInArrow(run, f"`{key}` {kind}, width bigint, height bigint, rgb binary, error string")
