"""Recordings from bytes: PCM containers decoded, silences found by windowed level, chunks cut out as containers again.

A millisecond begins a quiet window if the root mean square of the `window_ms` from it on is at most
`threshold_db` below full scale. Quiet windows that overlap or touch are one silence. Levels come from prefix
sums of squares, so work is linear in the recording, whatever the window.

Cases: bytes that are no PCM container, or a broken one, are a row with an error, never an exception. A last frame
that is cut short is dropped. A recording without frames lasts 0 ms and has no silence; one shorter than
the window has none either. A row is one recording, a file of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import chunk_name
from paperloom.operators import chunks

WINDOW_MS, THRESHOLD_DB = 750, -40.0
_PCM, _EXTENSIBLE = 1, 0xFFFE
SILENCES = "array<struct<start_ms:bigint,end_ms:bigint>>"


class NotSound(ValueError):
    pass


@dataclass
class Sound:
    rate: int
    width: int  # bytes of a sample
    samples: np.ndarray  # frames x channels, integers of full scale 2 ** (8 * width - 1)

    @property
    def duration_ms(self) -> int:
        return round(1000 * len(self.samples) / self.rate)

    def frame(self, ms: int) -> int:
        return min(len(self.samples), int(self.rate * ms / 1000))


def decode(data: bytes) -> Sound:
    """A RIFF container with integer samples of 1 to 4 bytes."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise NotSound("not a RIFF container")
    at, form, body = 12, None, None
    while at + 8 <= len(data) and body is None:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            form = data[at + 8 : at + 8 + size]
        elif name == b"data":
            body = memoryview(data)[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or len(form) < 16 or body is None:
        raise NotSound("no format or no samples")
    kind, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", form)
    if kind == _EXTENSIBLE and len(form) >= 26:
        kind = struct.unpack_from("<H", form, 24)[0]
    width = bits // 8
    if kind != _PCM or width not in (1, 2, 3, 4) or not channels or not rate or align != width * channels:
        raise NotSound("not integer samples")
    n = len(body) // align
    raw = np.frombuffer(body, dtype=np.uint8, count=n * align).reshape(n, channels, width)
    if width == 1:
        samples = raw[:, :, 0].astype(np.int64) - 128
    else:
        top = raw[:, :, -1].astype(np.int8).astype(np.int64) << (8 * (width - 1))
        samples = top + sum(raw[:, :, k].astype(np.int64) << (8 * k) for k in range(width - 1))
    return Sound(rate, width, samples)


def encode(sound: Sound, low: int = 0, high: int | None = None) -> bytes:
    """Frames `low` to `high` as a container."""
    part = sound.samples[low:high]
    n, channels, width = len(part), sound.samples.shape[1], sound.width
    values = part + 128 if width == 1 else part
    raw = np.ascontiguousarray(values.astype("<i8")).view(np.uint8).reshape(n, channels, 8)[:, :, :width].tobytes()
    form = struct.pack("<HHIIHH", _PCM, channels, sound.rate, sound.rate * channels * width, channels * width, 8 * width)
    body = raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(raw)) + body


def silences(sound: Sound, window_ms: int = WINDOW_MS, threshold_db: float = THRESHOLD_DB) -> list[tuple[int, int]]:
    """(start_ms, end_ms) of the silences, in order."""
    starts = np.arange(sound.duration_ms - window_ms + 1, dtype=np.int64)
    if not len(starts) or window_ms <= 0:
        return []
    power = np.concatenate(([0], np.cumsum((sound.samples.astype(np.float64) ** 2).sum(axis=1))))
    low = np.minimum(starts * sound.rate // 1000, len(sound.samples))
    high = np.minimum((starts + window_ms) * sound.rate // 1000, len(sound.samples))
    n = np.maximum(high - low, 1) * sound.samples.shape[1]
    limit = 10 ** (threshold_db / 20) * 2 ** (8 * sound.width - 1)
    quiet = starts[np.sqrt((power[high] - power[low]) / n) <= limit * (1 + 1e-12)]
    if not len(quiet):
        return []
    breaks = np.flatnonzero(np.diff(quiet) > window_ms)
    first, last = quiet[np.append(0, breaks + 1)], quiet[np.append(breaks, len(quiet) - 1)]
    return list(zip(first.tolist(), (last + window_ms).tolist()))


def _measured(files: DataFrame, key: str, content: str, window_ms: int, threshold_db: float) -> DataFrame:
    """key, content, duration_ms, silences, error; a recording at a time leaves the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list_of = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
        for batch in batches:
            for k in range(batch.num_rows):
                duration, found, error = None, None, None
                try:
                    data = batch.column(1)[k].as_py()
                    if data is None:
                        raise NotSound("no content")
                    sound = decode(data)
                    found = [{"start_ms": a, "end_ms": b} for a, b in silences(sound, window_ms, threshold_db)]
                    duration = sound.duration_ms
                except (NotSound, struct.error) as e:
                    error = str(e)
                one = [*(c.slice(k, 1) for c in batch.columns), pa.array([duration], pa.int64()), pa.array([found], list_of), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(one, names=[key, "content", "duration_ms", "silences", "error"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, F.col(content).alias("content")).mapInArrow(run, f"`{key}` {kind}, content binary, duration_ms bigint, silences {SILENCES}, error string")


def _intervals(found: DataFrame, min_ms: int, max_ms: int) -> DataFrame:
    """Readable recordings with `plan`: chunk_id, start_ms, end_ms, name of each chunk."""
    duration, c = F.col("duration_ms"), ("chunk_id", "start_ms", "end_ms")
    cut = found.where("error IS NULL").withColumn("cuts", chunks.cut_points(duration, F.col("silences"), min_ms, max_ms))
    named = F.transform(chunks.chunk_intervals(duration, F.col("cuts"), max_ms), lambda x: F.struct(*(x[n].alias(n) for n in c), chunk_name(x["chunk_id"]).alias("name")))
    return cut.withColumn("plan", named)


def sound_table(files: DataFrame, key: str, content: str = "content", window_ms: int = WINDOW_MS, threshold_db: float = THRESHOLD_DB) -> DataFrame:
    """key, duration_ms, silences, error of every recording."""
    return _measured(files, key, content, window_ms, threshold_db).select(key, "duration_ms", "silences", "error")


def chunk_plan(files: DataFrame, key: str, min_ms: int, max_ms: int, content: str = "content", window_ms: int = WINDOW_MS, threshold_db: float = THRESHOLD_DB) -> DataFrame:
    """key, chunk_id, start_ms, end_ms, name from the bytes alone: decode, silences, cut points, intervals. Recordings that cannot be read have no chunks."""
    return _intervals(sound_table(files, key, content, window_ms, threshold_db), min_ms, max_ms).select(key, F.inline("plan"))


def cut_chunks(files: DataFrame, key: str, min_ms: int, max_ms: int, content: str = "content", window_ms: int = WINDOW_MS, threshold_db: float = THRESHOLD_DB) -> DataFrame:
    """key, chunk_id, start_ms, end_ms, name, content: each chunk as a container of its own. A recording stays in its row from bytes to plan to chunks; nothing is shuffled."""
    planned = _intervals(_measured(files, key, content, window_ms, threshold_db), min_ms, max_ms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sound = decode(batch.column(1)[k].as_py())
                for chunk in batch.column(2)[k].as_py():  # a chunk at a time leaves the task
                    data = encode(sound, sound.frame(chunk["start_ms"]), sound.frame(chunk["end_ms"]))
                    one = [batch.column(0).slice(k, 1), *(pa.array([chunk[c]], pa.int64()) for c in ("chunk_id", "start_ms", "end_ms")), pa.array([chunk["name"]]), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(one, names=[key, "chunk_id", "start_ms", "end_ms", "name", "content"])

    kind = files.schema[key].dataType.simpleString()
    return planned.select(key, "content", "plan").mapInArrow(run, f"`{key}` {kind}, chunk_id bigint, start_ms bigint, end_ms bigint, name string, content binary")


def tone(segments: list[tuple[int, bool]], rate: int = 8000, level: float = 0.5) -> Sound:
    """A recording of (milliseconds, loud) stretches, one byte a sample: a square wave, or nothing. For tests and examples."""
    parts = [np.full(rate * ms // 1000, int(127 * level) if loud else 0, dtype=np.int64) for ms, loud in segments]
    whole = np.concatenate(parts) if parts else np.empty(0, np.int64)
    whole[1::2] *= -1
    return Sound(rate, 1, whole.reshape(-1, 1))

