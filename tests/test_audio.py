import io
import math
import wave

import numpy as np
import pytest

from paperloom.sources import audio


def plain_silences(sound, window_ms, threshold_db):
    """Every window measured on its own, and quiet ones merged one after the other."""
    limit = 10 ** (threshold_db / 20) * 2 ** (8 * sound.width - 1)
    out = []
    for start in range(sound.duration_ms - window_ms + 1):
        part = sound.samples[start * sound.rate // 1000 : (start + window_ms) * sound.rate // 1000].reshape(-1).tolist()
        if math.sqrt(sum(x * x for x in part) / max(len(part), 1)) <= limit:
            if out and start <= out[-1][1]:
                out[-1][1] = start + window_ms
            else:
                out.append([start, start + window_ms])
    return [tuple(x) for x in out]


def noise(seed, rate=1000, width=2, channels=2, ms=1500):
    """Loud and quiet stretches whose levels lie around the threshold."""
    r = np.random.default_rng(seed)
    top = 2 ** (8 * width - 1)
    levels = np.repeat(r.choice([0, 0.004, 0.0099, 0.0101, 0.02, 0.5], 15), rate * ms // 15_000)
    return audio.Sound(rate, width, (r.uniform(-1, 1, (len(levels), channels)) * levels[:, None] * top).astype(np.int64))


@pytest.mark.parametrize("seed", range(6))
def test_silences_against_a_plain_loop(seed):
    found = 0
    for rate, width, channels in ((1000, 2, 2), (800, 1, 1), (1100, 3, 1), (500, 4, 3)):
        sound = noise(seed, rate, width, channels)
        for window in (1, 30, 200):
            for threshold in (-40, -30, -200):
                expected = plain_silences(sound, window, threshold)
                assert audio.silences(sound, window, threshold) == expected
                found += len(expected)
    assert found > 20


def test_silences_of_pauses():
    sound = audio.tone([(1000, True), (750, False), (5, True), (749, False), (20, True), (900, False), (10, True), (2000, False)])
    assert audio.silences(sound) == [(1000, 1750), (2524, 3424), (3434, 5434)]
    assert audio.silences(audio.tone([(749, False)])) == [] and audio.silences(audio.tone([])) == []
    assert audio.silences(audio.tone([(750, False)])) == [(0, 750)]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_containers_round_trip(width, channels):
    r = np.random.default_rng(width)
    top = 2 ** (8 * width - 1)
    sound = audio.Sound(11_025, width, r.integers(-top, top, (777, channels)))
    data = audio.encode(sound)
    again = audio.decode(data)
    assert (again.rate, again.width) == (11_025, width) and (again.samples == sound.samples).all()
    assert (audio.decode(audio.encode(sound, 100, 301)).samples == sound.samples[100:301]).all()
    with wave.open(io.BytesIO(data)) as w:
        assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.getnframes()) == (11_025, width, channels, 777)


def test_containers_of_others():
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, 16_000, 0, "NONE", ""))
        w.writeframes(np.array([0, 1, -1, 32767, -32768], dtype="<i2").tobytes())
    data = out.getvalue()
    assert audio.decode(data).samples[:, 0].tolist() == [0, 1, -1, 32767, -32768]
    extra = data[:12] + b"LIST\x03\0\0\0abc\0" + data[12:]
    assert audio.decode(extra).samples[:, 0].tolist() == [0, 1, -1, 32767, -32768]
    assert len(audio.decode(data[:-3]).samples) == 3  # a frame that is cut short goes


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\0\0\0\0WAVE", b"ID3" + bytes(100), audio.encode(audio.tone([(10, True)]))[:30], audio.encode(audio.tone([(10, True)])).replace(b"fmt ", b"fnt "), audio.encode(audio.tone([(10, True)]))[:20] + b"\x03" + audio.encode(audio.tone([(10, True)]))[21:]])
def test_broken_containers(data):
    with pytest.raises(audio.NotSound):
        audio.decode(data)


def test_from_bytes_to_chunks(spark):
    long = audio.tone([(4000, True), (1000, False), (5000, True), (800, False), (3200, True)])
    rows = [(1, audio.encode(long)), (2, audio.encode(audio.tone([(2000, True)]))), (3, b"no sound"), (4, None), (5, audio.encode(audio.tone([])))]
    df = spark.createDataFrame(rows, "task int, content binary")
    table = {r.task: (r.duration_ms, [tuple(s) for s in r.silences or []], r.error) for r in audio.sound_table(df, "task").collect()}
    assert table == {1: (14_000, [(4000, 5000), (10_000, 10_800)], None), 2: (2000, [], None), 3: (None, [], "not a RIFF container"), 4: (None, [], "no content"), 5: (0, [], None)}
    cut = sorted((r.task, r.chunk_id, r.start_ms, r.end_ms, r.name, bytes(r.content)) for r in audio.cut_chunks(df, "task", 3000, 7000).collect())
    assert [c[:5] for c in cut] == [(1, 0, 0, 4500, "chunk_0000.wav"), (1, 1, 4500, 10_400, "chunk_0001.wav"), (1, 2, 10_400, 14_000, "chunk_0002.wav"), (2, 0, 0, 2000, "chunk_0000.wav"), (5, 0, 0, 0, "chunk_0000.wav")]
    assert (np.concatenate([audio.decode(c[5]).samples for c in cut[:3]]) == long.samples).all()


def test_sounds_leave_in_small_batches(spark, sf_dir):
    """Ten thousand small rows are one batch; the recordings made of them are not."""
    from paperloom.plans import query_media
    from paperloom.sources import files

    rows = spark.range(0, 600, 1, 1).selectExpr("id AS k", "id % 7 AS n")
    made = files.make_files(rows, ["k"], ["k", "n"], lambda k, n: bytes([n]) * 100_000, batch_bytes=1 << 20).mapInArrow(sizes, "n int, size long").collect()
    assert sum(r.n for r in made) == 600 and sum(r.size for r in made) >= 60_000_000
    plan = query_media.sounds(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan
    assert [tuple(r) for r in files.make_files(rows.where("k < 3"), ["n"], ["k"], lambda k: b"x" * k).collect()] == [(0, b""), (1, b"x"), (2, b"xx")]
    assert files.make_files(rows.where("false"), ["n"], ["k"], lambda k: b"").count() == 0


def sizes(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([pa.array([b.num_rows], pa.int32()), pa.array([b.nbytes])], names=["n", "size"])


def test_chunks_need_no_shuffle_of_contents(spark):
    """Recordings of one key stay apart, and no join brings contents and plans together."""
    df = spark.createDataFrame([(1, audio.encode(audio.tone([(2000, True)]))), (1, audio.encode(audio.tone([(3000, True)])))], "task int, content binary")
    cut = audio.cut_chunks(df, "task", 3000, 7000)
    assert sorted((r.task, r.end_ms, len(r.content)) for r in cut.collect()) == [(1, 2000, 16_044), (1, 3000, 24_044)]
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
