import hashlib
import io
import wave

import numpy as np

from quillmark.llm import audio as A

TEXTS = [None, "", "a", "x" * 64, "y" * 65, "é" * 1000, "ab" * 40_000]


def test_round_trip_and_features(spark):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS + TEXTS[-1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, payload string")
    found = A.audio_features(A.encode_media(docs, keep=["doc_id"])).collect()
    for r in found:
        data = (rows[r.doc_id][1] or "").encode()
        payload = bytes(r.payload)
        assert payload[: len(data)] == data and len(payload) % 64 == 0 and len(payload) >= 64 and not any(payload[len(data) :])
        assert len(payload) - len(data) < 64 or not data
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert (f.getsampwidth(), f.getnchannels(), f.getframerate()) == (1, 1, A.RATE) and f.readframes(10**9) == payload
        values, spans = A.read_tensors(bytes(r.tensors))
        assert values.shape == (r.n_tensors, A.FRAMES, A.BANDS) and len(spans) == r.n_tensors
        assert r.tensors_sha256 == hashlib.sha256(values.tobytes() + np.array(spans).tobytes()).hexdigest()
        assert all(0 <= a < b <= len(payload) / A.RATE + 1e-9 for a, b in [*spans, *((s.start, s.end) for s in r.segments)])
        x = A.resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
        mel = A.log_mel(x)
        assert np.array_equal(values.reshape(-1, A.BANDS)[: len(mel)], mel) and not values.reshape(-1, A.BANDS)[len(mel) :].any()
        assert np.isfinite(r.pooled).all() and len(r.pooled) == 2 * A.BANDS
    a, b = (next(r for r in found if r.doc_id == i) for i in (len(TEXTS) - 1, len(TEXTS)))
    assert a[1:] == b[1:]
    assert A.encode_media(docs.limit(0)).count() == 0 and A.audio_features(A.encode_media(docs.limit(0))).count() == 0


def test_resampling_against_the_definition():
    x = np.random.default_rng(1).normal(size=517).astype(np.float32)
    y = A.resample(x)
    up = np.zeros(len(x) * A.UP + A.UP * A.TAPS)
    up[: len(x) * A.UP : A.UP] = x
    taps = A._PHASES.T.ravel()
    want = [sum(taps[k] * up[n * A.DOWN - k] for k in range(len(taps)) if 0 <= n * A.DOWN - k) for n in range(len(y))]
    assert len(y) == -(-len(x) * A.UP // A.DOWN) and np.allclose(y, want, atol=1e-5)
    tone = A.resample(np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000).astype(np.float32))
    assert abs(np.argmax(np.abs(np.fft.rfft(tone))) * 6000 / len(tone) - 440) < 2


def test_segments_need_the_high_threshold():
    energy = np.zeros(100)
    energy[20:30], energy[25], energy[60:65] = 2.0, 6.0, 1.0
    assert A.segments(energy) == [(20, 30)]
    assert A.segments(np.ones(5)) == []


def test_stored_tensors_are_arrows_fixed_shape_ones(spark):
    import pyarrow as pa

    docs = spark.createDataFrame([(1, "ab" * 20_000), (2, "c"), (3, None)], "doc_id long, text string")
    for r in A.audio_features(A.encode_media(docs)).collect():
        with pa.ipc.open_stream(bytes(r.tensors)) as reader:
            assert reader.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float32(), (A.FRAMES, A.BANDS))
            assert reader.schema.names == ["tensor", "start", "end"] and reader.read_next_batch().num_rows == r.n_tensors >= 1


def test_log_mel_against_the_definition():
    x = np.random.default_rng(2).normal(size=700)
    rate = A.RATE * A.UP / A.DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(mel(rate / 2) * i / (A.BANDS + 1)) for i in range(A.BANDS + 2)]
    frames = 1 + -(-(len(x) - A.FRAME) // A.HOP)
    padded = np.concatenate([x, np.zeros(frames * A.HOP + A.FRAME)])
    got = A.log_mel(x.astype(np.float32))
    assert got.shape == (frames, A.BANDS)
    for i in range(frames):
        n = np.arange(A.FRAME)
        frame = padded[i * A.HOP : i * A.HOP + A.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * n / (A.FRAME - 1)))
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * n / A.FRAME))) ** 2 for k in range(A.FRAME // 2 + 1)]
        for b in range(A.BANDS):
            low, top, high = edges[b : b + 3]
            total = 0.0
            for k, p in enumerate(power):
                f = k * rate / A.FRAME
                total += p * max(0.0, min((f - low) / (top - low), (high - f) / (high - top)))
            assert abs(got[i, b] - np.log(total + 1e-6)) < 1e-3


def test_segments_against_a_walk():
    rng = np.random.default_rng(3)
    for _ in range(60):
        energy = np.repeat(rng.normal(size=30), rng.integers(1, 4, 30))
        low, high = (energy.mean() + k * energy.std() for k in (A.LOW, A.HIGH))
        want, start, reached = [], None, False
        for i, e in enumerate([*energy, -np.inf]):
            if e > low:
                start, reached = (i if start is None else start), reached or e > high
            else:
                want += [(start, i)] if reached else []
                start, reached = None, False
        assert A.segments(energy) == want
