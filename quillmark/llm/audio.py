"""Media columns: audio as WAV bytes, and features as fixed-shape tensors with time spans.

Samples are 8-bit PCM. Tensors are stored as Arrow's fixed-shape tensors with their time spans, an
IPC stream a document. Features: polyphase resampling by UP / DOWN, log energies
of a mel filterbank over overlapping Hann windows, in tensors of
(FRAMES, BANDS), and segments of energy by hysteresis. Every step is a
function of one document's samples alone, in a fixed order, so equal media have equal values.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave

import numpy as np
from pyspark.sql import DataFrame

from quillmark.llm.shared import map_texts

RATE = 8000
UP, DOWN = 3, 4
TAPS = 12  # of each phase
FRAME, HOP, BANDS = 256, 128, 20
FRAMES = 32  # of a tensor
BLOCK = 64  # a payload's length is a multiple of this
#: A segment begins over mean + HIGH deviations of the log energy and lasts until under mean + LOW.
HIGH, LOW = 1.0, 0.25

FIELDS = "payload binary, tensors binary, n_tensors int, tensors_sha256 string, segments array<struct<start: double, end: double>>, pooled array<float>"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text and zeros up to a positive multiple of BLOCK."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of unsigned 8-bit mono PCM."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + bytes(len(samples) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, read by the standard library's reader."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono is expected")
        return f.readframes(f.getnframes()), f.getframerate()


def _prototype() -> np.ndarray:
    """(UP, TAPS): a Hann-windowed sinc at the lower of the two rates' limits, by phase."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cutoff = min(1 / UP, 1 / DOWN)
    taps = cutoff * np.sinc(cutoff * t) * np.hanning(n + 2)[1:-1]
    return (taps * UP / taps.sum()).reshape(TAPS, UP).T.astype(np.float32)


def _filterbank(rate: float) -> np.ndarray:
    """(FRAME // 2 + 1, BANDS) triangles, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_PHASES, _BANK, _HANN = _prototype(), _filterbank(RATE * UP / DOWN), np.hanning(FRAME).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP / DOWN of its rate: output n is phase n * DOWN % UP over the inputs that end at n * DOWN // UP."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN, np.float32)])
    out = np.zeros(n, np.float32)
    for first in range(min(UP, n)):
        phase, at = first * DOWN % UP, first * DOWN // UP
        count = len(range(first, n, UP))
        sums = np.zeros(count, np.float32)
        for k in range(TAPS):
            start = at + TAPS - 1 - k
            sums += _PHASES[phase, k] * padded[start : start + (count - 1) * DOWN + 1 : DOWN]
        out[first::UP] = sums
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, BANDS): natural logs; the last frame is padded with zeros."""
    frames = 1 + max(0, -(-(len(x) - FRAME) // HOP))
    padded = np.zeros((frames - 1) * HOP + FRAME, np.float32)
    padded[: len(x)] = x
    out = np.empty((frames, BANDS), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    for i in range(0, frames, 4096):  # bounds the memory of long media
        spectrum = np.fft.rfft(view[i : i + 4096] * _HANN, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out[i : i + 4096] = np.log(power @ _BANK + np.float32(1e-6))
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames over the low threshold that reach the high one, as (first, end)."""
    mean, deviation = float(energy.mean()), float(energy.std())
    over = np.concatenate([[False], energy > mean + LOW * deviation, [False]])
    edges = np.flatnonzero(over[1:] != over[:-1])
    if not len(edges):
        return []
    starts, ends = edges[::2], edges[1::2]
    reach = np.maximum.reduceat(np.append(energy, -np.inf), np.stack([starts, ends], 1).ravel())[::2]
    return [(int(a), int(b)) for a, b, r in zip(starts, ends, reach, strict=True) if r > mean + HIGH * deviation]


def store_tensors(tensors: np.ndarray, spans: list[tuple[float, float]]) -> bytes:
    """An Arrow IPC stream of one batch: ``tensor`` (fixed-shape, (FRAMES, BANDS) of float32), ``start`` and ``end`` in seconds."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(tensors.ravel(), pa.float32()), FRAMES * BANDS)
    starts, ends = (pa.array([s[k] for s in spans], pa.float64()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat), starts, ends], names=["tensor", "start", "end"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The (n, FRAMES, BANDS) values and the spans of ``store_tensors``."""
    import pyarrow as pa

    with pa.ipc.open_stream(stored) as reader:
        batch = reader.read_next_batch()
    spans = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
    return batch.column(0).to_numpy_ndarray(), spans


def features(media: bytes) -> tuple[bytes, bytes, int, str, list, np.ndarray]:
    """(payload, stored tensors, their number, sha-256 of values and spans read back, segments, pooled) of the stored bytes; times in seconds."""
    payload, rate = from_wav(media)
    mel = log_mel(resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
    step, width, end = HOP * DOWN / UP / rate, FRAME * DOWN / UP / rate, len(payload) / rate
    until = lambda frame: min(end, (frame - 1) * step + width)  # noqa: E731  the end of the frame before
    count = -(-len(mel) // FRAMES)
    tensors = np.zeros((count * FRAMES, BANDS), np.float32)
    tensors[: len(mel)] = mel
    spans = [(i * FRAMES * step, until(min(len(mel), (i + 1) * FRAMES))) for i in range(count)]
    stored = store_tensors(tensors, spans)
    values, times = read_tensors(stored)
    digest = hashlib.sha256(np.ascontiguousarray(values, "<f4").tobytes() + np.array(times, "<f8").tobytes()).hexdigest()
    found = [(a * step, until(b)) for a, b in segments(mel.mean(axis=1))]
    return payload, stored, len(values), digest, found, np.concatenate([mel.mean(axis=0), mel.std(axis=0)])


def encode_media(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``media``: each text's payload as a WAV file, without loss.

    A null or empty text gives one block of zeros. Repeated rows give equal media.
    """
    return map_texts(docs, lambda: lambda texts: [[to_wav(payload_of(t)) for t in texts]], "media binary", text=text, keep=keep)


def audio_features(docs: DataFrame, *, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the payload read back and its features (see FIELDS), from a column of WAV bytes.

    ``tensors`` holds what ``store_tensors`` makes, the last tensor padded with zeros;
    ``read_tensors`` gives them back, and tensors_sha256 is of what was read back.
    Null media give nulls. Columns named like the results are replaced.
    """

    def work():
        def do(values):
            rows = [features(v) if v is not None else (None,) * 6 for v in values]
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(6)]
            columns[4] = [None if c is None else [{"start": a, "end": b} for a, b in c] for c in columns[4]]
            return columns

        return do

    return map_texts(docs, work, FIELDS, text=media, keep=keep, kind="binary")
