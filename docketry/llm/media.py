"""Media columns: payloads as WAV, with spectral-peak pair fingerprints.

A payload is stored as unsigned 8-bit mono samples by the wave module and read
back by it.  Short-time Fourier transforms give the strongest bin of each
frequency band and frame; pairs of peaks in neighbouring frames become codes
that carry their time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
FRAME, HOP = 1024, 512
#: Edges of the bands in Fourier bins; the lowest bins hold the mean and are left out.
BANDS = (4, 16, 48, 128, 512)
#: Frames ahead that a peak is paired with.
AHEAD = 3
BLOCK = 64
FRAMES_AT_ONCE = 2048


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of BLOCK."""
    return data + bytes(max(1, -(-len(data) // BLOCK)) * BLOCK - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    with wave.open(out := io.BytesIO(), "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each band in each frame (the lowest of equals); the last frame is filled up with silence."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    frames = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate((x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((frames, len(BANDS) - 1), np.int64)
    for at in range(0, frames, FRAMES_AT_ONCE):
        power = np.abs(np.fft.rfft(view[at : at + FRAMES_AT_ONCE] * window, axis=1)).round(3)
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            out[at : at + FRAMES_AT_ONCE, b] = power[:, low:high].argmax(axis=1) + low
    return out


def fingerprint(samples: bytes) -> np.ndarray:
    """Codes of peak pairs: frame << 32 | bin << 22 | later bin << 12 | band << 4 | frames between, in order of time."""
    found = peaks(samples)
    time = np.arange(len(found))[:, None]
    band = np.arange(found.shape[1])[None, :]
    parts = [((time << 32) | (found << 22) | (band << 4))[: len(found) - d] | (np.roll(found, -1, axis=1)[d:] << 12) | d for d in range(1, AHEAD + 1) if len(found) > d]
    return np.sort(np.concatenate([p.ravel() for p in parts])) if parts else ((time << 32) | (found << 22) | (band << 4)).ravel()


def media_column(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes of the text, media (the WAV), payload (read back from it) and codes.

    Null texts are empty; empty texts have a payload of BLOCK zero bytes.
    Equal texts have equal values.  Other columns of docs are ignored.
    """
    names = ["doc_id", "n_bytes", "media", "payload", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):  # keeps the outgoing batches small
                part = batch.slice(at, 256)
                data = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column("text")]
                media = [to_wav(padded(d)) for d in data]
                payload = [from_wav(m) for m in media]
                cols = [part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary()), pa.array([fingerprint(p) for p in payload], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, codes array<long>")
