"""Media columns: bytes as WAV, short-time Fourier transforms and spectral-peak pair fingerprints.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored losslessly as 8-bit mono
samples in a WAV column. Reading goes through the wave module: the samples are transformed in overlapping
frames; a frame's strongest bin is a peak if it is at least as strong as the same bin in the frames beside
it; each peak is paired with the next :data:`FAN` ones no further than :data:`REACH` frames away. A
fingerprint is one 64-bit integer: the anchor's frame in the upper 32 bits, then 9 bits of either bin and
8 bits of distance; the last peak also stands alone, without partner. Every operation is per row, so nothing is shuffled; frames are transformed in blocks,
so memory is bounded by the row.

Defined results: a null text is the empty one (64 zero bytes); audio shorter than a frame is one padded
frame; equal texts give equal values, whatever their rows; null ids are carried; a text of any length is one row, whole;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, RATE = 64, 8000
FRAME, HOP, FAN, REACH, BLOCK = 128, 64, 3, 32, 8192


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % PAD or (0 if data else PAD))


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks of 8-bit samples."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    wave_ = np.zeros(FRAME + (n - 1) * HOP, np.float32)
    wave_[: len(samples)] = samples.astype(np.float32) - np.float32(128)
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    times, bins = [], []
    for lo in range(0, n, BLOCK):
        a, z = max(0, lo - 1), min(n, lo + BLOCK + 1)
        power = np.abs(np.fft.rfft(frames[a:z] * window, axis=1))[:, 1:]
        best = power.argmax(axis=1)
        row = np.arange(z - a)
        top = power[row, best]
        ok = top > 0
        ok[1:] &= top[1:] >= power[row[:-1], best[1:]]
        ok[:-1] &= top[:-1] >= power[row[1:], best[:-1]]
        found = np.flatnonzero(ok[lo - a : lo - a + BLOCK][: n - lo]) + lo
        times.append(found)
        bins.append(best[found - a] + 1)
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Time-coded fingerprints of pairs of peaks, in order of their anchors."""
    t, b = peaks(samples)
    codes = [(t[-1:] << 32) | (b[-1:] << 17)]
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = gap <= REACH
        codes.append(((t[:-k] << 32) | (b[:-k] << 17) | (b[k:] << 8) | gap)[near])
    return np.sort(np.concatenate(codes)).astype(np.int64)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes and its WAV column ``media``."""

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([to_wav(padded(x)) for x in texts], pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the WAV column back: digests of payload and stored form, the fingerprint array and its digest."""

    def run(batches):
        for batch in batches:
            out: dict = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "fingerprints", "feature")}
            for stored in batch.column(2):
                stored = stored.as_py()
                payload = from_wav(stored)
                prints = fingerprints(np.frombuffer(payload, np.uint8))
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-PAD:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["fingerprints"].append(prints)
                out["feature"].append(f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}")
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]], names=[id_col, "n_bytes", *out])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "n_bytes", "media").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, fingerprints array<long>, feature string"
    )
