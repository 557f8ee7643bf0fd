"""Media columns: bytes kept as WAV samples, and spectral fingerprints of them.

A payload is stored as unsigned 8-bit mono PCM by the ``wave`` module. Features
come from a short-time Fourier transform (Hann window of 192 samples, hop 96).
In each of six frequency bands a frame's strongest bin is a peak if no nearby
frame is stronger in that band. Every peak is paired with the next few peaks
after it; a pair becomes one integer, the frame of its first peak above a code
of the two bins and the frames between them.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, held, small

UNIT = 192
FILL = b" "
RATE = 8000
WINDOW, HOP = 192, 96
BANDS, BAND_BINS = 6, 16
REACH = 2
FAN_OUT = 3
MAX_GAP = 63
_BLOCK = 4096  # frames transformed at once, so that a long payload needs little memory
_HANN = np.hanning(WINDOW).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 of ``text`` (null: empty), filled up with blanks to a positive multiple of 192 bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, FILL)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return w.readframes(w.getnframes())


class Features(NamedTuple):
    n_frames: int
    n_peaks: int
    fingerprint: np.ndarray  # int64, in time order


def _band_maxima(samples: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    level, where = np.empty((n, BANDS), np.float32), np.empty((n, BANDS), np.int64)
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    for at in range(0, n, _BLOCK):
        part = (frames[at : at + _BLOCK].astype(np.float32) - 128.0) * _HANN
        power = np.fft.rfft(part, axis=1)[:, 1 : 1 + BANDS * BAND_BINS]
        power = (power.real**2 + power.imag**2).reshape(-1, BANDS, BAND_BINS)
        best = power.argmax(axis=2)
        where[at : at + _BLOCK] = best
        level[at : at + _BLOCK] = np.take_along_axis(power, best[..., None], axis=2)[..., 0]
    return level, where + np.arange(BANDS) * BAND_BINS


def features(payload: bytes) -> Features:
    """Peak pairs of a payload; under 192 bytes have no frame and so no pair."""
    samples = np.frombuffer(payload, np.uint8)
    n = max(0, (len(samples) - WINDOW) // HOP + 1)
    if not n:
        return Features(0, 0, np.empty(0, np.int64))
    level, bins = _band_maxima(samples, n)
    peak = level > 0
    for by in range(1, min(REACH, n - 1) + 1):
        peak[by:] &= level[by:] > level[:-by]  # of equal frames the first is the peak
        peak[:-by] &= level[:-by] >= level[by:]
    at, band = np.nonzero(peak)  # by frame, then by band
    tone = bins[at, band]
    pairs = []
    for k in range(1, FAN_OUT + 1):
        gap = at[k:] - at[:-k]
        ok = (gap > 0) & (gap <= MAX_GAP)
        pairs.append((at[:-k][ok] << 20) | (tone[:-k][ok] << 13) | (tone[k:][ok] << 6) | gap[ok])
    return Features(n, len(at), np.sort(np.concatenate(pairs).astype(np.int64)))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``id_col, media_col binary``: each text stored as a WAV file. Null and empty texts hold one unit of blanks."""
    columns_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("media")
        for b in small(batches):
            media = pa.array([to_wav(payload_of(t.as_py())) for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), media], [id_col, media_col])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{media_col}` binary")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, n_frames, n_peaks, fingerprint array<long>`` of WAV files; a null file has no frames and no pairs."""
    columns_of(media, id_col, media_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("media")
        for b in small(batches):
            found = [features(from_wav(m.as_py())) if m.is_valid else features(b"") for m in b.column(1)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([f.n_frames for f in found], pa.int64()), pa.array([f.n_peaks for f in found], pa.int64()),
                pa.array([f.fingerprint for f in found], pa.list_(pa.int64())),
            ], [id_col, "n_frames", "n_peaks", "fingerprint"])

    return media.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {media.schema[id_col].dataType.simpleString()}, n_frames long, n_peaks long, fingerprint array<long>")


_DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_peaks long, n_pairs long"


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back and describes both, in one pass.

    Payload columns are computed from what is read back. ``feature`` is the
    SHA-256 of the fingerprint as little-endian 64-bit integers. Null texts
    count as empty; equal texts have equal values; rows keep their number.
    """
    columns_of(docs, id_col, text_col)
    names = [id_col, *(x.split()[0] for x in _DIGESTS.split(", "))]

    def one(text: str | None) -> tuple:
        media = to_wav(payload_of(text))
        payload = from_wav(media)
        found = features(payload)
        return (
            len((text or "").encode("utf-8", "surrogatepass")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
            len(media), hashlib.sha256(media).hexdigest(), hashlib.sha256(found.fingerprint.astype("<i8").tobytes()).hexdigest(),
            found.n_frames, found.n_peaks, len(found.fingerprint),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("media")
        for b in small(batches):
            if b.num_rows:
                columns = zip(*(one(t.as_py()) for t in b.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_DIGESTS}")
