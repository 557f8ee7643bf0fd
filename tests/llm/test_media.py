import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from streetloom.llm import media

TEXTS = [None, "", "a", "é" * 96, "é" * 97, "the quick brown fox " * 300, " ".join(str(i * i) for i in range(3000))]


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(text):
    payload = media.payload_of(text)
    data = (text or "").encode()
    assert len(payload) % 192 == 0 and len(payload) > 0 and len(payload) - len(data) <= 192
    assert payload == data + b" " * (len(payload) - len(data))
    stored = media.to_wav(payload)
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, len(payload))
    assert media.from_wav(stored) == payload


def slow_pairs(payload):
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = (len(x) - 192) // 96 + 1
    peaks, level = [], {}
    for t in range(n):
        f = np.fft.rfft((x[t * 96 : t * 96 + 192] * media._HANN)[None].astype(np.float32), axis=1)[0]
        p = (f.real**2 + f.imag**2)[1:97].reshape(6, 16)
        for b in range(6):
            level[t, b] = (p[b].max(), 16 * b + int(p[b].argmax()))
    for t in range(n):
        for b in range(6):
            v = level[t, b][0]
            if v > 0 and all(v > level[s, b][0] for s in range(max(0, t - 2), t)) and all(v >= level[s, b][0] for s in range(t + 1, min(n, t + 3))):
                peaks.append((t, level[t, b][1]))
    out = []
    for i, (t, a) in enumerate(peaks):
        for u, b in peaks[i + 1 : i + 4]:
            if 0 < u - t <= 63:
                out.append(t << 20 | a << 13 | b << 6 | (u - t))
    return n, len(peaks), sorted(out)


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_plain_form(text):
    got = media.features(media.payload_of(text))
    n, peaks, pairs = slow_pairs(media.payload_of(text))
    assert (got.n_frames, got.n_peaks, got.fingerprint.tolist()) == (n, peaks, pairs)
    assert (np.diff(got.fingerprint >> 20) >= 0).all()


def test_blocks_do_not_change_features(monkeypatch):
    payload = media.payload_of(TEXTS[-1])
    whole = media.features(payload)
    monkeypatch.setattr(media, "_BLOCK", 7)
    assert media.features(payload).fingerprint.tolist() == whole.fingerprint.tolist()


def test_frames(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", "x"), (2, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = media.media_digests(docs).collect()
    assert len(got) == len(rows)
    for (d, t, _), r in zip(rows, got, strict=True):
        payload = media.payload_of(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, len((t or "").encode()), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        assert r.media_sha256 == hashlib.sha256(media.to_wav(payload)).hexdigest() and r.media_bytes == len(media.to_wav(payload))
    assert len({r[1:] for r in got if r.n_bytes == 1}) == 1
    features = media.media_features(media.to_media(docs)).collect()
    assert [hashlib.sha256(np.array(f.fingerprint, "<i8").tobytes()).hexdigest() for f in features] == [r.feature for r in got]
    assert media.media_digests(docs.limit(0)).collect() == []
