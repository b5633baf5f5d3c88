"""Texts as WAV media columns with spectral fingerprints.

The UTF-8 bytes of a text, padded with byte 255 to a positive multiple of ``BLOCK``, become the 8-bit samples of a WAV
file. The stored bytes are read back with the ``wave`` module, cut into frames for a short-time Fourier transform, and
pairs of spectral peaks become fingerprints with their time codes. A null text is an empty one, which is one block of
padding. Equal texts give equal values; nothing depends on other rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinolex.llm.common import map_texts

BLOCK = 576
PAD = b"\xff"
RATE = 8000
FRAME = 576
HOP = 288
PEAKS = 3
#: A peak is paired with the peaks of this many following frames.
FAN = 2


def payload(data: bytes) -> bytes:
    return data + PAD * (BLOCK - len(data) if not data else -len(data) % BLOCK)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_window = np.hanning(FRAME).astype(np.float32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes (frame numbers) and prints (frequency, frequency, frame distance) of paired peaks."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    tops = []
    for at in range(0, (len(x) - FRAME) // HOP + 1, 1024):  # a bounded number of frames at once
        part = x[at * HOP : (at + 1023) * HOP + FRAME]
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _window, axis=1))
        power[:, :2] = 0
        inner = power[:, 1:-1]
        local = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), np.round(inner, 2), 0)
        tops.append(np.argsort(-local, axis=1, kind="stable")[:, :PEAKS].astype(np.int64) + 1)
    peaks = np.concatenate(tops)
    times, prints = [], []
    for gap in range(1, FAN + 1):
        if len(peaks) > gap:
            a = np.repeat(peaks[:-gap], PEAKS, axis=1).ravel()
            b = np.tile(peaks[gap:], (1, PEAKS)).ravel()
            times.append(np.repeat(np.arange(len(peaks) - gap), PEAKS * PEAKS))
            prints.append(a << 20 | b << 8 | gap)
    if not times:
        return np.zeros(PEAKS, np.int32), peaks[0] << 20
    t, p = np.concatenate(times), np.concatenate(prints)
    by = np.lexsort((p, t))
    return t[by].astype(np.int32), p[by]


def encode(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Media columns of every row: the stored file, its fingerprints as time-coded arrays, and digests of what was read back."""

    def one(text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass")
        media = to_wav(payload(data))
        back = from_wav(media)
        times, prints = fingerprint(back)
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), media, times, prints

    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary, times array<int>, prints array<long>"
    return map_texts(df, keys, text, lambda: lambda texts: [one(t) for t in texts], out)


def digest(media: DataFrame, keys: list[str]) -> DataFrame:
    """The digest columns of ``encode``'s rows; the feature is the hash of the time-coded prints."""
    pairs = F.concat_ws(",", F.col("times").cast("array<string>")), F.concat_ws(",", F.col("prints").cast("array<string>"))
    return media.select(*keys, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.sha2(F.concat_ws("|", *pairs), 256).alias("feature"), F.size("prints").cast("long").alias("n_prints"))
