"""Media columns: lossless WAV storage and spectral fingerprints.

Bytes become the 8-bit samples of a mono WAV file, written and read by the
``wave`` module.  Features are a short-time Fourier transform, its strongest
bin in each band, and pairs of peaks of near frames, each pair a number with
the time at which it begins.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import binary_lists, slices, text_of

RATE, FRAME, HOP, AHEAD = 8000, 256, 128, 3
#: Bin ranges; one peak in each per frame.
BANDS = ((1, 10), (10, 25), (25, 60), (60, 129))
BLOCK_FRAMES = 2048
UNIT = 64
PASS_BYTES = 4 << 20


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """With bytes 0 up to a positive multiple of ``unit``."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(pair codes, times): for each frame and band, its peak with the peak of the next band one to AHEAD frames on.

    Silence of one hop goes before the sound, so that no sample stands where the
    window is zero only, and whole hops and AHEAD frames behind it: every sample
    is read, and every frame that holds one begins pairs, however short the sound
    is.  The transform runs over blocks of frames, so memory doesn't grow with
    the length of the sound.  A code is, from the low bits, the distance in
    frames (2), the later peak's bin (8), the earlier one's (8) and its loudness
    in eighths of an octave of power (9).
    """
    x = np.frombuffer(payload, np.uint8)
    n = -(-len(x) // HOP) + 1
    silence = np.full((n + AHEAD - 1) * HOP + FRAME - HOP - len(x), 128, np.uint8)
    x = np.concatenate([np.full(HOP, 128, np.uint8), x, silence])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    peaks, loud = [], []
    for i in range(0, len(frames), BLOCK_FRAMES):
        spectrum = np.fft.rfft((frames[i : i + BLOCK_FRAMES].astype(np.float32) - 128) * hann, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        peaks.append(np.stack([power[:, a:b].argmax(axis=1) + a for a, b in BANDS], axis=1))
        loud.append((8 * np.log2(1 + np.take_along_axis(power, peaks[-1], axis=1))).astype(np.int32))
    p = np.concatenate(peaks).astype(np.int32)
    codes = np.stack([np.concatenate(loud)[:n] << 18 | p[:n] << 10 | np.roll(p[dt : n + dt], -1, axis=1) << 2 | dt for dt in range(1, AHEAD + 1)], axis=1)
    codes = np.sort(codes.reshape(n, AHEAD * len(BANDS)), axis=1)
    return codes.ravel(), np.repeat(np.arange(n, dtype=np.int32), codes.shape[1])


def feature_string(codes: np.ndarray, times: np.ndarray) -> str:
    return f"{len(codes)}:{hashlib.md5(codes.astype('<i4').tobytes() + times.astype('<i4').tobytes()).hexdigest()}"


def media_columns(df: DataFrame, id_col: str = "doc_id", text: str = "text", keep_media: bool = True, keep_pairs: bool = True) -> DataFrame:
    """One row per row of ``df``.

    id, n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the samples as
    read back), media_bytes, media_sha256, feature (a digest of the arrays); with
    ``keep_media`` the WAV file, with ``keep_pairs`` the arrays pair_codes and
    pair_times.  Null and empty texts give one unit of zeros; equal texts give
    equal values; a very long text is one sound, transformed block by block; an
    empty table gives an empty result; other columns of ``df``, whatever their
    names, are left out.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema += ", media binary" * keep_media + ", pair_codes array<int>, pair_times array<int>" * keep_pairs
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PASS_BYTES):
            rows = []
            for data in binary_lists(batch, "text"):
                media = to_wav(padded(data))
                back = from_wav(media)
                codes, times = fingerprint(back)
                row = (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature_string(codes, times))
                rows.append(row + (media,) * keep_media + (codes, times) * keep_pairs)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names
                )

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    types += [pa.binary()] * keep_media + [pa.list_(pa.int32())] * 2 * keep_pairs
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)
