"""Media columns: texts stored as 8-bit WAV, read back by the wave module, and fingerprinted from their spectrum.

A payload byte is one sample. Fingerprints follow the usual landmark scheme: short-time Fourier transforms, the
strongest local peaks of each band and frame, and pairs of peaks that are close in time, each a code of two
frequencies and their distance, kept with the frame in which it starts.

Scale: no shuffle; each row is worked on alone, in blocks of frames, so that memory doesn't follow the longest text.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import bounded, pieces, text_or_empty

#: Payloads are padded with bytes 255 to a positive multiple of PAD.
PAD = 576
RATE = 8000
FRAME, HOP = 576, 288
#: Frames transformed at a time.
BLOCK = 2048
#: Bands of frequency bins; each gives at most one peak per frame.
BANDS = ((4, 24), (24, 64), (64, 128), (128, 288))
#: A peak stands this many times above its frame's mean magnitude.
LOUDNESS = 2.5
FAN_OUT = 3
MOST_FRAMES_APART = 63

_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % PAD if raw else PAD)


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


def spectrum_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of each peak, by frame, then bin: the strongest bin of a band, where it is no weaker than its four
    neighbours in time and frequency and loud in its frame."""
    n = max(1, 1 + (len(samples) - FRAME) // HOP)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    times, bins = [], []
    for at in range(0, n, BLOCK):
        # one frame on either side, for the comparison in time
        low, high = max(0, at - 1), min(n, at + BLOCK + 1)
        part = (frames[low:high].astype(np.float32) - 128) * _WINDOW
        size = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        size = np.round(size * 16)
        mean = size[:, BANDS[0][0]:].mean(axis=1) * LOUDNESS
        own = np.arange(at, min(n, at + BLOCK)) - low
        before, after = np.maximum(own - 1, 0), np.minimum(own + 1, high - low - 1)
        for a, b in BANDS:
            best = a + size[own, a:b].argmax(axis=1)
            value = size[own, best]
            good = (value > mean[own]) & (value >= size[before, best]) & (value >= size[after, best])
            good &= (value >= size[own, best - 1]) & (value >= size[own, best + 1])
            times.append((own + low)[good])
            bins.append(best[good])
    when, which = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((which, when))
    return when[order], which[order]


def pair_codes(when: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Time-coded fingerprints, ascending: frame * 2**32 + code; a code holds both bins and the frames between."""
    out = []
    for k in range(1, FAN_OUT + 1):
        gap = when[k:] - when[:-k]
        near = gap <= MOST_FRAMES_APART
        code = (which[:-k].astype(np.int64) << 20) | (which[k:].astype(np.int64) << 8) | gap
        out.append(((when[:-k].astype(np.int64) << 32) | code)[near])
    return np.sort(np.concatenate(out))


def store_as_wav(docs: DataFrame) -> DataFrame:
    """docs with `media` (binary), the WAV of the padded UTF-8 text, and n_bytes, its length before padding; text goes.

    Null text: empty, so one block of padding. Equal texts give equal bytes. Repeated rows and other columns pass; an
    empty table gives no rows; columns of docs named media or n_bytes are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            arrays = [*(batch.column(c) for c in rest), pa.array(list(map(len, raw)), pa.int64()), pa.array([to_wav(padded(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_bytes", "media"])

    source = bounded(docs.drop("media", "n_bytes")).withColumn("text", text_or_empty())
    fields = [f for f in source.schema.fields if f.name != "text"]
    return source.mapInArrow(run, T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def fingerprint(stored: DataFrame) -> DataFrame:
    """Adds payload (binary, the samples that the wave module reads from `media`) and fingerprint (array<bigint>, the
    time-coded pairs of spectral peaks). Null media: null payload, no fingerprint. A broken WAV raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "media", 1 << 20):
            payloads = [None if m is None else from_wav(m) for m in batch.column("media").to_pylist()]
            found = []
            for p in payloads:
                samples = np.frombuffer(p or b"", np.uint8)
                if len(samples) < FRAME:
                    samples = np.pad(samples, (0, FRAME - len(samples)), constant_values=128)
                found.append(pair_codes(*spectrum_peaks(samples)))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            prints = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), prints], names=[*batch.schema.names, "payload", "fingerprint"])

    source = stored.drop("payload", "fingerprint")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("fingerprint", T.ArrayType(T.LongType()))]))


def op3_wav_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    heard = fingerprint(store_as_wav(docs))
    tail = F.expr("substring(payload, -32, 32)")
    feature = F.concat_ws(":", F.size("fingerprint").cast("string"), F.sha2(F.array_join(F.col("fingerprint").cast("array<string>"), ","), 256))
    return heard.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
