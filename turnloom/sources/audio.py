"""PCM WAV files as a table, manifests of recordings, and live PCM chunks."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 16000
CHUNK = 10 * RATE  # samples of a row of output
MANIFEST = "audio_name string, audio_path string, duration_sec double, segments array<struct<start:double,end:double,speaker:string,text:string>>"


def decode(content: bytes) -> tuple[np.ndarray, int]:
    """float32 frames [n, channels] in [-1, 1) and the rate. 8 bits are unsigned; 16, 24 and 32 signed. A payload cut short is an error."""
    with wave.open(io.BytesIO(content)) as w:
        n, channels, width, rate = w.getnframes(), w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(n)
    if len(raw) != n * channels * width:
        raise ValueError(f"{n * channels * width} bytes of samples announced, {len(raw)} found")
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    elif width == 3:  # the three bytes become the high ones of an int32
        wide = np.zeros((n * channels, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0].astype(np.float64) / 2**31
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float64) / 2 ** (8 * width - 1)
    else:
        raise ValueError(f"samples of {width} bytes")
    return np.asarray(x, np.float32).reshape(-1, channels), rate


def encode(x: np.ndarray, rate: int) -> bytes:
    """16-bit WAV of samples that are clipped to [-1, 1]."""
    x = np.asarray(x, np.float32)
    x = x[:, None] if x.ndim == 1 else x
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(x.shape[1])
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def resample(x: np.ndarray, rate: int, to: int = RATE, half: int = 16) -> np.ndarray:
    """Mono samples at another rate: a windowed sinc low-pass at the smaller of both, evaluated only where an output sample falls."""
    if rate == to or not len(x):
        return np.asarray(x, np.float32)
    ratio = Fraction(to, rate)
    n = -(-len(x) * ratio.numerator // ratio.denominator)
    cut = min(1.0, to / rate)
    reach = int(np.ceil(half / cut))
    padded = np.pad(np.asarray(x, np.float64), reach)
    out = np.empty(n, np.float32)
    for a in range(0, n, 1 << 15):  # bounded memory
        at = np.arange(a, min(n, a + (1 << 15))) * ratio.denominator / ratio.numerator
        base = np.floor(at).astype(np.int64)
        offset = np.arange(-reach + 1, reach + 1)
        d = offset[None, :] - (at - base)[:, None]
        k = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / reach, -1, 1)))
        out[a : a + len(at)] = (padded[base[:, None] + offset[None, :] + reach] * k).sum(1) / k.sum(1)
    return out


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start_sample", "samples", "source_rate", "duration_sec"]
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, rate = decode(content)
            y = resample(x.mean(axis=1), rate)
            for at in range(0, max(1, len(y)), CHUNK):
                cols = [[path], [at], [y[at : at + CHUNK]], [rate], [len(x) / rate]]
                kinds = [pa.string(), pa.int64(), pa.list_(pa.float32()), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, start_sample, samples (mono, 16 kHz), source_rate, duration_sec: a row for each ten seconds. A file is decoded by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInArrow(_samples, "path string, start_sample long, samples array<float>, source_rate int, duration_sec double")


def durations(spark: SparkSession, path: str) -> DataFrame:
    """path and duration_sec by the header of plain PCM files: nothing is decoded; null where the header is another."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(path)

    def number(at: int) -> F.Column:
        """The little-endian 32-bit number at a 1-based byte of the head."""
        h = F.hex(F.substring("head", at, 4))
        return F.conv(F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("double")

    head = files.select("path", F.substring("content", 1, 44).alias("head"))
    plain = (F.substring("head", 1, 4) == F.lit(b"RIFF")) & (F.substring("head", 37, 4) == F.lit(b"data"))
    return head.select("path", F.when(plain & (number(29) > 0), number(41) / number(29)).alias("duration_sec"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of recordings. A malformed file, or a recording without audio_path, is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return rows.withColumn("audio_path", F.when(F.trim("audio_path") != "", F.col("audio_path")).otherwise(F.raise_error(F.lit("a recording has no audio_path"))))
