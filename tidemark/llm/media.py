"""Audio columns: bytes stored as 8-bit samples, read back, resampled, and described by log-mel frames and segments.

store() packs a payload into a WAV file of unsigned 8-bit mono samples, which keeps every byte. features() reads the
stored bytes back: the samples go through a polyphase low-pass filter that halves the rate, overlapped Hann frames
through a mel filterbank, and frame energies through a two-threshold (hysteresis) detector. windows holds every frame: for
each WINDOW frames of the clip their time span and a tensor of WINDOW x MELS log-mels, row by row; the last one is padded
with silence, and its span ends with the clip. Spark has no tensor type, so the column holds what an Arrow tensor of that
fixed shape stores, and tensors() makes it that without a copy of the values. windows_sha256 covers all of a clip's
tensors, to a hundredth. log_mel is the mean log-mel
of POOLED equal time spans, flattened, and spans are the detected segments in milliseconds.

Each clip is computed by itself in blocks of a fixed size, so equal clips have equal values wherever they are.

Defined results: null is an empty payload; an empty payload is padded to UNIT zero bytes; a clip shorter than a frame
is one zero-padded frame; silence has no segments; bytes that aren't such a file raise an error; an empty table gives no
rows; columns that are kept may have any names but those of the features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, map_batches, table

UNIT = 64
RATE, DOWN, TAPS = 16_000, 2, 16
FRAME, HOP, MELS, POOLED, WINDOW = 256, 128, 24, 8, 64
#: What a log-mel is in silence.
SILENCE = np.log(np.float32(1e-6))
#: What the tensors of windows are to Arrow.
TENSOR = pa.fixed_shape_tensor(pa.float32(), [WINDOW, MELS], dim_names=["frame", "mel"])
#: Hysteresis in dB over a clip's quietest tenth of frames: a segment starts above HIGH and lasts while above LOW.
HIGH, LOW = 9.0, 4.0
BLOCK = 4096
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(payload: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    n = len(payload)
    return HEADER.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def samples(stored: bytes) -> bytes:
    """The payload of what wav() makes."""
    head = HEADER.unpack_from(stored)
    if (head[0], head[2], head[3], head[10], head[11]) != (b"RIFF", b"WAVE", b"fmt ", 8, b"data") or len(stored) != HEADER.size + head[12]:
        raise ValueError("not a stored clip")
    return stored[HEADER.size :]


def padded(payload: Column) -> Column:
    """payload (binary) with zero bytes up to a positive multiple of UNIT."""
    n = F.octet_length(payload)
    missing = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.concat(payload, F.unhex(F.repeat(F.lit("00"), missing)))


def store(df: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """keep, and media: the stored clip of each payload (binary)."""
    head = lambda n: F.concat(F.lit(b"RIFF"), little(n + 36), F.lit(HEADER.pack(b"RIFF", 0, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", 0)[8:40]), little(n))
    little = lambda n: F.unhex(F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    return df.select(*keep, F.concat(head(F.octet_length(payload)), F.col(payload)).alias("media"))


@lru_cache(1)
def tools() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The low-pass filter's phases, the window and the mel filterbank."""
    n = np.arange(TAPS * DOWN) - (TAPS * DOWN - 1) / 2
    low = np.sinc(n / DOWN) / DOWN * np.hamming(TAPS * DOWN)
    phases = np.ascontiguousarray((low / low.sum()).reshape(TAPS, DOWN).T).astype(np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(RATE / DOWN / 2), MELS + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(FRAME, DOWN / RATE)
    up = (hz[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return phases, window, np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resampled(x: np.ndarray) -> np.ndarray:
    """x at RATE / DOWN: each phase of the filter meets its own phase of the signal."""
    phases, _, _ = tools()
    x = np.concatenate([np.zeros(TAPS * DOWN - DOWN, np.float32), x, np.zeros(-len(x) % DOWN, np.float32)])
    return sum(np.convolve(x[p::DOWN], phases[DOWN - 1 - p], "valid") for p in range(DOWN))


def log_mel(y: np.ndarray) -> np.ndarray:
    """Frames x MELS."""
    _, window, bank = tools()
    short = max(FRAME - len(y), -(len(y) - FRAME) % HOP)
    y = np.concatenate([y, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    out = []
    for at in range(0, len(frames), BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, axis=1)
        out.append(np.log((spectrum.real**2 + spectrum.imag**2).astype(np.float32) @ bank + np.float32(1e-6)))
    return np.concatenate(out)


def segments(level: np.ndarray) -> np.ndarray:
    """Rows of first and last frame of each segment; level in dB."""
    floor = np.partition(level, len(level) // 10)[len(level) // 10]
    state = np.where(level >= floor + HIGH, 1, np.where(level < floor + LOW, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(known >= 0, state[known], 0), [0]])
    turn = np.diff(on)
    return np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) - 1], axis=1)


def pooled(mel: np.ndarray) -> np.ndarray:
    """POOLED x MELS: means over equal spans, which overlap by rounding where frames are few."""
    at = np.arange(POOLED + 1) * len(mel) / POOLED
    first = np.minimum(np.floor(at[:-1]).astype(int), len(mel) - 1)
    last = np.maximum(np.ceil(at[1:]).astype(int), first + 1)
    sums = np.concatenate([np.zeros((1, MELS)), np.cumsum(mel, axis=0, dtype=np.float64)])
    return ((sums[last] - sums[first]) / (last - first)[:, None]).astype(np.float32)


def in_windows(mel: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each WINDOW frames of Frames x MELS in milliseconds, and their values, windows x WINDOW x MELS."""
    n = -(-len(mel) // WINDOW)
    whole = np.full((n * WINDOW, MELS), SILENCE, np.float32)
    whole[: len(mel)] = mel
    ms = 1000 * DOWN / RATE
    first = np.arange(n) * WINDOW
    last = np.minimum(first + WINDOW, len(mel)) - 1
    return first * HOP * ms, (last * HOP + FRAME) * ms, whole.reshape(n, WINDOW, MELS)


def column_of(windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
    """The column windows from the in_windows() of each clip."""
    together = lambda k, kind: np.concatenate([np.empty(0, kind), *(x[k].ravel() for x in windows)])
    values = together(2, np.float32)
    size = WINDOW * MELS
    mels = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size), pa.int32()), pa.array(values))
    spans = pa.StructArray.from_arrays([pa.array(together(0, np.float64)), pa.array(together(1, np.float64)), mels], ["start_ms", "end_ms", "log_mel"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in windows)]), pa.int32()), spans)


def tensors(windows: pa.Array) -> pa.Array:
    """The tensors of a column windows, one after another, as an Arrow array of fixed-shape tensors."""
    mels = windows.flatten().field("log_mel")
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(mels.flatten(), WINDOW * MELS))


def describe(stored: bytes) -> tuple:
    """All features of one stored clip."""
    payload = samples(stored)
    x = np.frombuffer(payload, np.uint8).astype(np.float32)
    x -= 128
    mel = log_mel(resampled(x / 128))
    level = mel.mean(axis=1) * np.float32(10 / np.log(10))
    found = segments(level)
    ms = 1000 * DOWN / RATE
    spans = (found * [HOP, HOP] + [0, FRAME]) * ms
    return payload, len(mel), pooled(mel).ravel(), spans[:, 0], spans[:, 1], float(level.mean()), float(level.max()), in_windows(mel)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, log_mel array<float>, span_start_ms array<double>, span_end_ms array<double>, level_mean double, level_max double, windows_sha256 string, windows array<struct<start_ms: double, end_ms: double, log_mel: array<float>>>"


def features(df: DataFrame, media: str = "media", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep, and what FEATURES names, of each stored clip read back from its bytes."""
    keep, source = list(keep), fresh(keep, "stored_clip")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, every = [], []
        for clip in batch.column(source):
            stored = clip.as_py()
            payload, n, mel, start, end, mean, most, windows = describe(stored)
            every.append(windows)
            shown = hashlib.sha256(np.rint(windows[2] * 100).astype("<i4").tobytes()).hexdigest()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), n, mel, start, end, mean, most, shown))
        names = [x.split()[0] for x in FEATURES.partition(", windows ")[0].split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.string()]
        made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *made, column_of(every)], [*keep, *names, "windows"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(df.select(*keep, F.col(media).alias(source)), run, f"{kinds}, {FEATURES}")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as a clip, and its features."""
    payload = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(payload).cast("long").alias("n_bytes"), padded(payload).alias("payload"))
    out = features(store(docs, "payload", ("doc_id", "n_bytes")), keep=("doc_id", "n_bytes"))
    # rounded so that the text shows the values; the digest covers them all
    digest = F.sha2(F.array_join(F.transform("log_mel", lambda x: F.format_string("%.4f", x)), ","), 256)
    feature = F.concat_ws(";", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("windows="), F.size("windows")), F.concat(F.lit("tensors="), "windows_sha256"), F.concat(F.lit("segments="), F.size("span_start_ms")), F.concat(F.lit("level_mean="), F.format_string("%.4f", "level_mean")), F.concat(F.lit("level_max="), F.format_string("%.4f", "level_max")), F.concat(F.lit("log_mel="), digest))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
