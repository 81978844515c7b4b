"""Audio features: text bytes as 8-bit audio, polyphase resampling, log-mel tensors, energy segments.

``encode`` stores a payload losslessly as a mono 8-bit PCM WAV; ``decode`` reads the
samples back.  ``features`` resamples 16 kHz to 10 kHz with a five-phase windowed
sinc (one matrix product: each block of eight inputs yields five outputs), takes
25 ms frames every 10 ms, 40 mel bands of their power in logarithm, and finds
active stretches by a two-threshold (hysteresis) detector on the frame energy.
Frames are grouped into patches of a fixed shape (32 x 40, zero-padded at the
end) and stored as an Arrow IPC stream whose tensor column has the canonical
fixed-shape tensor type, with the time span of each patch beside it.

Defined results: null text counts as empty; an empty payload is 64 zero bytes and
has one frame and no active stretch; equal texts have equal values; very long
texts are transformed in blocks of frames; repeated rows are computed alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm.arrow import BYTES_PER_BATCH, map_small, raw_texts

UNIT = 64
RATE, OUT_RATE = 16_000, 10_000
UP, DOWN, HALF = 5, 8, 12
FRAME, HOP, FFT, MELS = 250, 100, 256, 40
PATCH = 32
#: Frames that are transformed at a time.
FRAME_BLOCK = 8192
#: Stored log band powers are multiples of 1 / STEPS, so that the last bits of a machine's own arithmetic do not show.
STEPS = 64
#: The detector switches on above the first and off below the second level (dB against the loudest frame).
ON_DB, OFF_DB, FLOOR_DB = -6.0, -12.0, -60.0
HEADER = 44


def payload(text: bytes) -> bytes:
    """The text's bytes with zero bytes appended up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def encode(data: bytes, rate: int = RATE) -> bytes:
    """Mono 8-bit PCM WAV of ``data``."""
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", HEADER - 8 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(data)) + data


def decode(media: bytes) -> tuple[int, memoryview]:
    """Sample rate and samples (unsigned bytes) of a mono 8-bit PCM WAV."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif name == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def _phases() -> np.ndarray:
    """(DOWN + 2 HALF) x UP: the low-pass filter of every output phase over one block's inputs."""
    cut = 0.92 * UP / DOWN
    t = np.arange(UP)[None, :] * DOWN / UP - (np.arange(DOWN + 2 * HALF)[:, None] - HALF)
    window = np.where(np.abs(t) <= HALF, 0.5 + 0.5 * np.cos(np.pi * t / HALF), 0)
    return (cut * np.sinc(cut * t) * window).astype(np.float32)


@cache
def _mel_bands() -> np.ndarray:
    """(FFT / 2 + 1) x MELS triangular filters."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(20), mel(OUT_RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1)[:, None] * OUT_RATE / FFT
    low, mid, high = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def _resampled(samples: np.ndarray, first: int, count: int) -> np.ndarray:
    """Outputs ``first`` to ``first + count`` of the resampled signal (zero outside the samples)."""
    b0, b1 = first // UP, -(-(first + count) // UP)
    lo, hi = b0 * DOWN - HALF, (b1 - 1) * DOWN + DOWN + HALF
    x = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if a < b:
        x[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
    blocks = np.lib.stride_tricks.sliding_window_view(x, DOWN + 2 * HALF)[::DOWN]
    out = (blocks @ _phases()).reshape(-1)
    return out[first - b0 * UP : first - b0 * UP + count]


def frames_of(n_samples: int) -> int:
    """Frames that cover the resampled signal."""
    n = -(-n_samples * UP // DOWN)
    return max(1, -(-(n - FRAME) // HOP) + 1)


def log_mel(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """frames x MELS log band powers, and each frame's energy in dB."""
    total = frames_of(len(samples))
    mels, energy = np.empty((total, MELS), np.float32), np.empty(total, np.float32)
    window = np.hanning(FRAME).astype(np.float32)
    for at in range(0, total, FRAME_BLOCK):
        n = min(FRAME_BLOCK, total - at)
        y = _resampled(samples, at * HOP, (n - 1) * HOP + FRAME)
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        frames = frames - frames.mean(axis=1, keepdims=True)
        energy[at : at + n] = 10 * np.log10((frames * frames).mean(axis=1) + 1e-10)
        power = np.abs(np.fft.rfft(frames * window, FFT)) ** 2
        mels[at : at + n] = np.rint(np.log(power.astype(np.float32) @ _mel_bands() + 1e-6) * STEPS) / STEPS
    return mels, energy


def active_spans(energy: np.ndarray) -> list[tuple[float, float]]:
    """Seconds of stretches that begin above the on level and last until the off level."""
    level = np.round(energy - max(float(energy.max()), FLOOR_DB), 3)
    mark = np.where(level >= ON_DB, 1, np.where(level < OFF_DB, 0, -1))
    mark[energy < FLOOR_DB] = 0
    known = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    state = np.where(known >= 0, mark[known], 0)
    edges = np.flatnonzero(np.diff(np.r_[0, state, 0]))
    return [(a * HOP / OUT_RATE, ((b - 1) * HOP + FRAME) / OUT_RATE) for a, b in edges.reshape(-1, 2).tolist()]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel"))
_PATCHES = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", TENSOR)])


def pack_patches(mels: np.ndarray) -> bytes:
    """Arrow IPC stream of the fixed-shape patches with their time spans."""
    n = -(-len(mels) // PATCH)
    values = np.zeros((n * PATCH, MELS), np.float32)
    values[: len(mels)] = mels
    first = np.arange(n) * PATCH
    valid = np.minimum(len(mels) - first, PATCH)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), PATCH * MELS)
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array(first * HOP / OUT_RATE),
            pa.array(((first + valid - 1) * HOP + FRAME) / OUT_RATE),
            pa.array(valid.astype(np.int32)),
            pa.ExtensionArray.from_storage(TENSOR, storage),
        ],
        schema=_PATCHES,
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PATCHES) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_patches(stored: bytes) -> pa.Table:
    """The table that :func:`pack_patches` stored: spans and the fixed-shape tensor column."""
    return pa.ipc.open_stream(stored).read_all()


_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, payload_bytes, media, frames, tensors, spans)`` for every row of ``docs``.

    ``media`` is the WAV, ``tensors`` the Arrow stream of log-mel patches and
    ``spans`` the active stretches, all computed from the stored bytes.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "media", "frames", "tensors", "spans"]

    def flush(rows):
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), _SPANS]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                media = encode(payload(text))
                _, stored = decode(media)
                mels, energy = log_mel(np.frombuffer(stored, np.uint8))
                spans = [{"start_s": a, "end_s": b} for a, b in active_spans(energy)]
                tensors = pack_patches(mels)
                rows.append((doc_id, len(text), len(stored), media, len(mels), tensors, spans))
                size += len(media) + len(tensors)
                if size > BYTES_PER_BATCH:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    return map_small(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
        run,
        "doc_id long, n_bytes long, payload_bytes long, media binary, frames long, tensors binary, "
        "spans array<struct<start_s double, end_s double>>",
    )


def digests(stored: DataFrame) -> DataFrame:
    """Digest columns of :func:`features`' output, taken from the stored bytes."""
    data = F.expr(f"substring(media, {HEADER + 1}, int(payload_bytes))")
    tail = F.expr(f"substring(media, int({HEADER + 1 - UNIT} + payload_bytes), {UNIT})")
    feature = F.concat_ws(
        ";", F.concat(F.lit("frames="), F.col("frames")), F.concat(F.lit("spans="), F.size("spans")),
        F.concat(F.lit("active="), F.format_number(F.aggregate("spans", F.lit(0.0), lambda s, x: s + x["end_s"] - x["start_s"]), 3)),
        F.concat(F.lit("logmel="), F.substring(F.sha2("tensors", 256), 1, 16)),
    )
    return stored.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2(data, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
