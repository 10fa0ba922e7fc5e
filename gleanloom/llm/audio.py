"""Audio features of stored samples: resampling, log-mel filterbanks, energy segments, as fixed-shape tensors.

Media are kept as WAV bytes in a binary column (8-bit unsigned samples, one channel). Features are computed from
what the column holds: samples are resampled by a polyphase filter (``UP`` / ``DOWN``), cut into overlapping frames,
and turned into log-mel energies. The frames are stored as tensors of the fixed shape ``FRAMES x MELS``, the last
one padded, in an Arrow stream with one row per tensor: first and last second, frames in use, log-mel tensor. Energy
segments are found by hysteresis: a segment opens above the upper threshold, lasts while the energy is above the lower one, and
short gaps are bridged; they are time spans in seconds.

Long media are worked through in blocks of ``BLOCK`` samples, so a task holds one block beside its stored bytes. Blocks begin
at fixed places, so equal media give equal values, wherever they lie.

Edge cases: null or empty text is stored as one unit of blanks; media shorter than a frame give one padded frame; silence has no
segments; null and repeated ids are rows like others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanloom.llm.common import whole_text

UNIT = 192
RATE = 24_000
UP, DOWN = 2, 3  # to 16,000 samples a second
TAPS = 16  # of each phase
WINDOW, HOP, FFT = 400, 160, 512
MELS = 40
FRAMES = 64
LOW_HZ, HIGH_HZ = 60.0, 7_600.0
OPEN_DB, CLOSE_DB = 3.0, 1.0
BRIDGE, SHORTEST = 5, 3  # frames
FRAMES_A_BLOCK = 1_024

TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", TENSOR)])


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of 8-bit unsigned samples, one channel."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """Samples and rate of such a file; chunks other than format and data are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit PCM of one channel is read")
        elif kind == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[bytes, int]:
    """The text's bytes with blanks up to a positive multiple of ``UNIT``, and their number without blanks."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data)), len(data)


def lowpass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc filter as (phase, tap): the branches of the polyphase resampler."""
    size = up * taps
    n = np.arange(size) - (size - 1) / 2
    cutoff = 1.0 / max(up, down)
    h = np.sinc(n * cutoff) * cutoff * np.blackman(size) * up
    return np.stack([h[phase::up][::-1] for phase in range(up)])


def resample(samples: np.ndarray, first: int, count: int, branches: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Output samples ``first`` to ``first + count``; zeros lie outside of the input. Each output uses one branch of the filter."""
    taps = branches.shape[1]
    place = (first + np.arange(count)) * down
    phase, base = place % up, place // up
    low = int(base[0]) - taps + 1
    high = int(base[-1]) + 1
    inside = samples[max(0, low) : max(0, high)]
    piece = np.concatenate([np.zeros(max(0, -low)), inside, np.zeros(max(0, high - max(low, 0) - len(inside)))])
    windows = np.lib.stride_tricks.sliding_window_view(piece, taps)
    out = np.empty(count)
    for k in range(up):
        own = np.flatnonzero(phase == k)
        if len(own):
            out[own] = windows[base[own] - taps + 1 - low] @ branches[k]
    return out


def mel_filters(rate: float = RATE * UP / DOWN, mels: int = MELS) -> np.ndarray:
    """Triangles, evenly spaced on the mel scale, as (bins, mels)."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    edges = 700 * (10 ** (np.linspace(mel(LOW_HZ), mel(HIGH_HZ), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


class Features:
    def __init__(self):
        self.branches = lowpass()
        self.filters = mel_filters()
        self.window = np.hanning(WINDOW)

    def log_mels(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(frames, mels) as float32 and the frames' energies in decibels."""
        samples = np.frombuffer(data, np.uint8).astype(np.float64) / 128 - 1
        total = -(-len(samples) * UP // DOWN)
        frames = max(1, 1 + -(-max(0, total - WINDOW) // HOP))
        mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
        for start in range(0, frames, FRAMES_A_BLOCK):
            count = min(FRAMES_A_BLOCK, frames - start)
            piece = resample(samples, start * HOP, (count - 1) * HOP + WINDOW, self.branches)
            piece[max(0, total - start * HOP) :] = 0
            cut = np.lib.stride_tricks.sliding_window_view(piece, WINDOW)[::HOP]
            cut = (cut - cut.mean(axis=1, keepdims=True)) * self.window
            power = np.abs(np.fft.rfft(cut, FFT)) ** 2
            mels[start : start + count] = np.log(power @ self.filters + 1e-6)
            energy[start : start + count] = 10 * np.log10((cut**2).mean(axis=1) + 1e-9)
        return mels, energy


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans above the median energy by hysteresis."""
    level = float(np.median(energy))
    spans, first = [], None
    for k, value in enumerate(energy):
        if first is None and value >= level + OPEN_DB:
            first = k
        elif first is not None and value < level + CLOSE_DB:
            spans.append([first, k])
            first = None
    if first is not None:
        spans.append([first, len(energy)])
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and a - joined[-1][1] < BRIDGE:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    step = HOP / (RATE * UP / DOWN)
    return [(a * step, b * step) for a, b in joined if b - a >= SHORTEST]


def tensors(mels: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors with their time spans."""
    count = -(-len(mels) // FRAMES)
    full = np.zeros((count * FRAMES, MELS), np.float32)
    full[: len(mels)] = mels
    used = np.minimum(FRAMES, len(mels) - np.arange(count) * FRAMES)
    step, width = HOP / (RATE * UP / DOWN), WINDOW / (RATE * UP / DOWN)
    start = np.arange(count) * FRAMES * step
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), FRAMES * MELS)
    arrays = [pa.array(start), pa.array(start + (used - 1) * step + width), pa.array(used, pa.int32()), pa.ExtensionArray.from_storage(TENSOR, storage)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSORS) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=TENSORS))
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as an audio file."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), whole_text(text).alias("text"))

    def encode(batches):
        for batch in batches:
            made = [padded(t) for t in batch.column(1).to_pylist()]
            media = pa.array([wav(data) for data, _ in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(encode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def computed(batches):
    """Feature columns beside the stored ones, a few files at a time: features are some times as large as their media."""
    features = Features()
    kind = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            blobs, frames, spans = [], [], []
            for data in part.column("media").to_pylist():
                mels, energy = features.log_mels(wav_samples(data)[0])
                blobs.append(tensors(mels))
                frames.append(len(mels))
                spans.append([{"start_s": a, "end_s": b} for a, b in segments(energy)])
            arrays = [*part.columns, pa.array(blobs, pa.binary()), pa.array(frames, pa.int64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names, "tensors", "frames", "segments"])


def audio_features(media: DataFrame) -> DataFrame:
    """The rows of ``media`` with ``tensors``, ``frames`` and ``segments``."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields)
    return media.mapInArrow(computed, f"{own}, tensors binary, frames long, segments array<struct<start_s: double, end_s: double>>")


DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "n_segments"]


def digested(batches):
    """Payload, stored form and features of each row as digests, all from the bytes that were read back."""
    for batch in batches:
        out: list[list] = [[] for _ in DIGESTS]
        for row in batch.select(["media", "tensors", "frames", "segments"]).to_pylist():
            payload = wav_samples(row["media"])[0]
            spans = ";".join(f"{s['start_s']:.2f}-{s['end_s']:.2f}" for s in row["segments"])
            mels = read_tensors(row["tensors"]).column("log_mel").combine_chunks().storage.flatten().to_numpy()
            rounded = np.round(mels.astype(np.float64), 3) + 0.0
            feature = hashlib.sha256(rounded.tobytes() + spans.encode()).hexdigest()
            values = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(row["media"]),
                      hashlib.sha256(row["media"]).hexdigest(), f"{row['frames']}:{feature}", row["frames"], len(row["segments"]))
            for column, value in zip(out, values):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        arrays = [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(out, kinds)]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", *DIGESTS])


def digests(media: DataFrame) -> DataFrame:
    """Digests of stored media and their features, in one pass."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.mapInArrow(lambda batches: digested(computed(batches)), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, "
                            "tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, n_segments long")
