"""Audio columns: 8-bit WAV media, polyphase resampling, log-mel tensors with time spans, energy segments."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, small_batches, written

#: Sampling rates in Hz of the media and of the features.
RATE, TARGET = 16_000, 8_000
#: Samples of a frame and from one frame to the next; points of its transform; mel bands; frames of a tensor.
FRAME, HOP, POINTS, MELS, FRAMES = 200, 100, 256, 24, 16
#: dB over a text's median energy at which a segment begins, and above which it goes on.
HIGH, LOW = 3.0, 1.0
#: Outputs that are computed at a time, so that a long recording needs little memory besides its samples.
BLOCK = 1 << 15
_UNIT = 64


def padded(data: bytes, unit: int = _UNIT) -> bytes:
    """data and bytes 0 up to a positive multiple of unit."""
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file whose unsigned 8-bit samples on one channel are the payload's bytes."""
    odd = len(payload) % 2
    return b"".join((b"RIFF", struct.pack("<I", 36 + len(payload) + odd), b"WAVEfmt ", struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8), b"data", struct.pack("<I", len(payload)), payload, b"\0" * odd))


def from_wav(media: bytes) -> tuple[int, bytes]:
    """Rate and sample bytes of an 8-bit mono WAV file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError("8-bit mono PCM only")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def _phases(up: int, down: int, half: int = 8) -> tuple[np.ndarray, ...]:
    """Taps of each phase of a Hann-windowed low-pass, with unit gain."""
    wide = half * max(up, down)
    t = np.arange(-wide, wide + 1)
    h = np.sinc(t / max(up, down)) * np.hanning(2 * wide + 3)[1:-1]
    out = []
    for p in range(up):
        taps = h[p::up]
        out.append((taps / taps.sum()).astype(np.float32))
    return tuple(out)


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """x at another rate by a polyphase filter: each output takes only the taps of its own phase, and only kept outputs are computed."""
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x.astype(np.float32)
    phases = _phases(up, down)
    k = max(map(len, phases))
    middle = (len(phases[0]) * up - up) // 2
    n = -(-len(x) * up // down)
    y = np.zeros(n, np.float32)
    before = k + 1
    xp = np.concatenate((np.zeros(before, np.float32), x.astype(np.float32), np.zeros(before + down, np.float32)))
    for r in range(min(up, n)):
        at = r * down + middle
        taps, first, count = phases[at % up], at // up + before, len(range(r, n, up))
        for i in range(0, count, BLOCK):
            m = min(BLOCK, count - i)
            part = np.zeros(m, np.float32)
            for j, w in enumerate(taps):
                a = first - j + i * down
                seg = xp[max(a, 0) : a + (m - 1) * down + 1 : down]
                part[: len(seg)] += w * seg
            y[r + i * up : r + (i + m) * up : up] = part
    return y


@lru_cache(maxsize=8)
def _mel(rate: int, points: int = POINTS, mels: int = MELS) -> np.ndarray:
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = hz(np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2))
    f = np.arange(points // 2 + 1) * rate / points
    up = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log10 mel energies of overlapped frames, the last padded with zeros, and each frame's energy in dB."""
    n = max(1, -(-max(0, len(y) - FRAME) // HOP) + 1)
    y = np.concatenate((y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)))
    window, bank = np.hanning(FRAME).astype(np.float32), _mel(rate)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    for i in range(0, n, 2048):
        frames = view[i : i + 2048] * window
        power = np.abs(np.fft.rfft(frames, POINTS, axis=1)).astype(np.float32) ** 2
        mel[i : i + 2048] = np.log10(power @ bank + np.float32(1e-6))
        energy[i : i + 2048] = 10 * np.log10((frames * frames).mean(axis=1) + np.float32(1e-6))
    return mel, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Runs [first, end) of frames above the lower bound that reach the upper one; both in dB over the median."""
    base = float(np.median(energy))
    over = np.concatenate(([0], (energy > base + low).astype(np.int8), [0]))
    change = np.diff(over)
    loud = np.concatenate(([0], np.cumsum(energy > base + high)))
    return [(int(a), int(b)) for a, b in zip(np.nonzero(change == 1)[0], np.nonzero(change == -1)[0], strict=True) if loud[b] > loud[a]]


_TENSOR = pa.fixed_shape_tensor(pa.float16(), (FRAMES, MELS))


def tensors(mel: np.ndarray, rate: int) -> bytes:
    """An Arrow stream: tensor (FRAMES x MELS half floats, the last padded with the floor), its frames, and its span in seconds."""
    n = -(-len(mel) // FRAMES)
    whole = np.full((n * FRAMES, MELS), -6, np.float16)
    whole[: len(mel)] = mel
    held = [min(FRAMES, len(mel) - i * FRAMES) for i in range(n)]
    start = [i * FRAMES * HOP / rate for i in range(n)]
    end = [s + ((h - 1) * HOP + FRAME) / rate for s, h in zip(start, held, strict=True)]
    column = pa.ExtensionArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(whole.ravel()), FRAMES * MELS))
    batch = pa.record_batch([column, pa.array(held, pa.int32()), pa.array(start), pa.array(end)], ["tensor", "frames", "start_s", "end_s"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """What tensors() wrote; its column tensor gives an (n, FRAMES, MELS) array by combine_chunks().to_numpy_ndarray()."""
    with pa.ipc.open_stream(stream) as r:
        return r.read_all()


_MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
_SPAN = T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
_FEATURES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("tensors", T.BinaryType()),
        T.StructField("segments", T.ArrayType(_SPAN)), T.StructField("n_frames", T.LongType()), T.StructField("feature", T.StringType()),
    ]
)
#: Rows of a batch that a worker returns at a time.
_ROWS = 256


def _encoded(batches):
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            ids, texts = b.column(0).slice(at, _ROWS), b.column(1).slice(at, _ROWS)
            raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in texts]
            yield pa.record_batch([ids.cast(pa.int64()), pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as UTF-8, padded and stored as the samples of a WAV file. Null text: empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded, _MEDIA)


def described(mel: np.ndarray, found: list[tuple[int, int]]) -> str:
    """Frames, segments, and the bands' means in hundredths."""
    means = np.rint(mel.mean(axis=0, dtype=np.float64) * 100).astype(int)
    return f"{len(mel)}f {len(found)}s {sum(b - a for a, b in found)}v " + ",".join(map(str, means.tolist()))


def _features(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("tensors", pa.binary()), ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), ("n_frames", pa.int64()), ("feature", pa.string())])
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            rows = []
            for doc_id, n_bytes, media in zip(*(b.column(i).slice(at, _ROWS).to_pylist() for i in range(3)), strict=True):
                rate, payload = from_wav(media)
                x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                mel, energy = log_mel(resample(x, rate, TARGET), TARGET)
                found = segments(energy)
                spans = [{"start_s": s * HOP / TARGET, "end_s": ((e - 1) * HOP + FRAME) / TARGET} for s, e in found]
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-_UNIT:]), len(media), hashlib.sha256(media).hexdigest(), tensors(mel, TARGET), spans, len(mel), described(mel, found)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def features(media: DataFrame) -> DataFrame:
    """One row per row of media (doc_id, n_bytes, media) with what its stored samples give: digests, tensors (an Arrow stream of
    fixed-shape log-mel tensors with time spans), segments in seconds, n_frames, and a short description.

    Equal media give equal values; ties and repeated rows are treated alike; media that are not 8-bit mono WAV stop the job. No rows, no rows.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)


def stored_features(docs: DataFrame) -> DataFrame:
    """features() of the documents' media, both written to tables in the shared folder and read back."""
    return written(features(written(media_table(docs), "media")), "features")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored_features(documents(spark, sf_dir))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", F.size("segments").alias("n_segments"), F.octet_length("tensors").alias("tensor_bytes"), F.crc32("tensors").alias("tensor_crc32"))
