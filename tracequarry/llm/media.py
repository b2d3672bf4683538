"""Audio features of byte payloads held as 8-bit mono samples.

A payload is stored as an 8-bit PCM WAV file (lossless), read back, resampled
by a polyphase filter, cut into overlapping frames for a log-mel filterbank,
and segmented by an energy gate with two levels (hysteresis). The mel frames
are kept as fixed-shape Arrow tensors of (FRAMES, MELS), zero-padded at the end
of a file, with the time span each covers.

Defined cases: a null text is empty; a payload is padded with zero bytes to a
positive multiple of 64, so the empty text is 64 zero bytes; every value is a
function of the text alone, so equal texts and repeated rows agree; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import rows, table, texts

BLOCK, RATE = 64, 16_000
#: Polyphase factors (16 kHz to 10 kHz), zero crossings of the filter, frame and hop in resampled samples, mel bands, frames in a tensor.
UP, DOWN, TAPS, FRAME, HOP, MELS, FRAMES = 5, 8, 16, 400, 160, 20, 32
#: Energy gate in dB below the loudest frame: a segment opens above the first and closes under the second.
OPEN_DB, CLOSE_DB = -3.0, -6.0
#: Samples worked on at a time, so a very long payload needs bounded memory.
CHUNK = 1 << 20


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


@lru_cache
def _phases(up: int = UP, down: int = DOWN) -> np.ndarray:
    """Windowed-sinc low pass: for each of ``up`` phases the taps on the inputs around an output that lies phase / up after one of them."""
    reach = -(-TAPS * max(up, down) // (2 * up))
    ahead = np.arange(up)[:, None] / up + reach - np.arange(2 * reach + 1)  # from the input to the output, in input samples
    h = np.sinc(ahead * min(1.0, up / down)) * (0.54 + 0.46 * np.cos(np.pi * ahead / (reach + 1)))
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


@lru_cache
def _mel() -> np.ndarray:
    """Triangular bands, evenly spaced on the mel scale, as a (bins, MELS) matrix."""
    top = RATE * UP / DOWN / 2
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase: output k takes the taps of phase ``k * down % up`` around input ``k * down // up``; silence lies beyond both ends."""
    phases = _phases(up, down)
    width = phases.shape[1]
    padded = np.pad(samples, (width // 2, width))
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for p in range(min(up, n)):
        k = np.arange(p, n, up)
        phase, start = (p * down) % up, (p * down) // up
        out[k] = np.einsum("ij,j->i", windows[start::down][: len(k)], phases[phase])
    return out


def log_mel(signal: np.ndarray) -> np.ndarray:
    """Overlapped frames to (n_frames, MELS); the signal is zero-padded at its end, so that its last samples lie in a frame."""
    whole = FRAME + -(-max(0, len(signal) - FRAME) // HOP) * HOP
    signal = np.pad(signal, (0, whole - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = []
    for k in range(0, len(frames), CHUNK // FRAME):
        spectrum = np.fft.rfft(frames[k : k + CHUNK // FRAME] * window)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        out.append(np.log(np.einsum("ij,jk->ik", power, _mel(), optimize=False) + 1e-6))
    return np.concatenate(out).astype(np.float32)


def segments(mel: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) frames of the segments: open above OPEN_DB, closed under CLOSE_DB of the loudest frame's energy."""
    energy = 10 * np.log10(np.exp(mel).sum(1) + 1e-9)
    level = energy - energy.max()
    # +1 opens, -1 closes, 0 keeps the state: the last non-zero mark rules.
    mark = np.where(level >= OPEN_DB, 1, np.where(level < CLOSE_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) == 1
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(samples))
    return mel, segments(mel)


def tensors(mel: np.ndarray) -> tuple[pa.Array, list[tuple[float, float]]]:
    """Fixed-shape (FRAMES, MELS) tensors of a file and the seconds that each spans."""
    n = -(-len(mel) // FRAMES)
    padded = np.zeros((n * FRAMES, MELS), np.float32)
    padded[: len(mel)] = mel
    step = HOP * DOWN / UP / RATE
    spans = [(k * FRAMES * step, (min((k + 1) * FRAMES, len(mel)) - 1) * step + FRAME * DOWN / UP / RATE) for k in range(n)]
    return pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, FRAMES, MELS)), spans


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_segments long"


def audio_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Digests and a feature summary for each row; with ``with_media`` also the stored bytes, the tensors and their spans.

    Tensors cross into Spark as the storage of their Arrow type, arrays of
    FRAMES * MELS floats, row-major.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    if with_media:
        schema += ", media binary, mel array<array<float>>, spans array<struct<start:double,end:double>>, segments array<struct<start:double,end:double>>"
    step = HOP * DOWN / UP / RATE

    def run(batches):
        for whole in batches:
            for batch in rows(whole, limit=8 << 20, name="t"):
                out: list[list] = [[] for _ in range(13 if with_media else 9)]
                for text in texts(batch, "t"):
                    stored = store(text + bytes(-len(text) % BLOCK or (0 if text else BLOCK)))
                    payload = load(stored)
                    mel, gates = features(payload)
                    tensor, spans = tensors(mel)
                    mel = tensor.to_numpy_ndarray().reshape(-1, MELS)[: len(mel)]
                    means = np.round(mel.mean(0, dtype=np.float64), 3)
                    active = sum(b - a for a, b in gates) / len(mel)
                    summary = f"frames={len(mel)};tensors={len(spans)};seconds={spans[-1][1]:.4f};segments={len(gates)};active={active:.4f};mel=" + ",".join(f"{x:.3f}" for x in means)
                    got = [len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), summary, len(mel), len(gates)]
                    if with_media:
                        got += [stored, tensor.storage.to_pylist(), [{"start": a, "end": b} for a, b in spans], [{"start": a * step, "end": b * step} for a, b in gates]]
                    for column, x in zip(out, got, strict=True):
                        column.append(x)
                span = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.list_(pa.float32())), span, span]
                names = [id_col, *(x.split()[0] for x in SCHEMA.split(", ")), "media", "mel", "spans", "segments"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=False))], names[: len(out) + 1])

    return docs.selectExpr(f"`{id_col}`", f"cast(`{text_col}` as string) t").mapInArrow(run, schema)


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_columns(table(spark, sf_dir, "documents"), with_media=False)
