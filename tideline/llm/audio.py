"""Media columns: audio stored as 8-bit PCM, with log-mel features and time spans.

A payload becomes a RIFF/WAVE file of unsigned 8-bit mono samples; the file lies in a
binary Parquet column.  Reading takes the samples back, resamples them with a polyphase
windowed-sinc filter (``UP``/``DOWN``), cuts overlapped Hann frames, and takes log-mel
energies.  Frames are segmented by energy with hysteresis: a segment begins where energy
rises above the upper threshold and ends where it falls below the lower.  Features are
windows of ``FRAMES`` x ``MELS`` values, zero-padded at the end: each has the same shape,
so a column of them is a fixed-shape Arrow tensor (``as_tensors``), with its time span.
``store_features`` writes media, tensors and time spans to one Parquet table; Parquet has
no fixed-shape lists, so a document's tensors lie in a binary cell, an Arrow stream that
names their type and shape.  ``digest`` takes the features from the cells read back.

Samples are filtered, framed and transformed in blocks, so memory follows the block and
the features, not the length of the file.  Null and empty texts become 64 bytes of 0.
Repeated documents each get their row; equal texts give equal values.  An empty table
gives an empty table.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices

UNIT, RATE = 64, 16_000
UP, DOWN, TAPS = 2, 5, 16  # 16 kHz to 6.4 kHz; taps a sample of the lower rate
FRAME, HOP, FFT, MELS, FRAMES = 200, 80, 256, 20, 64
RISE, FALL = 6.0, 3.0  # dB over the floor, which is the 10th percentile of frame energies
BLOCK = 2_048  # frames transformed at once
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, media binary, n_frames long, spans array<struct<start:double,end:double>>, window_spans array<struct<start:double,end:double>>, tensors array<array<float>>"
STORED = FEATURES.replace("array<array<float>>", "binary")
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=("frame", "mel"))
SPANS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    """A RIFF/WAVE file of 8-bit mono samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wave(media: bytes) -> tuple[memoryview, int]:
    """The samples and their rate."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", view, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono samples are read")
        elif name == b"data":
            return view[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("the file has no samples")


def _phases() -> np.ndarray:
    """The windowed-sinc low-pass filter, one row for each phase."""
    n = TAPS * max(UP, DOWN) - 1  # odd, so that the delay is a whole number of samples
    h = np.sinc((np.arange(n) - n // 2) / max(UP, DOWN)) * np.hamming(n)
    h = np.append(h * UP / h.sum(), np.zeros(-n % UP))
    return np.stack([h[p::UP] for p in range(UP)])


_BANK = _phases()


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN times its rate; the filter's delay is taken off at the start."""
    n_out = -(-len(x) * UP // DOWN)
    width, delay = _BANK.shape[1], (TAPS * max(UP, DOWN) - 1) // 2
    padded = np.concatenate([np.zeros(width, np.float32), x, np.zeros(width + DOWN, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.zeros(n_out, np.float32)
    for phase in range(UP):
        # outputs phase, phase + UP, ... take one phase of the filter, and inputs DOWN apart
        n = len(range(phase, n_out, UP))
        at = phase * DOWN + delay
        taps = _BANK[at % UP][::-1].astype(np.float32)
        for lo in range(0, n, 1 << 14):
            hi = min(lo + (1 << 14), n)
            first = at // UP + 1 + lo * DOWN
            out[phase + lo * UP : phase + (hi - 1) * UP + 1 : UP] = windows[first : first + (hi - lo - 1) * DOWN + 1 : DOWN] @ taps
    return out


def _mel_bank(rate: float) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    lo, mid, hi = points[:-2], points[1:-1], points[2:]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).astype(np.float32)


_MEL: dict[float, np.ndarray] = {}
_HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(samples: memoryview, rate: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Log-mel energies of all frames, the energy of each in dB, and the frames' rate a second."""
    out_rate = rate * UP / DOWN
    bank = _MEL.setdefault(out_rate, _mel_bank(out_rate))
    raw = np.frombuffer(samples, np.uint8)
    n = -(-len(raw) * UP // DOWN)
    n_frames = 1 + max(0, n - FRAME + HOP - 1) // HOP
    mels, energy = np.zeros((n_frames, MELS), np.float32), np.zeros(n_frames, np.float32)
    margin = 4 * TAPS * DOWN
    for at in range(0, n_frames, BLOCK):
        to = min(at + BLOCK, n_frames)
        first, last = at * HOP, (to - 1) * HOP + FRAME
        lo = max(0, first * DOWN // UP - margin) // DOWN * DOWN
        x = raw[lo : last * DOWN // UP + margin].astype(np.float32) / 128 - 1
        y = resample(x)[first - lo * UP // DOWN :][: last - first]
        y = np.concatenate([y, np.zeros(last - first - len(y), np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
        power = np.abs(np.fft.rfft(frames * _HANN, FFT)).astype(np.float32) ** 2
        mels[at:to] = np.log(power @ bank + 1e-6)
        energy[at:to] = 10 * np.log10((frames**2).mean(1) + 1e-8)
    return mels, energy, out_rate / HOP


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frames [start, end) of the segments, by two thresholds over the floor."""
    floor = np.percentile(energy, 10)
    high, low = energy >= floor + RISE, energy < floor + FALL
    state = np.where(high, 1, np.where(low, 0, -1))  # -1: as before
    known = np.where(state >= 0, np.arange(len(state)), -1)
    np.maximum.accumulate(known, out=known)
    on = np.concatenate([[False], (known >= 0) & (state[np.maximum(known, 0)] == 1), [False]])
    step = np.diff(on.astype(np.int8))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()))


def windows(mels: np.ndarray) -> np.ndarray:
    """The frames in windows of FRAMES x MELS, the last padded with 0."""
    n = -(-len(mels) // FRAMES)
    out = np.zeros((n, FRAMES, MELS), np.float32)
    out.reshape(-1, MELS)[: len(mels)] = mels
    return out


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        media = [to_wave(r + bytes(-len(r) % UNIT if r else UNIT)) for r in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def store_media(docs: DataFrame, scratch: Scratch, name: str = "media") -> DataFrame:
    """The whole text of each document as a media column, written to Parquet and read back."""
    return scratch.keep(map_arrow(_texts(docs), _encode, MEDIA), name, compression="zstd")


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, size = 0, 0
        for i, media in enumerate(batch.column("media")):
            size += media.as_buffer().size
            if size >= most:
                yield batch.slice(at, i + 1 - at)
                at, size = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def _extract(batches: Iterator[pa.RecordBatch], tensors_of, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for piece in _pieces(batches):
        counts, spans, window_spans, tensors = [], [], [], []
        for stored in piece.column("media"):
            mels, energy, rate = log_mel(*from_wave(stored.as_buffer()))
            w = windows(mels)
            counts.append(len(mels))
            spans.append([{"start": a / rate, "end": b / rate} for a, b in segments(energy)])
            window_spans.append([{"start": i * FRAMES / rate, "end": min((i + 1) * FRAMES, len(mels)) / rate} for i in range(len(w))])
            tensors.append(tensors_of(w))
        columns = [*map(piece.column, ("doc_id", "n_bytes", "media")), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(window_spans, SPANS), pa.array(tensors, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "media", "n_frames", "spans", "window_spans", "tensors"])


def _extract_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _extract(batches, lambda w: to_cell(as_tensors(pa.array([w.reshape(-1)], pa.list_(pa.float32())))), pa.binary())


def extract_features(media: DataFrame) -> DataFrame:
    """The media with their segments' time spans and feature windows, each FRAMES*MELS values with its own span."""
    return map_arrow(media, lambda batches: _extract(batches, lambda w: list(w.reshape(len(w), -1)), pa.list_(pa.list_(pa.float32()))), FEATURES)


def store_features(docs: DataFrame, scratch: Scratch, name: str = "features") -> DataFrame:
    """The media of whole texts with fixed-shape tensors and time spans, written to one Parquet table and read back."""
    return scratch.keep(map_arrow(_texts(docs), lambda batches: _extract_cells(_encode(batches)), STORED), name, compression="zstd")


def as_tensors(lists: pa.Array) -> pa.ExtensionArray:
    """A column of feature windows, as read from ``tensors`` (one list level off), as a fixed-shape Arrow tensor array."""
    return pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(lists.flatten(), FRAMES * MELS))


def to_cell(tensors: pa.ExtensionArray) -> bytes:
    """A fixed-shape tensor array as an Arrow stream."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([tensors], names=["tensor"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_cell(cell: bytes | pa.Buffer) -> pa.ExtensionArray:
    """The fixed-shape tensor array of a stored cell."""
    tensors = pa.ipc.open_stream(cell).read_next_batch().column(0)
    if tensors.type != TENSOR:
        raise ValueError(f"the cell holds {tensors.type}, not {TENSOR}")
    return tensors


def digest(media: DataFrame) -> DataFrame:
    """What was stored of each document, as read back, and its stored features in short.

    ``feature``: frames, windows, segments, seconds in segments and the mean of each mel band.
    Media without features get theirs first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            out = []
            for doc_id, n_bytes, stored, n_frames, spans, cell in zip(*(piece.column(c) for c in ("doc_id", "n_bytes", "media", "n_frames", "spans", "tensors"))):
                stored, n = stored.as_buffer(), n_frames.as_py()
                samples, spans, tensors = from_wave(stored)[0], spans.as_py(), from_cell(cell.as_buffer())
                mean = tensors.storage.flatten().to_numpy().reshape(-1, MELS)[:n].mean(0, dtype=np.float64)
                seconds = sum(x["end"] - x["start"] for x in spans)
                feature = f"{n}|{len(tensors)}|{len(spans)}|{seconds:.2f}|" + ",".join(f"{v:.2f}" for v in mean)
                out.append((doc_id.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), stored.size, hashlib.sha256(stored).hexdigest(), feature))
            i, s = pa.int64(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), (i, i, i, s, i, i, s, s))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    stored = media if "tensors" in media.columns else map_arrow(media, _extract_cells, STORED)
    return map_arrow(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
