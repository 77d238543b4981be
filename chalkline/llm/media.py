"""Media columns: payloads as 8-bit mono WAV files, read back by the wave module, with spectral-peak fingerprints.

A text's UTF-8 bytes, with bytes 0 up to a positive multiple of BLOCK, are the samples. The stored file is read with
the wave module; a short-time Fourier transform (Hann window, FRAME samples, HOP apart, so that a passage moved by any
number of blocks has the same frames; silence before the first and after the last sample fills those at the ends) gives a peak for each band of
BANDS and frame that stands out; each peak is paired with the next PAIRS peaks within SPAN frames, as a time-coded
number: frame << 24 | first bin << 16 | second bin << 8 | frames between. Where no peak has a later one, peaks of one frame are
paired, with no frames between.

Null texts count as empty and give one block of silence, without peaks; equal texts give equal values; repeated rows
are repeated; an empty table gives an empty table; other columns are left out. Long payloads are transformed in
pieces of PIECE frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm.common import bounded_batches, id_and_text

BLOCK, RATE = 64, 8000
FRAME, HOP = 256, BLOCK
#: Ends of the bands of bins in which a frame's peak is looked for.
BANDS = (1, 16, 48, 128)
PAIRS, SPAN, PIECE = 2, 128, 4096
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_peaks long, landmarks array<long>"
)


def payload_of(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (BLOCK if not data else 0))


def stored(payload: bytes) -> bytes:
    """The payload as a WAV file's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks_of(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the spectral peaks of 8-bit samples."""
    frames, bins = [], []
    samples = np.pad(samples, (FRAME - HOP, 0), constant_values=128)  # silence, so every sample is in FRAME / HOP frames
    count = max(1, -(-len(samples) // HOP))
    window = np.hanning(FRAME).astype(np.float32)
    for k in range(0, count, PIECE):
        piece = samples[k * HOP : (min(count, k + PIECE) - 1) * HOP + FRAME].astype(np.float32) - 128
        n = min(count, k + PIECE) - k
        piece = np.pad(piece, (0, (n - 1) * HOP + FRAME - len(piece)))
        power = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(piece, FRAME)[::HOP] * window, axis=1))
        for low, high in zip(BANDS, BANDS[1:]):
            band = power[:, low:high]
            best = band.argmax(1)
            top = band[np.arange(n), best]
            ok = np.flatnonzero((top > 2 * band.mean(1)) & (top > 1))
            frames.append(ok + k)
            bins.append(best[ok] + low)
    frames, bins = np.concatenate(frames), np.concatenate(bins)
    order = np.lexsort((bins, frames))
    return frames[order].astype(np.int64), bins[order].astype(np.int64)


def landmarks_of(frames: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Time-coded pairs of a peak and each of the next PAIRS later ones within SPAN frames."""
    out = []
    following = np.searchsorted(frames, frames, "right")
    for step in range(PAIRS):
        other = following + step
        i = np.flatnonzero(other < len(frames))
        j = other[i]
        near = frames[j] - frames[i] <= SPAN
        i, j = i[near], j[near]
        out.append(frames[i] << 24 | bins[i] << 16 | bins[j] << 8 | (frames[j] - frames[i]))
    if not any(map(len, out)):
        i = np.flatnonzero(frames[1:] == frames[:-1])
        out.append(frames[i] << 24 | bins[i] << 16 | bins[i + 1] << 8)
    return np.sort(np.concatenate(out))


def media_row(data: bytes | None) -> tuple:
    data = data or b""
    payload = payload_of(data)
    media = stored(payload)
    again = read_back(media)
    frames, bins = peaks_of(np.frombuffer(again, np.uint8))
    marks = landmarks_of(frames, bins)
    feature = hashlib.sha256(marks.astype("<i8").tobytes()).hexdigest()
    return len(data), len(again), hashlib.sha256(again).hexdigest(), zlib.crc32(again[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(frames)}:{len(marks)}:{feature}", len(frames), marks, media


def _media_batches(keep_media: bool):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_peaks", "landmarks", "media"]
        kept = len(names) - (not keep_media)
        for batch in batches:
            columns = list(zip(*map(media_row, batch.column(1).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns[:kept], kinds))], ["doc_id", *names[:kept]])

    return run


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, the stored file (media), its sizes and digests, feature and landmarks for every row of docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(_media_batches(keep_media), SCHEMA + ", media binary" * keep_media)


def media_index(media: DataFrame) -> DataFrame:
    """doc_id, frame and pair (landmark without its time) of every landmark, for lookups by pair."""
    marks = media.select("doc_id", F.explode("landmarks").alias("mark"))
    return marks.select("doc_id", F.shiftright("mark", 24).alias("frame"), F.col("mark").bitwiseAND(F.lit((1 << 24) - 1)).cast("int").alias("pair"))
