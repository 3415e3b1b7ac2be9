"""Media columns: chroma fingerprints of audio, and alignment of recordings.

Fingerprint. A recording (16-bit mono PCM) is cut into overlapping frames; the power of each
frame's spectrum is gathered by pitch class, smoothed over time and normalised. Sixteen filters,
each the difference of rectangle sums that an integral image gives at once, slide over the frames;
each yields two bits (Gray-coded level), so a position has one packed 32-bit integer.

Search. Equal fingerprints form a class first, so copies cost nothing further. Queries are taken in
blocks of bounded number and length, which go to every task; every two positions of a query and a
recording vote, with the bits in which they agree, for the offset between them. The histograms are
exact and hold every offset, so they give its bit error too; the offset of least error links the two
if it is low enough. Votes are counted through spectra, so a pair costs little more than its length.

Edge cases: null or too short recordings have no integers, share one class and link to nothing;
repeated rows stay; null ids never name a class; ties go to the offset nearest zero, then the
smaller. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import map_rows
from emberlog.runtime import materialize

RATE, FRAME, HOP = 4000, 1024, 512
LEAST_HZ, MOST_HZ = 55.0, 1760.0
SPAN = 12  # frames that a filter sees at most
#: (kind, lowest pitch class, height, frames) of each filter.
FILTERS = ((0, 0, 3, 12), (1, 0, 4, 12), (2, 3, 4, 10), (3, 2, 6, 8), (4, 0, 6, 12), (5, 4, 6, 9), (1, 4, 4, 8), (2, 7, 4, 12), (1, 8, 4, 10), (0, 5, 3, 6), (4, 6, 6, 9), (3, 6, 6, 12), (2, 0, 6, 6), (1, 2, 8, 12), (5, 0, 12, 12), (3, 0, 12, 10))
LEVELS = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
_WINDOW = np.hanning(FRAME)
_SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])


def _pitch_classes() -> np.ndarray:
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12))
    for k in np.flatnonzero((hz >= LEAST_HZ) & (hz <= MOST_HZ)):
        out[k, int(round(12 * np.log2(hz[k] / 440.0))) % 12] = 1.0
    return out


_CLASSES = _pitch_classes()


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12), each row of length one (or zero in silence)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(_SMOOTH):
        return np.zeros((0, 12))
    parts = []
    for begin in range(0, n, 4096):  # a slice of a long recording at a time
        stop = min(n, begin + 4096)
        part = np.asarray(samples[begin * HOP : (stop - 1) * HOP + FRAME], dtype=np.float64)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        parts.append((np.abs(np.fft.rfft(frames * _WINDOW, axis=1)) ** 2) @ _CLASSES)
    power = np.concatenate(parts)
    out = sum(w * power[k : n - len(_SMOOTH) + 1 + k] for k, w in enumerate(_SMOOTH))
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 1e-3)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One packed integer (uint32) for each position at which all filters fit."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint32)
    total = np.zeros((len(image) + 1, 13))
    np.cumsum(np.cumsum(image, axis=0), axis=1, out=total[1:, 1:])
    at = np.arange(n)

    def area(x0: int, x1: int, y0: int, y1: int) -> np.ndarray:
        """Sums over frames x0 to x1 (from each position) and pitch classes y0 to y1."""
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    out = np.zeros(n, dtype=np.uint32)
    for kind, y, high, wide in FILTERS:
        x2, x3, y2, y3 = wide // 2, wide // 3, high // 2, high // 3
        whole = area(0, wide, y, y + high)
        if kind == 0:
            plus, minus = whole, area(0, SPAN, 0, 12) * (wide * high / (SPAN * 12))
        elif kind == 1:
            plus, minus = area(0, wide, y + y2, y + high), area(0, wide, y, y + y2)
        elif kind == 2:
            plus, minus = area(x2, wide, y, y + high), area(0, x2, y, y + high)
        elif kind == 3:
            plus = area(0, x2, y + y2, y + high) + area(x2, wide, y, y + y2)
            minus = whole - plus
        elif kind == 4:
            plus = 2 * area(0, wide, y + y3, y + 2 * y3)
            minus = area(0, wide, y, y + 3 * y3) - plus / 2
        else:
            plus = 2 * area(x3, 2 * x3, y, y + high)
            minus = area(0, 3 * x3, y, y + high) - plus / 2
        value = np.log((1 + np.maximum(plus, 0)) / (1 + np.maximum(minus, 0)))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(LEVELS, np.round(value, 9))]
    return out


def samples_of(pcm: bytes | None) -> np.ndarray:
    """16-bit little-endian mono PCM; a cut last byte is ignored."""
    raw = pcm or b""
    return np.frombuffer(raw[: len(raw) // 2 * 2], dtype="<i2")


def melody(vector, note_s: float = 0.2) -> bytes:
    """A recording for a vector: one note for each number, its pitch by the number's size, as PCM."""
    values = np.array([0.0 if v is None else v for v in vector], dtype=np.float64)
    if not len(values):
        return b""
    values = np.nan_to_num(values)
    scale = float(np.sqrt(np.mean(values**2))) or 1.0
    step = np.clip(np.round(6 * values / scale), -18, 18)
    size = int(RATE * note_s)
    t = np.arange(size) / RATE
    hz = 330.0 * 2 ** (step / 12)
    tone = np.sin(2 * np.pi * hz[:, None] * t) + 0.4 * np.sin(4 * np.pi * hz[:, None] * t)
    shape = np.minimum(1.0, np.minimum(t, t[::-1]) * 50)
    return (tone * shape * 9000).astype("<i2").tobytes()


def _fingerprinted(media: DataFrame, id_col: str, pcm_of) -> DataFrame:
    def rows(batches):
        for batch in batches:
            made = [fingerprint(samples_of(pcm_of(v))).astype("<u4").tobytes() for v in batch.column(1).to_pylist()]
            digest = [hashlib.sha256(m).hexdigest() for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(m) // 4 for m in made], pa.int64()), pa.array(digest), pa.array(made, pa.binary())], ["id", "n_positions", "digest", "fingerprint"])

    kind = media.schema[media.columns[0]].dataType.simpleString()
    return map_rows(media.toDF("id", "media"), rows, f"id {kind}, n_positions long, digest string, fingerprint binary")


def fingerprints(media: DataFrame, id_col: str, pcm_col: str) -> DataFrame:
    """Rows (id, n_positions, digest, fingerprint) of a PCM column."""
    return _fingerprinted(media.select(F.col(f"`{id_col}`"), F.col(f"`{pcm_col}`")), id_col, lambda pcm: pcm)


def fingerprints_of_vectors(media: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The same for recordings made from vectors by `melody`; the sound exists for one row at a time."""
    return _fingerprinted(media.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`")), id_col, lambda v: melody(v) if v is not None else b"")


def spectrum_width(least: int) -> int:
    """The smallest even number from least on without prime factors above 5: spectra of such widths are quick."""
    width = max(2, least + least % 2)
    while True:
        rest = width
        for prime in (2, 3, 5):
            while rest % prime == 0:
                rest //= prime
        if rest == 1:
            return width
        width += 2


class Block:
    """Some queries, compared with recordings at every offset by offset histograms.

    Every two positions vote for the offset between them with the bits they agree in (less those they don't). All
    votes of a pair of recordings are one correlation of their bits, summed over the 32 filters' bits: a product of
    spectra. The histogram is exact (whole numbers), and with the overlap it gives each offset's bit error.

    Spectra wrap around. They are only as wide as keeps the offsets of enough overlap apart; those of less overlap fall
    on each other and are never read.
    """

    CELLS = 1 << 18  # query positions and offsets whose spectra are held at once, 128 bytes each
    BATCH = 32  # recordings that are compared at once
    NEAR = 1 << 18  # votes that are counted and read at once: 1 MB, so that they stay in a core's cache

    def __init__(self, queries: list[tuple[str, np.ndarray]]):
        self.names = [q for q, _ in queries]
        self.values = [v for _, v in queries]
        self.sizes = np.array([len(v) for v in self.values], dtype=np.int64)
        classes: dict[int, list[int]] = {}
        for k, n in enumerate(self.sizes.tolist()):
            if n:
                classes.setdefault(int(n - 1).bit_length(), []).append(k)
        self.classes = list(classes.values())
        self._kept: tuple = (None, None)

    @staticmethod
    def _spectra(values: list[np.ndarray], width: int) -> np.ndarray:
        """(frequencies, recordings, 32): of each bit as 1 or -1, zero beyond the end."""
        kind = np.float32 if width <= 4096 else np.float64  # sums must stay exact when rounded
        made = np.empty((width // 2 + 1, len(values), 32), dtype=np.complex64 if kind is np.float32 else np.complex128)
        for k, v in enumerate(values):
            bits = np.zeros((width, 32), dtype=kind)
            bits[: len(v)] = np.unpackbits(np.ascontiguousarray(v, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1) * kind(2) - kind(1)
            made[:, k] = np.fft.rfft(bits, axis=0)
        return made

    @staticmethod
    def _overlaps(sizes: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The offset of each of width places, and how many positions a query of each size has in common with n there."""
        offset = np.arange(width)
        offset = np.where(offset <= width - n, offset, offset - width)
        return offset, np.maximum(0, np.minimum(sizes[None, :], n + offset[:, None]) - np.maximum(0, offset[:, None]))

    def _compared(self, part: list[int], others: list[np.ndarray], width: int, max_error: float, least_overlap: int):
        """Arrays (other, query, error, distance, offset) of the offsets that qualify."""
        key = (width, tuple(part))
        if self._kept[0] != key:
            self._kept = (key, self._spectra([self.values[k] for k in part], width))
        spectra = np.ascontiguousarray(np.conj(self._spectra(others, width)).transpose(0, 2, 1))
        lengths = np.array([len(x) for x in others])
        sizes, kind = np.unique(self.sizes[part], return_inverse=True)
        limits = []
        for n in np.unique(lengths).tolist():
            offset, overlap = self._overlaps(sizes, n, width)
            least = np.maximum(1, np.minimum(least_overlap, np.minimum(sizes, n)))
            needed = np.where(overlap >= least, 32 * overlap * (1 - 2 * max_error) - 0.5, np.inf)
            limits.append((np.flatnonzero(lengths == n), offset, overlap, needed.astype(np.float32 if width <= 4096 else np.float64)))
        step = max(1, self.NEAR // (width * len(others)))
        for first in range(0, len(part), step):
            votes = np.fft.irfft(self._kept[1][:, first : first + step] @ spectra, width, axis=0)
            of = kind[first : first + step]
            for at, offset, overlap, needed in limits:
                chosen = votes if len(at) == len(others) else votes[:, :, at]
                o, q, k = np.unravel_index(np.flatnonzero(chosen >= needed[:, of, None]), chosen.shape)
                bits = 32 * overlap[o, of[q]]
                error = (bits - np.rint(chosen[o, q, k]).astype(np.int64)) // 2 / bits
                hit = error <= max_error
                o, q, k = o[hit], q[hit], k[hit]
                yield at[k], np.array(part)[first + q], error[hit], np.abs(offset[o]), offset[o]

    def aligned(self, others: list[np.ndarray], max_error: float, least_overlap: int) -> list[list[tuple[str, int, float]]]:
        """For each other recording (query, offset, bit error) of each query that it aligns with; it begins offset positions later in the query."""
        out: list[list] = [[] for _ in others]
        waiting: dict[int, list[int]] = {}
        for k, other in enumerate(others):
            if len(other):
                waiting.setdefault(int(len(other) - 1).bit_length(), []).append(k)
        for members in waiting.values():
            for group in self.classes:
                lengths = [len(others[k]) for k in members]
                shared = max(1, min(least_overlap, int(self.sizes[group].min()), min(lengths)))
                width = spectrum_width(int(self.sizes[group].max()) + max(lengths) - shared)
                step = max(1, self.CELLS // width)
                for first in range(0, len(group), step):
                    part = group[first : first + step]
                    batch = max(1, min(self.BATCH, self.BATCH * self.CELLS // (len(part) * width)))
                    for begin in range(0, len(members), batch):
                        at = np.array(members[begin : begin + batch])
                        found = list(self._compared(part, [others[k] for k in at], width, max_error, least_overlap))
                        k, q, error, far, offset = (np.concatenate(x) for x in zip(*found, strict=True))
                        order = np.lexsort((offset, far, error, q, k))
                        k, q, error, offset = k[order], q[order], error[order], offset[order]
                        best = np.ones(len(k), dtype=bool)
                        best[1:] = (k[1:] != k[:-1]) | (q[1:] != q[:-1])
                        for x, y, e, o in zip(at[k[best]].tolist(), q[best].tolist(), error[best].tolist(), offset[best].tolist(), strict=True):
                            out[x].append((self.names[y], o, e))
        return out


BLOCK_POSITIONS = 1 << 20  # integers of the queries that are searched with at once: 4 MB


def align(found: DataFrame, queries: DataFrame, max_error: float = 0.2, least_overlap: int = 24, block: int = 1024) -> DataFrame:
    """Rows (query, digest, offset, bit_error) between different classes.

    found: (digest, fingerprint), one row for each class. queries: the digests to search with, which pass through the
    driver one block at a time (of block recordings and BLOCK_POSITIONS integers at most, or one longer recording).
    """
    spark = found.sparkSession
    kept = found.join(queries.select("digest").distinct(), "digest", "left_semi").where(F.length("fingerprint") > 0)
    parts, held = [], []

    def search() -> None:
        shipped = spark.sparkContext.broadcast(Block(held.copy()))
        held.clear()

        def rows(batches):
            for batch in batches:
                digests = batch.column(0).to_pylist()
                told = shipped.value.aligned([np.frombuffer(f.as_buffer(), dtype="<u4") for f in batch.column(1)], max_error, least_overlap)
                out = [(q, d, o, e) for d, of in zip(digests, told, strict=True) for q, o, e in of if q != d]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["query", "digest", "offset", "bit_error"])

        parts.append(materialize(map_rows(found.select("digest", "fingerprint"), rows, "query string, digest string, offset long, bit_error double"), "alignments"))

    for r in kept.select("digest", "fingerprint").orderBy("digest").toLocalIterator():  # one block at a time on the driver
        values = np.frombuffer(bytes(r["fingerprint"]), dtype="<u4")
        if held and (len(held) == block or sum(len(v) for _, v in held) + len(values) > BLOCK_POSITIONS):
            search()
        held.append((r["digest"], values))
    if held or not parts:
        search()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def matched(found: DataFrame, every: int = 50, **options) -> DataFrame:
    """Per row of found: id, n_positions, class_id, is_query, n_links, match_id, match_offset, bit_error.

    Queries are the rows whose id is divisible by `every`, against all rows. Links run between
    classes, seen from both ends; the match is the link of least error (then nearest offset, then
    smallest class), as an id and the offset at which the match begins in this recording.
    """
    found = materialize(found, "fingerprints")
    classes = found.groupBy("digest").agg(F.min("id").alias("class_id"))
    one = found.join(classes.select("digest", F.col("class_id").alias("id")), ["digest", "id"], "left_semi").select("digest", "fingerprint").dropDuplicates(["digest"])
    one = materialize(one.join(classes, "digest"), "fingerprint-classes")
    links = align(one, found.where(F.col("id") % every == 0), **options)
    ends = links.select(F.col("query").alias("digest"), F.col("digest").alias("other"), F.col("offset").alias("at"), "bit_error").unionAll(
        links.select("digest", F.col("query").alias("other"), (-F.col("offset")).alias("at"), "bit_error")
    )
    # A pair of two queries is found from both sides.
    ends = ends.groupBy("digest", "other").agg(F.min(F.struct("bit_error", F.abs("at").alias("far"), "at")).alias("m"))
    named = ends.join(one.select(F.col("digest").alias("other"), F.col("class_id").alias("match_id")), "other")
    told = named.groupBy("digest").agg(F.count("*").alias("n_links"), F.min(F.struct("m.bit_error", "m.far", "match_id", "m.at")).alias("b"))
    told = materialize(one.select("digest", "class_id").join(told, "digest", "left"), "fingerprint-links")
    return found.join(told, "digest").select(
        "id", "n_positions", "class_id", F.coalesce(F.col("id") % every == 0, F.lit(False)).alias("is_query"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("b.match_id").alias("match_id"), F.col("b.at").alias("match_offset"), F.col("b.bit_error").alias("bit_error"),
    )
