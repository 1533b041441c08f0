"""Signals as rows and arrays, with Spark's own functions: resampling, fitting, mirroring, spectrograms.

* ``resampled`` is a band join of output times with input samples: each sample is sent to the few outputs whose window it lies in, and weighted
  sums meet by output. No sample is compared with others, samples needn't be evenly spaced, and sums are partial before the shuffle, so a signal may have most of all rows.
* ``spectra`` makes a row of each of the overlapping frames of a row's samples, and its bins' powers are summed into bands by a sparse bank of fixed size, where the frame stands. Nothing is shuffled.
  Python gets a signal in pieces of about ``PIECE`` samples, so its memory depends neither on the signals' lengths nor on how many a task reads. The samples may be an array of numbers or the bytes of an 8-bit sound.

Defined cases: null samples, times and values have no part in anything; an output no sample reaches has no row; a signal without samples has no frame, a shorter one than half a frame is
continued by its mirror images again and again; equal rows count each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.operators.dsp import CUTOFF, FLOOR, hz, mel

# The terms of a four-term Blackman-Harris window.
_WINDOW = (0.35875, 0.48829, 0.14128, 0.01168)


def blackman_harris(x: Column) -> Column:
    """The window over [-1, 1], 0 outside."""
    inside = sum((F.lit(a) * F.cos(k * math.pi * (x + 1)) * (-1) ** k for k, a in enumerate(_WINDOW)), F.lit(0.0))
    return F.when(F.abs(x) <= 1, inside).otherwise(0.0)


def windowed_sinc(d: Column, half: int, scale: float) -> Column:
    """The weight of a sample d samples away from the output."""
    x = d * scale * math.pi
    return scale * F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(x) / x) * blackman_harris(d / half)


def reached(time: Column, step: float, half_width: float) -> Column:
    """The numbers of the outputs at 0, step, 2 step, ... that are within half_width of a sample's time."""
    first, last = F.greatest(F.ceil((time - half_width) / step), F.lit(0)), F.floor((time + half_width) / step)
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def resampled(samples: DataFrame, signal: list[str], time: str, value: str, step: float, half_width: float, weight) -> DataFrame:
    """``signal``, k (the output at k step), total (sum of weight x value), weight (sum of weights) and n, the samples in reach. weight: of the distance output - sample."""
    near = samples.filter(F.col(time).isNotNull() & F.col(value).isNotNull()).select(*signal, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_x"))
    near = near.select("*", F.explode(reached(F.col("_t"), step, half_width)).alias("k")).withColumn("_w", weight(F.col("k") * step - F.col("_t")))
    return near.groupBy(*signal, "k").agg(F.sum(F.col("_w") * F.col("_x")).alias("total"), F.sum("_w").alias("weight"), F.count(F.lit(1)).alias("n"))


def resampled_arrays(rows: DataFrame, id_cols: list[str], samples: str, rate: int, to: int, taps: int) -> DataFrame:
    """``id_cols``, k and value: the samples of each row at rate ``to``, floor(n to / rate) of them, by a windowed sinc of so many taps.

    Equal to ``dsp.resample`` up to rounding, but for rates that are alike, which it leaves as they are.
    """
    scale, half = min(1.0, to / rate) * CUTOFF, taps // 2
    numbered = rows.withColumns({"_row": F.monotonically_increasing_id(), "_n": F.size(samples)})
    single = numbered.select(*id_cols, "_row", "_n", F.posexplode(samples).alias("_i", "_v"))
    out = resampled(single, [*id_cols, "_row", "_n"], "_i", "_v", rate / to, half, lambda d: windowed_sinc(d, half, scale))
    return out.filter(F.col("k") < F.floor(F.col("_n") * to / rate)).select(*id_cols, "k", F.col("total").alias("value"))


def fitted(samples: Column, n: int) -> Column:
    """Exactly n samples: the middle of a longer signal, a shorter one repeated; null for one without samples."""
    size = F.size(samples)
    start = F.when(size >= n, F.floor((size - n) / 2)).otherwise(0)
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.get(samples, ((j + start) % size).cast("int"))))


def _mirrored(i: Column, size: Column) -> Column:
    """The place, in a signal of that size, of place i in the signal continued by its mirror images, ends not repeated."""
    period = F.greatest(2 * size - 2, F.lit(1))
    at = F.pmod(i, period)
    return F.least(at, period - at)


def reflected(samples: Column, pad: int) -> Column:
    """The signal with ``pad`` mirrored samples before and after it."""
    size = F.size(samples)
    return F.when(size > 0, F.transform(F.sequence(F.lit(-pad), size - 1 + pad), lambda i: F.get(samples, _mirrored(i, size).cast("int"))))


def bank_table(bands: int, fft: int, rate: int, low: float, high: float) -> list[list[tuple[int, float]]]:
    """Of each band (bin, weight): triangles between equal steps of the mel scale, each of the same area."""
    edges = hz(np.linspace(mel(low), mel(high), bands + 2))
    bins = np.arange(fft // 2 + 1) * rate / fft
    out = []
    for a, b, c in zip(edges, edges[1:], edges[2:], strict=False):
        w = np.maximum(0, np.minimum((bins - a) / (b - a), (c - bins) / (c - b))) * 2 / (c - a)
        out.append([(int(k), float(w[k])) for k in np.flatnonzero(w)])
    return out


PIECE = 4096
AT_ONCE = 1 << 17  # samples of the frames that are in memory at a time


def _bands(fft: int, hop: int, bank: list[list[tuple[int, float]]], per: int):
    """A row a frame: the power in each band, in decibels. A row of the batches is a piece: n, the samples of its signal, the first of its frames, at most ``per``, and the place of its first sample."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    most = max(per, AT_ONCE // fft)

    def samples_of(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All samples, and how many each piece has."""
        if pa.types.is_binary(pieces.type):
            x = np.frombuffer(b"".join(pieces.to_pylist()), np.uint8)
            return (x.astype(np.float64) - 128) / 128, pa.compute.binary_length(pieces).to_numpy()
        return pieces.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pa.compute.list_value_length(pieces).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, place = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3))
            frames = np.minimum(n // hop + 1 - first, per)
            edges = np.flatnonzero(np.diff((np.cumsum(frames) - 1) // most, prepend=-1))
            for begin, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                x, lengths = samples_of(batch.column(4).slice(begin, end - begin))
                k = frames[begin:end]
                of = np.repeat(np.arange(begin, end), k)
                frame = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
                period = np.maximum(2 * n[of] - 2, 1)[:, None]
                places = (frame[:, None] * hop + np.arange(fft) - fft // 2) % period
                places = np.minimum(places, period - places) + np.repeat(np.cumsum(lengths) - lengths - place[begin:end], k)[:, None]
                spectrum = np.fft.rfft(x[places] * window, axis=1)
                power = spectrum.real**2 + spectrum.imag**2
                bands = np.zeros((len(of), len(bank)))
                for b, weights in enumerate(bank):
                    for bin_, w in weights:
                        bands[:, b] += power[:, bin_] * w
                values = pa.array(10 * np.log10(np.maximum(bands, FLOOR)).ravel())
                offsets = pa.array(np.arange(len(of) + 1) * len(bank), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(frame), pa.ListArray.from_arrays(offsets, values)], ["row", "frame", "bands"])

    return run


def pieces(rows: DataFrame, id_cols: list[str], samples: str, fft: int, hop: int, per: int) -> DataFrame:
    """row (the ids), n (samples of the whole signal), first (frame), place (of the first sample) and piece: the samples that so many frames and their mirror images need."""
    binary = rows.schema[samples].dataType == T.BinaryType()
    x = rows.select(F.struct(*id_cols).alias("row"), (F.col(samples) if binary else F.array_compact(samples)).alias("x"))
    n = (F.octet_length if binary else F.size)("x")
    cut = F.substring if binary else F.slice

    def piece(c: Column) -> Column:
        low = F.greatest(c * (per * hop) - fft, F.lit(0))
        high = F.least((c + 1) * (per * hop) + fft, n)
        return F.struct((c * per).alias("first"), low.alias("place"), cut("x", low + 1, high - low).alias("piece"))

    # one select: the signal is made once, not once a piece
    return x.select("row", n.alias("n"), F.when(n > 0, F.transform(F.sequence(F.lit(0), F.expr(f"int({'octet_length' if binary else 'size'}(x) div {hop} div {per})")), piece)).alias("pieces")).select("row", "n", F.inline("pieces"))


def spectra(rows: DataFrame, id_cols: list[str], samples: str, fft: int, hop: int, bank: list[list[tuple[int, float]]]) -> DataFrame:
    """``id_cols``, frame (from 0; 1 + floor(n / hop) of n samples) and bands: the power in each band of the bank around every hop-th sample, in decibels."""
    per = max(1, min(PIECE, AT_ONCE // fft * hop) // hop)
    cut = pieces(rows, id_cols, samples, fft, hop, per)
    bands = cut.mapInArrow(_bands(fft, hop, bank, per), f"row {cut.schema['row'].dataType.simpleString()}, frame long, bands array<double>")
    return bands.select("row.*", "frame", "bands")
