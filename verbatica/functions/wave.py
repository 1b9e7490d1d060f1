"""Waveform analytics on arrays of samples, as Column expressions.

Samples are read as doubles; squares are summed in order. A null or empty waveform is silence of no length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

# The limits below and in the defaults of the functions (seconds, decibels, milliseconds, levels).
USABLE_SECONDS = 0.05


def samples(c: Column) -> Column:
    return F.coalesce(c.cast("array<double>"), F.array().cast("array<double>"))


def mono(channels: Column) -> Column:
    """Mean over the channels of a nested array: over its first level when that has at most 8 entries and is the
    shorter one, else over its second."""
    rows, cols = F.size(channels), F.size(F.coalesce(F.try_element_at(channels, F.lit(1)), F.array().cast("array<double>")))
    over_rows = F.transform(F.sequence(F.lit(1), F.greatest(cols, F.lit(1))), lambda i: mean(F.transform(channels, lambda ch: F.try_element_at(ch, i))))
    return F.when((rows <= 8) & (rows < cols), over_rows).otherwise(F.transform(channels, mean))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def rms(a: Column) -> Column:
    """Root of the mean square; 0 for nothing."""
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) / F.size(a))).otherwise(0.0)


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, F.abs)), F.lit(0.0))


def seconds(a: Column, sampling_rate: Column) -> Column:
    return F.when(sampling_rate > 0, F.size(a) / sampling_rate).otherwise(0.0)


def peak_normalize(a: Column, target: float = 0.95) -> Column:
    """Scaled to a peak of ``target``; silence stays as it is."""
    return bind(peak(a), lambda p: F.when(p > 0, F.transform(a, lambda x: x / p * target)).otherwise(a))


def share(a: Column, holds) -> Column:
    """The part of the entries for which a condition holds; 0 for nothing."""
    return F.when(F.size(a) > 0, F.size(F.filter(a, holds)) / F.size(a)).otherwise(0.0)


def _first_last(a: Column, holds) -> tuple[Column, Column]:
    """1-based positions of the first and last entry for which a condition holds; null if there is none."""
    at = F.filter(F.transform(a, lambda x, i: F.when(holds(x), i + 1)), lambda i: i.isNotNull())
    return F.try_element_at(at, F.lit(1)), F.try_element_at(at, F.lit(-1))


def light_trim(a: Column, threshold: float = 1e-4, pad: int = 1600) -> Column:
    """Cut to the samples above a threshold and ``pad`` on either side; kept whole without any."""
    first, last = _first_last(a, lambda x: F.abs(x) > threshold)
    start = F.greatest(first - pad, F.lit(1))
    return F.when(first.isNull(), a).otherwise(F.slice(a, start, F.least(last + pad, F.size(a)) - start + 1))


def frame_size(sampling_rate: Column, ms: float) -> Column:
    return F.greatest(F.lit(1), F.floor(sampling_rate * ms / 1000.0).cast("int"))


def frame_rms(a: Column, frame: Column, hop: Column | None = None) -> Column:
    """RMS of every whole frame, one behind the other or ``hop`` apart; of the whole if it is shorter than a frame."""
    hop = frame if hop is None else hop

    def frames(w: Column) -> Column:
        x, size = w["a"], w["frame"]
        starts = F.sequence(F.lit(1), F.size(x) - size + 1, hop)
        return F.when(F.size(x) == 0, F.array(F.lit(0.0))).when(F.size(x) < size, F.array(rms(x))).otherwise(F.transform(starts, lambda s: rms(F.slice(x, s, size))))

    return bind(F.struct(a.alias("a"), frame.alias("frame")), frames)


def basic_stats(a: Column, sampling_rate: Column, silent_below: float = 1e-5) -> Column:
    level = rms(a)
    return F.struct(
        seconds(a, sampling_rate).alias("duration"), F.size(a).alias("n_samples"), peak(a).alias("peak"), level.alias("rms"),
        ((F.size(a) == 0) | (level < silent_below)).alias("is_silent"),
    )


def extended_stats(a: Column, sampling_rate: Column, frame_ms: float = 30.0, voiced_from: float = 0.01) -> dict[str, Column]:
    """Level, silence, clipping and the silence at either edge."""
    frames = frame_rms(a, frame_size(sampling_rate, frame_ms))
    first, last = _first_last(frames, lambda v: v >= voiced_from)
    each, nothing = frame_ms / 1000.0, F.size(a) == 0
    whole = F.when(nothing, 0.0).otherwise(F.size(frames) * each)
    return {
        "duration": seconds(a, sampling_rate),
        "rms": rms(a),
        "peak": peak(a),
        "silence_ratio": F.when(nothing, 1.0).otherwise(share(frames, lambda v: v < voiced_from)),
        "clipping_ratio": share(a, lambda x: F.abs(x) > 0.99),
        "leading_silence": F.when(nothing | first.isNull(), whole).otherwise((first - 1) * each),
        "trailing_silence": F.when(nothing | first.isNull(), whole).otherwise((F.size(frames) - last) * each),
    }


def trim_edges(a: Column, sampling_rate: Column, top_db: float = 40.0, pad_ms: float = 200.0, frame_ms: float = 30.0, floor: float = 1e-4) -> dict[str, Column]:
    """Silence at the edges goes, never a pause inside.

    A frame speaks when it is above the floor and less than ``top_db`` under the loudest one; ``pad_ms`` are kept on
    either side of the first and last of them.
    """
    frame = frame_size(sampling_rate, frame_ms)
    frames = frame_rms(a, frame)
    loudest = F.array_max(frames)
    limit = F.greatest(loudest * 10.0 ** (-top_db / 20.0), F.lit(floor))
    voiced = bind(limit, lambda low: F.transform(frames, lambda v: v >= low))
    first, last = _first_last(voiced, lambda v: v)
    pad = F.floor(sampling_rate * pad_ms / 1000.0).cast("int")
    empty = (F.size(a) == 0) | first.isNull() | (loudest < floor)
    start = F.when(empty, 0).otherwise(F.greatest((first - 1) * frame - pad, F.lit(0)))
    end = F.when(empty, F.size(a)).otherwise(F.least(last * frame + pad, F.size(a)))
    return {
        "trimmed": F.slice(a, start + 1, end - start),
        "leading_removed": F.coalesce(start / sampling_rate, F.lit(0.0)),
        "trailing_removed": F.coalesce((F.size(a) - end) / sampling_rate, F.lit(0.0)),
        "status": F.when(empty, "likely_empty_audio").when((start > 0) | (end < F.size(a)), "cleaned_ok").otherwise("unchanged"),
    }


def usable(a: Column, sampling_rate: Column, least: float = USABLE_SECONDS, silent_below: float = 1e-5) -> Column:
    return F.when(F.size(a) == 0, "empty").when(seconds(a, sampling_rate) < least, "too_short").when(rms(a) < silent_below, "silent").otherwise("ok")


def hop_silence(a: Column, sampling_rate: Column, frame_ms: float = 25.0, hop_ms: float = 10.0) -> Column:
    """The part of overlapping frames more than 20 dB under the level of the whole; 1 for nothing."""
    limit = F.greatest(F.lit(1e-4), 0.10 * rms(a))
    frames = frame_rms(a, frame_size(sampling_rate, frame_ms), frame_size(sampling_rate, hop_ms))
    return F.when(F.size(a) == 0, 1.0).otherwise(bind(limit, lambda low: share(frames, lambda v: v < low)))


def frame_tokens(ids: Column, probabilities: Column, blank: int) -> dict[str, Column]:
    """What a letter model's frames say of its output: blanks, repeats, certainty."""
    n = F.size(ids)
    again = F.size(F.filter(F.transform(ids, lambda x, i: F.when((i > 0) & (x == F.try_element_at(ids, F.greatest(i, F.lit(1)))), 1)), lambda x: x.isNotNull()))
    return {
        "num_frames": n,
        "blank_ratio": share(ids, lambda x: x == blank),
        "repeated_frame_ratio": F.when(n > 0, again / n).otherwise(0.0),
        "mean_max_probability": F.coalesce(mean(probabilities), F.lit(0.0)),
        "min_max_probability": F.coalesce(F.array_min(probabilities), F.lit(0.0)),
        "max_max_probability": F.coalesce(F.array_max(probabilities), F.lit(0.0)),
    }


def mean_pool(frames: Column, n_valid: Column) -> Column:
    """Mean vector of the first ``n_valid`` frames of a nested array."""
    kept = F.slice(frames, F.lit(1), n_valid)
    size = F.size(F.coalesce(F.try_element_at(kept, F.lit(1)), F.array().cast("array<double>")))
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: mean(F.transform(kept, lambda f: F.try_element_at(f, i)))))
