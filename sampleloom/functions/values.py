"""Column functions on sample values: levels, number formats and sample-wise effects. No state, no shuffle.

Each takes and returns a Column, so it serves the long form (one row a sample) directly and the
packed form through `on_chunks`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def on_chunks(df: DataFrame, f: Callable[[Column], Column], samples: str = "samples") -> DataFrame:
    """Applies a sample-wise function to every element of the packed form."""
    return df.withColumn(samples, F.transform(samples, f))


def on_frames(df: DataFrame, f: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return df.withColumn(value, f(F.col(value)))


# levels


def db_to_gain(db: Column | str) -> Column:
    return F.pow(F.lit(10.0), col(db) / 20.0)


def gain_to_db(gain: Column | str) -> Column:
    """Null for zero gain, which has no level."""
    return F.when(col(gain) > 0, 20.0 * F.log10(col(gain)))


def semitones_to_ratio(semitones: Column | str) -> Column:
    return F.pow(F.lit(2.0), col(semitones) / 12.0)


# number formats


def int_to_float(value: Column | str, bits: int) -> Column:
    """By the largest positive value of the width, so the most negative one lands just below -1."""
    return col(value).cast("double") / float((1 << bits - 1) - 1)


def widen_int(value: Column | str, bits: int) -> Column:
    return F.shiftleft(col(value).cast("int"), 32 - bits)


def narrow_int(value: Column | str, bits: int) -> Column:
    return F.shiftright(col(value).cast("int"), 32 - bits)


def float_to_pcm(value: Column | str, bits: int) -> Column:
    """Clamped to [-1, 1], scaled, rounded half to even."""
    clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(value)))
    return F.rint(clamped * float((1 << bits - 1) - 1)).cast("int")


def detect_layout(rows: Column | str, cols: Column | str, hint: Column | None = None) -> Column:
    """`planar` (rows are channels), `interleaved`, or null where the shape does not tell."""
    r, c = col(rows), col(cols)
    by_shape = (
        F.when((r == 0) & (c > 0), "interleaved")
        .when((r > 0) & (c == 0), "planar")
        .when((r == c) & (r > 1), F.lit(None))
        .when(r <= c, "planar")
        .otherwise("interleaved")
    )
    if hint is None:
        return by_shape
    return F.when((r == hint) & (c != hint), "planar").when((c == hint) & (r != hint), "interleaved").otherwise(by_shape)


def check_samples(df: DataFrame, value: str = "value") -> DataFrame:
    """FLOAT stays, DOUBLE is narrowed to FLOAT, anything else is a TypeError. Also for arrays of them."""
    kind = df.schema[value].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if not isinstance(inner, (T.FloatType, T.DoubleType)):
        raise TypeError(f"samples have to be 32-bit or 64-bit floating point, not {inner.simpleString()}")
    return df.withColumn(value, F.col(value).cast("array<float>" if isinstance(kind, T.ArrayType) else "float"))


# sample-wise effects


def gain(value: Column | str, gain_db: float | Column = 1.0) -> Column:
    return col(value) * (db_to_gain(gain_db) if isinstance(gain_db, Column) else F.lit(10.0 ** (gain_db / 20.0)))


def invert(value: Column | str) -> Column:
    return -col(value)


def clipping(value: Column | str, threshold_db: float | Column = -6.0) -> Column:
    top = db_to_gain(threshold_db) if isinstance(threshold_db, Column) else F.lit(10.0 ** (threshold_db / 20.0))
    return F.greatest(-top, F.least(top, col(value)))


def distortion(value: Column | str, drive_db: float | Column = 25.0) -> Column:
    return F.tanh(gain(value, drive_db))


def bitcrush(value: Column | str, bit_depth: float | Column = 8.0) -> Column:
    """Rounds to 2^bit_depth steps, ties to even; 0 to 32 bits, fractions allowed."""
    if not isinstance(bit_depth, Column):
        if not 0 <= bit_depth <= 32:
            raise ValueError("bit_depth has to be between 0 and 32")
        scale = F.lit(2.0**bit_depth)
    else:
        scale = F.pow(F.lit(2.0), bit_depth)
    return F.rint(col(value) * scale) / scale


def blend(dry: Column | str, wet: Column | str, mix: float | Column) -> Column:
    mix = mix if isinstance(mix, Column) else F.lit(float(mix))
    return (1.0 - mix) * col(dry) + mix * col(wet)


# lengths


def resampled_length(frames: Column | str, src: Column | float, dst: Column | float, base_latency: int = 0) -> Column:
    """Frames that a resampled file reports; base_latency is twice the zero crossings for sinc qualities, else 0."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    ratio = as_col(dst) / as_col(src)
    latency = F.lit(float(base_latency)) * ratio
    rounded = F.floor(latency + 0.5)
    return F.floor(col(frames) * ratio - F.when(latency > 0, rounded - latency).otherwise(0.0)).cast("long")


def stretched_length(frames: Column | str, stretch_factor: Column | float) -> Column:
    """Truncated, as all lengths here."""
    factor = stretch_factor if isinstance(stretch_factor, Column) else F.lit(float(stretch_factor))
    return F.floor(col(frames) / factor).cast("long")
