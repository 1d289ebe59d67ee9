"""Delays and shifts by whole frames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.operators.tables import KEY


def _check(delay_seconds: float, feedback: float, mix: float) -> None:
    if not 0 <= delay_seconds <= 30:
        raise ValueError("delay_seconds has to be between 0 and 30")
    if not 0 <= feedback <= 1 or not 0 <= mix <= 1:
        raise ValueError("feedback and mix have to be between 0 and 1")


def delay(frames: DataFrame, rate: float, delay_seconds: float = 0.5, feedback: float = 0.0, mix: float = 0.5) -> DataFrame:
    """(1 - mix) x[n] + mix line[n - D] with line[n] = x[n] + feedback * line[n - D] and D = int(delay_seconds * rate).

    Frames of equal place modulo D are chains of their own: without feedback a lag in the chain, with feedback the sum of all
    before, each times feedback to the power of its distance. A null value adds nothing and stays null.
    """
    _check(delay_seconds, feedback, mix)
    d = int(delay_seconds * rate)
    if d == 0:
        return frames
    if feedback == 0:
        late = F.lag("value", 1, 0.0).over(Window.partitionBy(*KEY, F.col("frame") % d).orderBy("frame"))
        return frames.withColumn("value", (1.0 - mix) * F.col("value") + mix * late)
    chained = frames.withColumn("value", F.col("value").cast("double")).withColumn("__chain", F.col("frame") % d).withColumn("__place", F.floor(F.col("frame") / d))
    with_line = _before(chained, [*KEY, "__chain"], "__place", "value", "__line", float(feedback))
    return with_line.select(*[((1.0 - mix) * F.col("value") + mix * F.col("__line")).alias("value") if c == "value" else F.col(f"`{c}`") for c in frames.columns])


#: Places of a chain that one window holds.
BLOCK = 1024


def _before(rows: DataFrame, by: list[str], place: str, value: str, out: str, factor: float, depth: int = 2) -> DataFrame:
    """Adds `out`, the sum of factor ** (place - 1 - j) * value over all places j before, in each group; places are whole from 0. All in the JVM.

    A group is cut into blocks of BLOCK places. Within one, a running sum of value / factor ** p, times factor ** (p - 1), is exact, as the latest values weigh
    most. What a block hands on is one number, and those numbers are a group of the same kind, BLOCK times shorter; so a single long chain
    is the work of many tasks. Blocks are short enough that no power leaves the range of doubles.
    """
    fall = -math.log(factor)
    if fall > 46:  # what is two places back is lost in rounding
        return rows.withColumn(out, F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(place)), F.lit(0.0)))
    size = BLOCK if fall * BLOCK < 575 else int(575 / fall)
    block, p = f"{out}_block", f"{out}_p"
    cut = rows.withColumn(block, F.floor(F.col(place) / size) if depth else F.lit(0)).withColumn(p, F.col(place) - F.col(block) * size)
    known = F.coalesce(F.col(value), F.lit(0.0))
    so_far = Window.partitionBy(*by, block).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum(known * F.exp(fall * F.col(p))).over(so_far), F.lit(0.0)) * F.exp(-fall * (F.col(p) - 1))
    cut = cut.withColumn(out, inner)
    if not depth:
        return cut.drop(block, p)
    handed = rows.withColumn(block, F.floor(F.col(place) / size)).groupBy(*by, block).agg(F.sum(known * F.exp(-fall * (size - 1 - (F.col(place) - F.col(block) * size)))).alias(f"{out}_end"))
    carried = _before(handed, by, block, f"{out}_end", f"{out}_carry", factor**size, depth - 1).select(*by, block, f"{out}_carry")
    joined = cut.join(carried, [*by, block])
    return joined.withColumn(out, F.col(out) + F.exp(-fall * F.col(p)) * F.col(f"{out}_carry")).drop(block, p, f"{out}_carry")


def shift(frames: DataFrame, n: int, num_frames: DataFrame | None = None) -> DataFrame:
    """n silent frames in front; the length stays. num_frames(track_id, num_frames) saves the count."""
    if n < 0:
        raise ValueError("n has to be at least 0")
    lengths = num_frames if num_frames is not None else frames.groupBy("track_id").agg((F.max("frame") + 1).alias("num_frames"))
    moved = frames.withColumn("frame", F.col("frame") + n).unionByName(frames.filter(F.col("frame") < n).withColumn("value", F.lit(0.0)))
    return moved.join(lengths, "track_id").filter("frame < num_frames").select(*KEY, "frame", "value")


def align(branches: list[tuple[DataFrame, int]]) -> list[DataFrame]:
    """Branches of known latency, all brought to the greatest one; a chain's latency is the sum of its parts', a mix's the greatest."""
    most = max(latency for _, latency in branches)
    return [shift(b, most - latency) for b, latency in branches]
