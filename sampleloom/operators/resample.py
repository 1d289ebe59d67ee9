"""Resampling of the long form by the local interpolators, without a join.

Output frame j lies at source position j * src / dst. Each source frame makes the outputs that start
in it, so a window for the neighbours' values is the only shuffle. The sinc qualities, and long
tracks in packed form, go through the block kernels (operators.board.resample_chunks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.kernels.sinc import LOCAL, weights
from sampleloom.operators.tables import KEY

def resample_to(frames: DataFrame, src: float, dst: float, quality: str = "zoh") -> DataFrame:
    """floor(n * dst / src) frames; frames outside a track are silence. Equal rates return the input."""
    if src <= 0 or dst <= 0:
        raise ValueError("rates have to be greater than 0")
    if src == dst:
        return frames
    if quality not in LOCAL:
        raise ValueError(f"{quality!r} is no local quality; operators.board.resample_chunks has the others")
    first, last = LOCAL[quality]
    w = Window.partitionBy(*KEY).orderBy("frame")
    tap = lambda k: F.col("value") if k == 0 else F.lag("value", -k, 0.0).over(w) if k < 0 else F.lead("value", k, 0.0).over(w)
    with_taps = frames.select(*KEY, "frame", *[tap(k).alias(f"__t{k - first}") for k in range(first, last + 1)], F.max("frame").over(Window.partitionBy(*KEY)).alias("__last"))
    guess: Column = F.floor(F.col("frame") * dst / src)
    made = with_taps.withColumn("j", F.explode(F.sequence(F.greatest(F.lit(0), guess - 1), F.floor((F.col("frame") + 1) * dst / src) + 1)))
    position = F.col("j") * float(src) / float(dst)
    made = made.filter((F.floor(position) == F.col("frame")) & (F.col("j") < F.floor((F.col("__last") + 1) * float(dst) / float(src))))
    parts = [F.col(f"__t{i}") * x for i, x in enumerate(weights(quality, position - F.floor(position)))]
    value = parts[0]
    for p in parts[1:]:
        value = value + p
    return made.select(*KEY, F.col("j").cast("long").alias("frame"), value.alias("value"))


def resample_effect(frames: DataFrame, rate: float, target_rate: float, quality: str = "zoh") -> DataFrame:
    """Down to the target rate and back, with the input's length; frames that the way back does not reach hold silence."""
    if target_rate <= 0:
        raise ValueError("target_rate has to be greater than 0")
    if rate == target_rate:
        return frames
    back = resample_to(resample_to(frames, rate, target_rate, quality), target_rate, rate, quality).withColumnRenamed("value", "__v")
    return frames.select(*KEY, "frame").join(back, [*KEY, "frame"], "left").select(*KEY, "frame", F.coalesce("__v", F.lit(0.0)).alias("value"))
