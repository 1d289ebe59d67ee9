"""Parameter curves and value ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.functions.text import number_of

MIN_BLOCK = 1024


def param_ranges(samples: DataFrame) -> DataFrame:
    """samples(param, raw_value, text) -> param, lo, hi, text: runs of equal text; hi is where the next run starts, or 1."""
    w = Window.partitionBy("param").orderBy("raw_value")
    changed = samples.withColumn("__new", F.coalesce((F.col("text") != F.lag("text").over(w)).cast("int"), F.lit(1))).withColumn("__run", F.sum("__new").over(w))
    runs = changed.groupBy("param", "__run").agg(F.min("raw_value").alias("lo"), F.min("text").alias("text"))
    by = Window.partitionBy("param").orderBy("__run")
    return runs.select("param", F.when(F.col("__run") == 1, 0.0).otherwise(F.col("lo")).alias("lo"), F.coalesce(F.lead("lo").over(by), F.lit(1.0)).alias("hi"), "text")


def param_steps(ranges: DataFrame) -> DataFrame:
    """param, min_value, max_value and step_size of params whose texts are all numbers: the one difference of neighbours, rounded to 8 places, or the mean of the different ones."""
    w = Window.partitionBy("param").orderBy("number")
    numbers = ranges.withColumn("number", number_of("text"))
    gap = numbers.withColumn("gap", F.round(F.abs(F.lead("number").over(w) - F.col("number")), 8))
    agg = gap.groupBy("param").agg(
        F.count(F.when(F.col("number").isNull(), 1)).alias("texts"), F.min("number").alias("min_value"), F.max("number").alias("max_value"), F.array_sort(F.collect_set("gap")).alias("gaps")
    )
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, x: a + x) / F.size("gaps")
    return agg.filter("texts = 0").select("param", "min_value", "max_value", F.when(F.size("gaps") > 0, mean).alias("step_size"))


def param_runs(params: DataFrame) -> DataFrame:
    """track_id, start, n, value of each run of equal values of a curve with one value a frame."""
    w = Window.partitionBy("track_id").orderBy("frame")
    marked = params.withColumn("__run", F.sum(F.coalesce((F.col("value") != F.lag("value").over(w)).cast("int"), F.lit(1))).over(w))
    return marked.groupBy("track_id", "__run").agg(F.min("frame").alias("start"), F.count(F.lit(1)).alias("n"), F.min("value").alias("value")).drop("__run")


def walk(starts: list[int], values: list[float], total: int, min_block: int, max_block: int) -> Iterator[tuple[int, int, float]]:
    """(start, n, value) of the blocks: each to the next change, but at least min_block and at most max_block frames, and cut at the end."""
    at = run = 0
    while at < total:
        while run + 1 < len(starts) and starts[run + 1] <= at:
            run += 1
        to_change = (starts[run + 1] if run + 1 < len(starts) else total) - at
        n = min(max(min_block, min(max_block, to_change)), total - at)
        yield at, n, values[run]
        at += n


def param_segments(params: DataFrame, min_block: int = MIN_BLOCK, max_block: int = 8192) -> DataFrame:
    """track_id, seg_id, start, n, value. The walk is greedy, so it takes the runs of one track (not its frames) in order."""
    runs = param_runs(params)

    def segments(pdf):
        import pandas as pd

        pdf = pdf.sort_values("start")
        total = int((pdf.start + pdf.n).max())
        rows = list(walk(pdf.start.tolist(), pdf.value.tolist(), total, min_block, max_block))
        return pd.DataFrame([(pdf.track_id.iloc[0], i, *r) for i, r in enumerate(rows)], columns=["track_id", "seg_id", "start", "n", "value"])

    return runs.groupBy("track_id").applyInPandas(segments, "track_id long, seg_id int, start long, n long, value double")
