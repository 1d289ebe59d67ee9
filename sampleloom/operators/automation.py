"""Effects whose parameters change along a track while their state is kept, such as a reverb with a rising wet level.

params(track_id, frame, name, value) holds the points of the curves; a value holds from its frame to the next point, before the first one the
effect's own value does. The points of a block travel in front of it through the ordered pass, as a row of the same key, so samples are
shuffled once and points find their blocks by a window over the blocks' first frames alone. Within the pass a block is cut where a value changes,
the effect is retuned, and goes on with its state. So results don't depend on the block size.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.kernels import effects as fx
from sampleloom.operators.board import in_order
from sampleloom.operators.scan import typed
from sampleloom.operators.tables import KEY

#: Which parameter of which effect (by its place in the list) follows which curve: {(0, "wet_level"): "wet"}.
Automation = dict[tuple[int, str], str]


class Automated:
    """A chain with points (frame, which, value) to come; `which` counts the entries of the automation. Kernels for batches and streams."""

    def __init__(self, effects: list[fx.Effect], automation: Automation, rate: float):
        self.effects, self.places, self.rate = list(effects), list(automation), rate
        for i, name in self.places:
            e = effects[i]
            if name not in e.params or name in e.steady or not isinstance(getattr(e, name), (int, float)):
                raise ValueError(f"{name} of {type(e).__name__} can't be automated")
        self.states: list | None = None
        self.points: list[tuple[int, int, float]] = []

    def tell(self, marks: np.ndarray) -> None:
        """Points as one array of frame, which, value, frame, ...; of the points at one frame the last counts."""
        self.points += [(int(f), int(k), float(v)) for f, k, v in np.asarray(marks, float).reshape(-1, 3)]
        self.points.sort(key=lambda p: p[0])

    def process(self, block: np.ndarray, start: int) -> np.ndarray:
        if self.states is None:
            self.states = [e.init_state(self.rate, block.shape[0]) for e in self.effects]
        out, at, stop = [], start, start + block.shape[1]
        while at < stop:
            due = 0
            while due < len(self.points) and self.points[due][0] <= at:
                due += 1
            changed: dict[int, dict[str, float]] = {}
            for _, k, v in self.points[:due]:
                i, name = self.places[k]
                changed.setdefault(i, {})[name] = v
            del self.points[:due]
            for i, values in changed.items():
                self.effects[i] = replace(self.effects[i], **values)
                self.effects[i].retuned(self.rate, self.states[i])
            until = min(stop, self.points[0][0]) if self.points else stop
            part = block[:, at - start : until - start]
            for e, s in zip(self.effects, self.states, strict=True):
                part = e.process(part, s, at)
            out.append(part)
            at = until
        return np.concatenate(out, axis=1) if out else block


def marks(chunks: DataFrame, params: DataFrame, automation: Automation, by: list[str]) -> DataFrame:
    """*by, chunk, start_frame, marks: the points of each block that has any, as frame, which, value, frame, ... Points before a track go to its first block."""
    which = {name: k for k, name in reversed(list(enumerate(automation.values())))}
    uses = [F.when(F.col("name") == name, F.array(*[F.lit(k) for k, n in enumerate(automation.values()) if n == name])) for name in which]
    points = params.filter(F.col("name").isin(list(which)) & F.col("value").isNotNull() & F.col("frame").isNotNull())
    points = points.select("track_id", F.col("frame").cast("long").alias("frame"), F.explode(F.coalesce(*uses)).alias("which"), F.col("value").cast("double").alias("value"))
    heads = chunks.select(*by, "chunk", F.col("start_frame").cast("long").alias("frame")).distinct()
    keyed = points if by == ["track_id"] else points.join(heads.select(*by).distinct(), "track_id")
    both = heads.withColumns({"which": F.lit(-1), "value": F.lit(0.0)}).unionByName(keyed.withColumn("chunk", F.lit(None).cast("long")).select(*by, "chunk", "frame", "which", "value"))
    order = Window.partitionBy(*by).orderBy("frame", "which")
    own = F.coalesce(F.last(F.when(F.col("which") < 0, F.struct("chunk", "frame")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(F.when(F.col("which") < 0, F.struct("chunk", "frame")), ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    placed = both.withColumn("own", own).filter("which >= 0 AND own IS NOT NULL")
    grouped = placed.groupBy(*by, F.col("own.chunk").alias("chunk"), F.col("own.frame").alias("start_frame")).agg(F.array_sort(F.collect_list(F.struct("frame", "which", "value"))).alias("points"))
    return grouped.select(*by, "chunk", "start_frame", F.flatten(F.transform("points", lambda p: F.array(p["frame"].cast("double"), p["which"].cast("double"), p["value"]))).alias("marks"))


def apply_automated(chunks: DataFrame, effects: list[fx.Effect], rate: float, params: DataFrame, automation: Automation) -> DataFrame:
    """The chain over each track or channel in order; blocks keep their numbers and lengths. Of equal points of one curve the greatest value counts; null
    values and frames don't. A value out of an effect's range is an error, as in its constructor."""
    Automated(effects, automation, rate)  # on the driver: errors come at once
    by = ["track_id"] if fx.worst(effects) == "track" else KEY
    blocks = typed(chunks)
    told = marks(blocks, params, automation, by).select("track_id", "channel" if "channel" in by else F.lit(0).alias("channel"), (F.col("chunk") * 2).alias("chunk"), "start_frame", F.col("marks").alias("samples"))

    def make():
        own = Automated(effects, automation, rate)

        def f(block, at, channels):
            if block is None:
                return []
            chunk, start = at
            if chunk % 2 == 0:
                own.tell(block[0])
                return []
            return [(own.process(block, start), (chunk // 2, start))]

        return f

    return in_order(blocks.withColumn("chunk", F.col("chunk") * 2 + 1).unionByName(told), by, make)
