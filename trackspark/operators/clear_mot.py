"""Multi-object tracking metrics: CLEAR-MOT (MOTA, MOTP, switches) and identity scores (IDF1)."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.geometry import iou
from trackspark.operators.components import components
from trackspark.operators.overlap import meeting
from trackspark.plans.storage import checkpoint


def cheapest_pairs(costs: dict[tuple, float], below: float | None = None) -> list[tuple]:
    """One-to-one pairs of least total cost, as many as possible, or with ``below`` only while one more costs less than that.

    The given pairs are the only ones allowed. One left end after the other takes its shortest augmenting path by reduced
    costs, where staying alone is an end too, at the price ``below`` or at one that no sum of costs reaches. A right end
    is settled once in each search, so that ties end like anything else.
    """
    alone = 1.0 + 2 * sum(map(abs, costs.values())) if below is None else below
    ends: dict = {}
    for a, b in sorted(costs):
        ends.setdefault(a, []).append(b)
    partner: dict = {}  # right -> left
    price: dict = {}
    for start in ends:
        settled, came, queue, turn = {}, {}, [], itertools.count()

        def reach(a, far: float, own: float) -> None:
            for b in ends[a]:  # noqa: B023
                if b not in settled:  # noqa: B023
                    heapq.heappush(queue, (far + costs[a, b] - price.get(b, 0.0) - own, next(turn), a, b))  # noqa: B023
            heapq.heappush(queue, (far + alone - own, next(turn), a, None))  # noqa: B023

        reach(start, 0.0, 0.0)
        while True:
            far, _, a, b = heapq.heappop(queue)
            if b is None or b not in settled:
                if b is not None:
                    came[b] = a
                if b is None or b not in partner:
                    break
                settled[b] = far
                reach(partner[b], far, costs[partner[b], b] - price.get(b, 0.0))
        for x, d in settled.items():
            price[x] = price.get(x, 0.0) + min(0.0, d - far)
        while True:  # turn the path round: a takes b and gives up what it had
            had = next((x for x in ends[a] if partner.get(x) == a), None)
            if b is not None:
                partner[b] = a
            if had is None or a == start:
                break
            b, a = had, came[had]
    return sorted((a, b) for b, a in partner.items())


def overlapping(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes of one frame and class that overlap by at least ``least``, with their distance 1 - overlap."""
    keys = ["sequence", "frame", "class_id"]
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y", "w", "h")])
    df = meeting(side(truth, "gt"), side(predicted, "pred"), keys, "gt_", "pred_").withColumn("iou", iou("gt_", "pred_")).where(F.col("iou") >= least)
    return df.select("sequence", "frame", "gt_id", "pred_id", (1 - F.col("iou")).alias("distance"))


def _linked(pairs: DataFrame) -> DataFrame:
    """(sequence, gt_id, pred_id) -> sequence, gt_id, component, where a component holds all tracks that pairs link."""
    ends = pairs.select("sequence", (2 * F.col("gt_id").cast("long")).alias("a"), (2 * F.col("pred_id").cast("long") + 1).alias("b"))
    found = components(ends).where("id % 2 = 0")
    return found.select("sequence", F.shiftright("id", 1).cast("int").alias("gt_id"), "component")


def frame_matches(near: DataFrame) -> DataFrame:
    """Matched boxes: a true track keeps its partner while they overlap; the others are paired at least distance.

    A box that overlaps one box only, which overlaps no other, is matched as it is. Where boxes are contested, the choice
    depends on the partners before: the true tracks that such frames link are read together in order of frames, and a
    task holds one frame of them and the last partner of each. ``switched`` marks a track whose partner is another one than before.
    """
    columns = "sequence string, frame int, gt_id int, pred_id int, distance double"
    names = [x.split()[0] for x in columns.split(", ")]

    def decide(rows: list, last: dict) -> list[tuple]:
        costs = {(r.gt_id, r.pred_id): r.distance for r in rows}
        taken = {b: a for a, b in sorted(costs, reverse=True) if last.get(a) == b}
        used = set(taken.values())
        pairs = [(a, b) for b, a in taken.items()]
        pairs += cheapest_pairs({(a, b): d for (a, b), d in costs.items() if a not in used and b not in taken})
        last.update(pairs)
        return [(rows[0].sequence, rows[0].frame, a, b, costs[a, b]) for a, b in pairs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, rows = None, {}, []
        for batch in batches:
            found = []
            for r in batch.itertuples(index=False):
                key = (r.sequence, r.component)
                if rows and (key != now or rows[0].frame != r.frame):
                    found += decide(rows, last)
                    rows = []
                if key != now:
                    now, last = key, {}
                rows.append(r)
            yield pd.DataFrame(found, columns=names)
        if rows:
            yield pd.DataFrame(decide(rows, last), columns=names)

    count = lambda side: F.count("*").over(Window.partitionBy("sequence", "frame", side))
    df = checkpoint(near.withColumn("contested", (count("gt_id") > 1) | (count("pred_id") > 1)))
    linked = checkpoint(_linked(df.where("contested").select("sequence", "gt_id", "pred_id").distinct()))
    df = df.join(linked, ["sequence", "gt_id"], "left")
    together = df.where("component is not null").repartition("sequence", "component").sortWithinPartitions("sequence", "component", "frame", "gt_id", "pred_id")
    matched = df.where("component is null").select(*names).unionByName(together.mapInPandas(run, columns))
    before = F.lag("pred_id").over(Window.partitionBy("sequence", "gt_id").orderBy("frame"))
    return matched.withColumn("switched", F.coalesce(before != F.col("pred_id"), F.lit(False)))


def identity_hits(near: DataFrame) -> DataFrame:
    """Boxes whose track is the one assigned to their true track over the whole sequence (IDTP).

    Frames are counted by Spark first. Two tracks that overlap no other count as they are; a call gets the pairs of
    tracks that are linked, not a sequence's, and not boxes.
    """

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        costs = dict(zip(zip(rows.gt_id, rows.pred_id, strict=True), -rows.n.astype(float), strict=True))
        hits = -sum(costs[p] for p in cheapest_pairs(costs, below=0.0))
        return pd.DataFrame({"sequence": rows.sequence[:1], "idtp": [int(hits)]})

    counts = checkpoint(near.groupBy("sequence", "gt_id", "pred_id").agg(F.count("*").alias("n")))
    rivals = lambda side: F.count("*").over(Window.partitionBy("sequence", side))
    counts = counts.withColumn("linked", (rivals("gt_id") > 1) | (rivals("pred_id") > 1))
    several = counts.where("linked")
    found = several.join(_linked(several), ["sequence", "gt_id"]).groupBy("sequence", "component").applyInPandas(best, "sequence string, idtp long")
    alone = counts.where("not linked").select("sequence", F.col("n").alias("idtp"))
    return alone.unionByName(found).groupBy("sequence").agg(F.sum("idtp").alias("idtp"))


def fragments(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """How often the tracks of each sequence are found again after boxes that were missed."""
    met = matches.select("sequence", "frame", F.col("gt_id").alias("id"), F.lit(1).alias("met"))
    df = truth.select("sequence", "frame", "id").join(met, ["sequence", "frame", "id"], "left").fillna(0, ["met"])
    order = Window.partitionBy("sequence", "id").orderBy("frame")
    before = F.sum("met").over(order.rowsBetween(Window.unboundedPreceding, -1))
    again = (F.col("met") == 1) & (F.lag("met").over(order) == 0) & (before > 0)
    return df.withColumn("again", again).groupBy("sequence").agg(F.count_if("again").alias("num_fragmentations"))


def metrics(truth: DataFrame, predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Metrics of each sequence that both sides have, and of all together (OVERALL).

    Ratios without a denominator are null. Without a common sequence there are no rows.
    """
    c = F.col
    near = checkpoint(overlapping(truth, predicted, least))
    matches = checkpoint(frame_matches(near))
    count = lambda df, name: df.groupBy("sequence").agg(F.count("*").alias(name))
    frames = truth.select("sequence", "frame").unionByName(predicted.select("sequence", "frame")).distinct()
    found = matches.groupBy("sequence").agg(F.count("*").alias("matches"), F.count_if("switched").alias("num_switches"), F.sum("distance").alias("far"))
    df = count(truth, "num_objects").join(count(predicted, "num_predictions"), "sequence").join(count(frames, "num_frames"), "sequence")
    for more in (found, fragments(truth, matches), identity_hits(near)):
        df = df.join(more, "sequence", "left")
    whole = ["num_frames", "num_objects", "num_predictions", "matches", "num_switches", "num_fragmentations", "idtp"]
    df = df.fillna(0, [*whole, "far"]).rollup("sequence").agg(*[F.sum(k).alias(k) for k in (*whole, "far")])
    df = df.withColumn("sequence", F.coalesce("sequence", F.lit("OVERALL")))
    df = df.withColumns({"num_misses": c("num_objects") - c("matches"), "num_false_positives": c("num_predictions") - c("matches")})
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    return df.select(
        "sequence", *whole, "num_misses", "num_false_positives",
        ratio(c("num_objects") - c("num_misses") - c("num_false_positives") - c("num_switches"), c("num_objects")).alias("mota"), ratio(c("far"), c("matches")).alias("motp"),
        ratio(2 * c("idtp"), c("num_objects") + c("num_predictions")).alias("idf1"), ratio(c("idtp"), c("num_predictions")).alias("idp"), ratio(c("idtp"), c("num_objects")).alias("idr"),
        ratio(c("matches"), c("num_predictions")).alias("precision"), ratio(c("matches"), c("num_objects")).alias("recall"),
    )
