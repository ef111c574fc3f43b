"""Where a hidden track may be: a corridor along its last motion, and the side on which it comes out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.functions.scores import round_six
from trackspark.operators.occlusion import hidden, hidden_behind, moving

#: Slower than this, in pixels a frame, is still.
STILL = 1e-6


def speed(vx: Column, vy: Column) -> Column:
    return F.sqrt(vx * vx + vy * vy)


def side(vx: Column, vy: Column) -> Column:
    """Side of the picture to which a velocity points; the horizontal one if both parts are equal."""
    level = F.when(vx >= 0, "right").otherwise("left")
    upright = F.when(vy >= 0, "bottom").otherwise("top")
    return F.when(speed(vx, vy) <= STILL, "unknown").when(F.abs(vx) >= F.abs(vy), level).otherwise(upright)


def corridors(tracks: DataFrame, max_gap: int = 30, base: float = 12.0, along: float = 4.0, across: float = 1.35) -> DataFrame:
    """One row per missing frame between two sightings, at most ``max_gap`` after the first.

    The corridor runs from the last seen centre to the predicted one. Its uncertainty is an ellipse along the direction
    of motion, which grows by ``along`` and ``across`` per frame (a circle for a still track). With an occluder the side
    of return follows from the motion relative to it. The track is expected back between this frame and as many frames
    later as it needs for half its outline, 3 to 60.
    """
    c, r6, zero = F.col, round_six, F.lit(0.0)
    own = speed(c("vx"), c("vy"))
    # what is known of a sighting is computed for it and not for each hidden row
    needed = F.bround((c("w") + c("h")) / F.greatest(c("own"), F.lit(1.0)), 0).cast("int")
    plain = {"own_vx": r6(c("vx")), "own_vy": r6(c("vy")), "speed": r6(c("own")), "heading": r6(F.when(c("own") > STILL, F.degrees(F.atan2("vy", "vx"))).otherwise(zero))}
    places = {"previous_x": "before_x", "previous_y": "before_y", "start_x": "cx", "start_y": "cy"}
    sightings = moving(tracks).withColumn("own", own).withColumns(plain | {k: r6(c(v)) for k, v in places.items()} | {"needed": F.greatest(F.lit(3), F.least(F.lit(60), needed)), "still": c("own") <= STILL})
    df = hidden_behind(sightings, max_gap, keep=("vx", "vy", *plain, *places, "needed", "still"))
    alone = c("occluder_id").isNull()
    major = F.lit(base) + along * c("gap")
    minor = F.when(c("still"), major).otherwise(F.lit(base) + across * c("gap"))
    return df.select(
        "sequence", "id", "frame", "gap",
        F.when(alone, "constant_velocity").otherwise("paired_motion_corridor").alias("model"),
        "occluder_id", c("own_vx").alias("vx"), c("own_vy").alias("vy"), r6(c("occluder_vx")).alias("occluder_vx"), r6(c("occluder_vy")).alias("occluder_vy"),
        "speed", "heading", *places, "predicted_x", "predicted_y",
        r6(F.greatest(major, minor)).alias("major"), r6(F.least(major, minor)).alias("minor"),
        F.when(c("still"), "unknown").otherwise("valid").alias("direction"),
        side(c("vx") - F.coalesce("occluder_vx", zero), c("vy") - F.coalesce("occluder_vy", zero)).alias("side"),
        (c("frame") + c("needed")).alias("expected_until"),
        F.coalesce("confidence", zero).alias("pair_confidence"),
    )


def ways(tracks: DataFrame, max_gap: int = 30) -> DataFrame:
    """The ends and the direction of ``corridors`` alone, which no occluder changes."""
    c = F.col
    df = hidden(moving(tracks), max_gap)
    start = [round_six(c(f"c{k}")).alias(f"start_{k}") for k in "xy"]
    predicted = [round_six(c(f"c{k}") + c(f"v{k}") * c("gap")).alias(f"predicted_{k}") for k in "xy"]
    return df.select("sequence", "id", c("at").alias("frame"), *start, *predicted, F.when(speed(c("vx"), c("vy")) <= STILL, "unknown").otherwise("valid").alias("direction"))


def direction(vx: Column, vy: Column, mx: Column, my: Column) -> tuple[Column, Column]:
    """Whether a match displaced by (mx, my) lies where the velocity points, and their dot product.

    ``unknown`` for a track without velocity or standing still and for a match on the spot; ``valid`` without a match.
    """
    dot, small = vx * mx + vy * my, lambda a, b: F.abs(a) + F.abs(b) < STILL
    missing, lone = vx.isNull() | vy.isNull(), mx.isNull() | my.isNull()
    state = F.when(missing | small(vx, vy), "unknown").when(lone, "valid").when(small(mx, my), "unknown").when(dot < 0, "inconsistent").otherwise("valid")
    return state, F.when(~small(vx, vy), F.round(dot, 6))


def return_directions(tracks: DataFrame) -> DataFrame:
    """For each return of a track after missing frames: does it come back where its last velocity pointed?"""
    order = Window.partitionBy("sequence", "id").orderBy("frame")
    df = moving(tracks).withColumns({f"m{k}": F.lead(f"c{k}").over(order) - F.col(f"c{k}") for k in "xy"})
    df = df.where(F.col("next") > F.col("frame") + 1)
    state, dot = direction(*map(F.col, ("vx", "vy", "mx", "my")))
    return df.select("sequence", "id", F.col("next").alias("frame"), (F.col("next") - F.col("frame") - 1).alias("gap"), dot.alias("dot"), state.alias("direction"))


def continuation_confidence(best_part: Column, full: Column, good_parts: Column, off: Column, radius: float, gap: Column, max_gap: int, searched: Column) -> Column:
    """Confidence that a patch found ``off`` pixels from the prediction continues a hidden track.

    Scores of the best part and of the whole template (0: not found), the number of parts that match well, the share of
    the search window that lies inside the picture; confidence fades to a fifth of itself with the gap.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    whole = F.when(full > 0, full).otherwise(best_part * 0.75)
    near = F.greatest(zero, one - off / max(radius, 1.0))
    fade = F.greatest(F.lit(0.2), one - 0.65 * gap / max(max_gap, 1))
    total = 0.45 * best_part + 0.25 * whole + 0.2 * F.least(one, good_parts / 3) + 0.1 * near
    return F.greatest(zero, F.least(one, total * fade * F.least(one, searched)))
