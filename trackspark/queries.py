"""Queries over the derived track tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.operators import appearance, cameras, clear_mot, encounters, evaluation, occlusion, priors, stitch, transponder
from trackspark.functions.scores import round_six
from trackspark.operators import tracklets as pieces
from trackspark.plans.observations import OBSERVED, SQL, observations, predictions, reports, truth
from trackspark.sources import mot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with {SQL}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return add


@query("select * from obs")
def mot_rows(spark, sf):
    return observations(spark, sf)


@query("select sequence, frame, id, round(x, 4) as x, round(y, 4) as y, round(w, 4) as w, round(h, 4) as h, round(confidence, 6) as confidence, class_id, round(visibility, 6) as visibility from obs")
def mot_text_roundtrip(spark, sf):
    return mot.parse(mot.lines(observations(spark, sf)), sequence=F.col("sequence"))


@query("select sequence, id, count(*) as num_rows, count(distinct frame) as num_frames from obs group by 1, 2")
def track_id_counts(spark, sf):
    return evaluation.track_id_counts(observations(spark, sf))


@query("""+ s as (select sequence, count(*) as num_rows, min(frame) as min_frame, max(frame) as max_frame, count(distinct id) as num_ids, count(*) - count(distinct (frame, id)) as duplicates,
    count(*) filter (frame < 1 or id < 1) as bad_keys, count(*) filter (w <= 0 or h <= 0) as bad_boxes, count(*) filter (confidence <> 1) as odd_confidence,
    count(*) filter (visibility not between 0 and 1) as odd_visibility from gt group by 1)
    select *, case when duplicates + bad_keys + bad_boxes > 0 then 'invalid' when odd_confidence + odd_visibility > 0 then 'warning' else 'ok' end as status from s""")
def gt_validate(spark, sf):
    return evaluation.validate(truth(spark, sf))


@query("select sequence, frame, 1 as id, x, y, w, h, 1.0::double as confidence, class_id, 1.0::double as visibility from obs where id in (3, 7, 9) and frame between 100 and 1500")
def merge_ids_to_gt(spark, sf):
    return evaluation.merge_ids(observations(spark, sf), [3, 7, 9], 1, 100, 1500).select(*OBSERVED)


SEGMENTS = """+ g as (select *, x + w / 2 as cx, y + h / 2 as cy, coalesce(frame - lag(frame) over t - 1, 0) as missing from pred window t as (partition by sequence, id order by frame)),
    seg as (select *, sum((missing > {gap})::int) over (partition by sequence, id order by frame)::int as segment from g)"""
TRACKLETS = (
    SEGMENTS
    + """, vel as (select *, case when frame - lag(frame) over t > 0 then (cx - lag(cx) over t) / (frame - lag(frame) over t) else 0 end as vx,
          case when frame - lag(frame) over t > 0 then (cy - lag(cy) over t) / (frame - lag(frame) over t) else 0 end as vy from seg window t as (partition by sequence, id, segment order by frame)),
    tr as (select sequence, id, segment, min(frame) as frame_start, max(frame) as frame_end, count(*) as num_rows, count(distinct frame) as num_frames,
          round(avg(confidence), 6) as mean_confidence, round(avg(w * h), 6) as mean_area, round(avg(case when h > 0 then w / h else 0 end), 6) as mean_aspect_ratio,
          round(min_by(cx, frame), 6) as start_x, round(min_by(cy, frame), 6) as start_y, round(max_by(cx, frame), 6) as end_x, round(max_by(cy, frame), 6) as end_y,
          round(max_by(vx, frame), 6) as end_vx, round(max_by(vy, frame), 6) as end_vy, count(*) filter (missing > 0 and missing <= {gap}) as num_gaps,
          list_sort(list(distinct class_id)) as class_ids from vel group by 1, 2, 3 having count(*) >= {least})"""
)
#: The derived tracks are sparse: longer gaps and shorter tracklets than for video.
GAP, LEAST = 40, 3
LOOSE = stitch.StitchConfig(max_frame_gap=60, min_length=3, max_center_distance=900.0, base_region_radius=900.0)


def _tracklets(spark, sf):
    return pieces.tracklets(predictions(spark, sf), GAP, LEAST)


@query(TRACKLETS.format(gap=GAP, least=LEAST) + " select * exclude (class_ids), array_to_string(class_ids, ' ') as class_ids from tr")
def tracklets(spark, sf):
    return _tracklets(spark, sf).withColumn("class_ids", F.array_join(F.col("class_ids").cast("array<string>"), " "))


@query(SEGMENTS.format(gap=GAP) + " select missing, count(*) as n from seg where missing > 0 group by 1")
def frame_gaps(spark, sf):
    return pieces.segments(predictions(spark, sf), GAP).where("missing > 0").groupBy("missing").agg(F.count("*").alias("n"))


CANDIDATES = (
    TRACKLETS.format(gap=GAP, least=LEAST)
    + """, p as (select a.sequence, a.id as lost_id, a.segment as lost_segment, b.id as new_id, b.segment as new_segment, a.frame_start as lost_frame_start, b.frame_start as new_frame_start,
        b.frame_start - a.frame_end - 1 as gap, sqrt((a.end_x - b.start_x) * (a.end_x - b.start_x) + (a.end_y - b.start_y) * (a.end_y - b.start_y)) as cd,
        a.end_x + a.end_vx * (b.frame_start - a.frame_end) - b.start_x as ex, a.end_y + a.end_vy * (b.frame_start - a.frame_end) - b.start_y as ey,
        greatest(a.mean_area, b.mean_area) / greatest(least(a.mean_area, b.mean_area), 1e-9) as ar, abs(a.mean_aspect_ratio - b.mean_aspect_ratio) as ad, least(a.mean_confidence, b.mean_confidence) as cf,
        len(list_intersect(a.class_ids, b.class_ids)) > 0 as cls, least(a.num_frames, b.num_frames) as nf
        from tr a join tr b on a.sequence = b.sequence and a.frame_end < b.frame_start and b.frame_start - a.frame_end - 1 <= 60),
    q as (select *, sqrt(ex * ex + ey * ey) as md, 900 + 1.25 * gap as rad from p),
    cand as (select sequence, lost_id, lost_segment, new_id, new_segment, lost_frame_start, new_frame_start, gap, round(cd, 6) as center_distance, round(md, 6) as motion_distance, round(ar, 6) as area_ratio, round(ad, 6) as aspect_delta,
        round((0.15::double * least(1, greatest(0, 1 - gap / 60.0::double)) + 0.2::double * least(1, greatest(0, 1 - md / rad)) + 0.15::double * least(1, greatest(0, 1 - cd / 900.0::double))
          + 0.2::double * case when ar <= 1 then 1 else least(1, greatest(0, 1 - (ar - 1) / 1.5::double)) end + 0.15::double * least(1, greatest(0, 1 - ad / 0.5::double)) + 0.15::double * least(1, greatest(0, cf))) / 1.0::double, 6) as score,
        cls and nf >= 3 and cf >= 0.55 and md <= rad and cd <= 900 and ar <= 2.5 and ad <= 0.5 as passes from q)"""
)


@query(CANDIDATES + " select * from cand")
def stitch_candidates(spark, sf):
    return stitch.candidates(_tracklets(spark, sf), LOOSE)


@query(CANDIDATES + """, r as (select *, row_number() over n as rank, lead(score) over n as runner_up from cand where passes window n as (partition by sequence, new_id, new_segment order by score desc, lost_frame_start, lost_id, lost_segment))
    select sequence, new_id, new_segment, lost_id, lost_segment, score, round(score - runner_up, 6) as margin from r where rank = 1""")
def stitch_top2_margin(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("sequence", "new_id", "new_segment").orderBy(F.desc("score"), "lost_frame_start", "lost_id", "lost_segment")
    df = stitch.candidates(_tracklets(spark, sf), LOOSE).where("passes").withColumn("r", F.row_number().over(order)).where("r <= 2")
    # the two best alone are exchanged
    df = df.withColumn("runner_up", F.lead("score").over(order)).where("r = 1")
    return df.select("sequence", "new_id", "new_segment", "lost_id", "lost_segment", "score", F.round(F.col("score") - F.col("runner_up"), 6).alias("margin"))


@query()
def stitch_decisions(spark, sf):
    return stitch.resolve(stitch.candidates(_tracklets(spark, sf), LOOSE), LOOSE)


@query()
def stitch_remap(spark, sf):
    return stitch.remap(predictions(spark, sf), _tracklets(spark, sf), stitch_decisions(spark, sf))


IOU = "case when {a}.w * {a}.h + {b}.w * {b}.h - i > 0 then i / ({a}.w * {a}.h + {b}.w * {b}.h - i) else 0 end"
INTER = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"


@query(f"""+ j as (select g.sequence, g.frame, g.class_id, g.id as gt_id, p.id as pred_id, {INTER.format(a="g", b="p")} as i, g.w * g.h + p.w * p.h as s
    from gt g join pred p on g.sequence = p.sequence and g.frame = p.frame and g.class_id = p.class_id)
    select sequence, frame, class_id, gt_id, pred_id, round(i / (s - i), 6) as iou from j where s - i > 0 and i / (s - i) >= 0.5""")
def iou_pairs(spark, sf):
    return evaluation.iou_pairs(truth(spark, sf), predictions(spark, sf))


NEAREST = """+ e as (select g.sequence, g.frame, g.id as gt_id, p.id as pred_id, round(sqrt(power(g.x + g.w / 2 - p.x - p.w / 2, 2) + power(g.y + g.h / 2 - p.y - p.h / 2, 2)), 6) as error
    from gt g left join pred p on g.sequence = p.sequence and g.frame = p.frame),
    near as (select sequence, frame, gt_id, pred_id, error from e qualify row_number() over (partition by sequence, frame, gt_id order by error nulls last, pred_id) = 1)"""


@query(NEAREST + " select * from near")
def nearest_boxes(spark, sf):
    return evaluation.nearest(truth(spark, sf), predictions(spark, sf))


@query(NEAREST + """ select coalesce(sequence, 'OVERALL') as sequence, count(*) as num_truth, count(error) as matched, count(*) - count(error) as missing,
    round(avg(error), 6) as mean_error, round(median(error), 6) as median_error, max(error) as max_error from near group by rollup (sequence)""")
def localization(spark, sf):
    return evaluation.localization(truth(spark, sf), predictions(spark, sf))


@query()
def mot_metrics(spark, sf):
    return clear_mot.metrics(truth(spark, sf), predictions(spark, sf))


@query("""+ a as (select sequence, frame, count(*) as num_truth from gt group by 1, 2), b as (select sequence, frame, count(*) as num_predicted from pred group by 1, 2)
    select sequence, frame, coalesce(num_truth, 0) as num_truth, coalesce(num_predicted, 0) as num_predicted from a full join b using (sequence, frame)""")
def frame_union(spark, sf):
    return evaluation.frame_union(truth(spark, sf), predictions(spark, sf))


@query("select coalesce(a.sequence, b.sequence) as sequence, case when b.sequence is null then 'missing_predicted' when a.sequence is null then 'missing_truth' else 'paired' end as status from (select distinct sequence from gt) a full join (select distinct sequence from pred where sequence <> 'AO') b on a.sequence = b.sequence")
def pairing_report(spark, sf):
    return evaluation.pairing(truth(spark, sf), predictions(spark, sf).where("sequence <> 'AO'"))


CLIP = "list_extract(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], (mmsi::bigint % 6 + 1)::bigint)"
ALIGNED = """+ grid as (select k + 1 as frame, k * 7.0::double as t from range(365) r(k)),
    iv as (select *, lag(ts) over o as lts, lag(x) over o as lx, lag(y) over o as ly, lag(angle) over o as la, lead(ts) over o is null as last from ais window o as (partition by mmsi order by ts)),
    al as (select mmsi, frame::int as frame, round(lx + (x - lx) * ((t - lts) / (ts - lts)), 6) as x, round(ly + (y - ly) * ((t - lts) / (ts - lts)), 6) as y, round(la + (angle - la) * ((t - lts) / (ts - lts)), 6) as angle, 'interpolated' as reason from iv join grid on t > lts and t <= ts and least(t - lts, ts - t) <= 60
        union all select mmsi, frame::int, round(x, 6), round(y, 6), round(angle, 6), 'nearest_first_record' from iv join grid on lts is null and t <= ts and ts - t <= 60
        union all select mmsi, frame::int, round(x, 6), round(y, 6), round(angle, 6), 'nearest_last_record' from iv join grid on last and t > ts and t - ts <= 60)"""


def _aligned(spark, sf, axes=("x", "y")):
    return transponder.align(reports(spark, sf), 365, 7.0, 60.0, axes)


@query(ALIGNED + " select * from al")
def ais_align(spark, sf):
    return _aligned(spark, sf, ("x", "y", "angle"))


def _weekly(spark, sf):
    # the grid of reports has a frame a week, the tracks one a day
    return predictions(spark, sf).withColumn("frame", (F.floor(F.col("frame") / 7) + 1).cast("int"))


@query(ALIGNED + f""", j as (select sequence, id, mmsi, count(*) as overlap, avg(least(1, greatest(0, 1 - sqrt(power(p.x + p.w / 2 - al.x, 2) + power(p.y + p.h / 2 - al.y, 2)) / 250.0::double))) as pos
        from (select * replace ((frame // 7 + 1)::int as frame) from pred) p join (select *, {CLIP} as clip from al) al on p.frame = al.frame and p.sequence = al.clip group by 1, 2, 3),
    s as (select *, round((pos + least(1.0::double, overlap / 5.0::double)) / 2, 6) as score from j)
    select sequence, id, case when score >= 0.6 then mmsi end as mmsi, score, overlap from s qualify row_number() over (partition by sequence, id order by score desc, mmsi) = 1""")
def ais_assign(spark, sf):
    clip = F.element_at(F.array(*map(F.lit, ("AF", "AO", "NF", "NO", "RF", "RO"))), (F.col("mmsi").cast("long") % 6 + 1).cast("int"))
    return transponder.assign(_weekly(spark, sf), _aligned(spark, sf).withColumn("sequence", clip))


SCORED = ALIGNED + f""", wk as (select sequence, id, (frame // 7 + 1)::int as frame, max_by(x + w / 2, frame) as cx, max_by(y + h / 2, frame) as cy from pred group by 1, 2, 3),
    clips as (select *, {CLIP} as clip from al),
    sg as (select sequence, id, mmsi, count(*) as overlap, avg(least(1.0::double, greatest(0.0::double, 1 - sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) / 250.0::double))) as near, avg(angle) as angle, greatest(max(wk.frame) - min(wk.frame), 1) as span,
        max_by(cx, wk.frame) - min_by(cx, wk.frame) as dx, max_by(cy, wk.frame) - min_by(cy, wk.frame) as dy, max_by(x, wk.frame) - min_by(x, wk.frame) as ex, max_by(y, wk.frame) - min_by(y, wk.frame) as ey
        from wk join clips on wk.frame = clips.frame and sequence = clip group by 1, 2, 3),
    sv as (select *, case when overlap >= 2 then sqrt(dx / span * (dx / span) + dy / span * (dy / span)) end as own, sqrt(ex / span * (ex / span) + ey / span * (ey / span)) as other, degrees(atan2(dy / span, dx / span)) - angle + 180 as t from sg),
    ss as (select sequence, id, mmsi, overlap, round(near, 6) as position, coalesce(case when own >= 1e-9 then 1 - abs(t - 360 * floor(t / 360) - 180) / 180 end, 0.5::double) as heading,
        coalesce(case when own is not null then greatest(0.0::double, 1 - abs(own - other) / greatest(own, other, 1e-9::double)) end, 0.5::double) as speed from sv),
    sc as (select sequence, id, mmsi, overlap, position, round(heading, 6) as heading, round(speed, 6) as speed, round((position + heading + speed + least(1.0::double, overlap / 5.0::double)) / 4 + 1e-9::double, 6) as score from ss)"""


def _clips(spark, sf):
    clip = F.element_at(F.array(*map(F.lit, ("AF", "AO", "NF", "NO", "RF", "RO"))), (F.col("mmsi").cast("long") % 6 + 1).cast("int"))
    return _aligned(spark, sf, ("x", "y", "angle")).withColumn("sequence", clip)


def _last_of_week(spark, sf):
    week = (F.floor(F.col("frame") / 7) + 1).cast("int")
    df = predictions(spark, sf).groupBy("sequence", "id", week.alias("week")).agg(F.max_by(F.struct(*"xywh"), "frame").alias("box"))
    return df.select("sequence", "id", F.col("week").alias("frame"), "box.*")


@query(SCORED + " select sequence, id, mmsi, overlap, position, heading, speed, score, '' as reason from sc")
def ais_scores(spark, sf):
    return transponder.pair_scores(_last_of_week(spark, sf), _clips(spark, sf))


@query(SCORED + """, met as (select sequence, id, count(*) as met from sc group by 1, 2), present as (select clip as sequence, count(distinct mmsi) as present from clips group by 1),
    top as (select * from sc qualify row_number() over (partition by sequence, id order by score desc, mmsi) = 1),
    every as (select *, top.score is null or (coalesce(present, 0) > coalesce(met, 0) and top.score < 0.5) as without from (select distinct sequence, id from wk) left join top using (sequence, id) left join met using (sequence, id) left join present using (sequence))
    select sequence, id, case when not without and score >= 0.6 then mmsi end as mmsi, case when without then 0 else overlap end as overlap, case when without then 0.5 else position end as position, case when without then 0.5 else heading end as heading,
        case when without then 0.5 else speed end as speed, case when without then 0.5 else score end as score, case when present is null then 'no_ais_coverage' when without then 'no_temporal_overlap' else '' end as reason from every""")
def ais_assign_by_scores(spark, sf):
    return transponder.assign_by_scores(_last_of_week(spark, sf), _clips(spark, sf))


BAND = f"""+ t(turn, shift) as (values (0, 0), (1, -1), (2, 1)),
    bj as (select p.sequence, p.frame, p.id, g.id as gt_id, shift, turn, {INTER.format(a="p", b="g")} as i, p.w * p.h + g.w * g.h as s from pred p cross join t join gt g on g.sequence = p.sequence and g.frame = p.frame + shift),
    bm as (select sequence, frame, id, gt_id, shift, round(i / (s - i), 6) as iou, i / (s - i) as exact_iou from bj where s - i > 0 and round(i / (s - i), 6) >= 0.1
        qualify row_number() over (partition by sequence, frame, id order by round(i / (s - i), 6) desc, turn, gt_id) = 1)"""
DOMINANT = BAND + """, dc as (select sequence, id, gt_id, count(*) as n, min(frame) as first, avg(exact_iou) as m from bm group by 1, 2, 3),
    dom as (select sequence, id, gt_id, n as num_matches, round(n / sum(n) over (partition by sequence, id), 6) as purity, round(m, 6) as mean_iou from dc
        qualify row_number() over (partition by sequence, id order by n desc, first, gt_id) = 1)"""


def _matched(spark, sf, true_boxes=truth):
    return transponder.band_match(predictions(spark, sf), true_boxes(spark, sf))


@query(BAND + " select * exclude (exact_iou) from bm")
def gt_iou_match(spark, sf):
    return _matched(spark, sf).drop("exact_iou")


@query(DOMINANT + " select * from dom")
def dominant_identity(spark, sf):
    return transponder.dominant(_matched(spark, sf))


@query(DOMINANT + " select sequence, gt_id, count(*) as num_tracks, count(*) - 1 as switches, round(avg(purity), 6) as mean_purity from dom group by 1, 2")
def fragmentation(spark, sf):
    return transponder.fragmentation(transponder.dominant(_matched(spark, sf)))


NORM = "(case when ({0}) + 180 - 360 * floor((({0}) + 180) / 360) - 180 = -180 then 180 else ({0}) + 180 - 360 * floor((({0}) + 180) / 360) - 180 end)"
STATES = f"""+ o2 as (select *, floor(frame / 200)::int as span, x + w / 2 as cx, y + h / 2 as cy from obs),
    st0 as (select sequence, span, id, max(frame) as frame, count(*) as observations, max_by(cx, frame) as px, max_by(cy, frame) as py,
        (max_by(cx, frame) - min_by(cx, frame)) / greatest(1, max(frame) - min(frame)) as vx, (max_by(cy, frame) - min_by(cy, frame)) / greatest(1, max(frame) - min(frame)) as vy from o2 group by 1, 2, 3),
    st as (select *, sqrt(vx * vx + vy * vy) as speed, case when vx = 0 and vy = 0 then 0 else {NORM.format("degrees(atan2(vy, vx))")} end as heading from st0)"""
SPAN = ["sequence", "span"]


def _states(spark, sf):
    return encounters.vessel_states(observations(spark, sf).withColumn("span", F.floor(F.col("frame") / 200).cast("int")), SPAN)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(STATES + " select sequence, span, id, frame, observations, round(px, 6) as px, round(py, 6) as py, round(vx, 6) as vx, round(vy, 6) as vy, round(speed, 6) as speed, round(heading, 6) as heading from st")
def vessel_state(spark, sf):
    return _rounded(_states(spark, sf), "px", "py", "vx", "vy", "speed", "heading")


RISK = STATES + """, r0 as (select a.sequence, a.span, a.id as own_id, b.id as other_id, b.px - a.px as rx, b.py - a.py as ry, b.vx - a.vx as rvx, b.vy - a.vy as rvy from st a join st b on a.sequence = b.sequence and a.span = b.span and a.id < b.id),
    r1 as (select *, sqrt(rx * rx + ry * ry) as d, sqrt(rvx * rvx + rvy * rvy) as rs from r0),
    r2 as (select *, greatest(0, least(30, case when rs <= 1e-9 then 0 else -(rx * rvx + ry * rvy) / greatest(rs * rs, 1e-9) end)) as t from r1),
    r3 as (select *, round(sqrt((rx + rvx * t) * (rx + rvx * t) + (ry + rvy * t) * (ry + rvy * t)), 6) as closest_distance, round(t, 6) as frames_to_closest, round(rs, 6) as relative_speed from r2),
    r4 as (select *, round(least(1, greatest(0, 0.45::double * least(1, greatest(0, 1 - d / 250)) + 0.4::double * least(1, greatest(0, 1 - closest_distance / 250)) + 0.15::double * least(1, greatest(0, relative_speed / 0.5::double))
        + case when frames_to_closest > 0 then 0.15::double * least(1, greatest(0, 1 - closest_distance / 250)) else 0 end)) + 1e-9::double, 6) as risk from r3),
    near as (select * from r4 where d <= 250 or (closest_distance <= 250 and relative_speed >= 0.5) or risk >= 0.2)"""


@query(RISK + " select sequence, span, own_id, other_id, round(d, 6) as distance, closest_distance, frames_to_closest, relative_speed, risk, true as candidate from near")
def closest_approach_risk(spark, sf):
    """All candidate pairs."""
    df = encounters.candidate_pairs(_states(spark, sf), SPAN)
    return df.select(*SPAN, "own_id", "other_id", "distance", "closest_distance", "frames_to_closest", "relative_speed", "risk", "candidate")


ENCOUNTER = RISK + f""", c0 as (select a.sequence, a.span, a.id as own_id, b.id as other_id, least(a.observations, b.observations) as obs_n, least(a.speed, b.speed) as slow, a.speed as own_speed, b.speed as other_speed,
        {NORM.format("degrees(atan2(b.py - a.py, b.px - a.px)) - a.heading")} as bearing, {NORM.format("degrees(atan2(a.py - b.py, a.px - b.px)) - b.heading")} as back, abs({NORM.format("a.heading - b.heading")}) as turn,
        (b.px - a.px) * (b.vx - a.vx) + (b.py - a.py) * (b.vy - a.vy) < 0 as closing, sqrt((b.px - a.px) * (b.px - a.px) + (b.py - a.py) * (b.py - a.py)) as d
        from (select sequence, span, own_id, other_id from near union all select sequence, span, other_id, own_id from near) n
        join st a on a.sequence = n.sequence and a.span = n.span and a.id = own_id join st b on b.sequence = n.sequence and b.span = n.span and b.id = other_id),
    c1 as (select *, abs(180 - turn) as err from c0),
    c2 as (select *, case when obs_n < 3 or slow <= 1e-6 then 'UNKNOWN' when err <= 20 and abs(bearing) <= 20 and abs(back) <= 20 and closing then 'HEAD_ON'
        when turn <= 45 and abs(back) >= 112.5 and own_speed > other_speed then 'OVERTAKING' when turn > 25 and err > 20 and bearing between 15 and 112.5 then 'CROSSING_GIVE_WAY'
        when turn > 25 and err > 20 and bearing between -112.5 and -15 then 'CROSSING_STAND_ON' else 'NO_INTERACTION' end as kind from c1),
    c3 as (select *, round(least(1, greatest(0, case when kind = 'UNKNOWN' then 0 when kind = 'HEAD_ON' then 0.65::double + 0.35::double * (1 - (err + abs(bearing) + abs(back)) / 60)
        when kind = 'OVERTAKING' then 0.65::double + 0.2::double * least((abs(back) - 112.5) / 67.5::double, 1) + 0.15::double * least((own_speed - other_speed) / greatest(other_speed, 1e-9), 1)
        when kind like 'CROSSING%' then least(1, 1 - least(abs(abs(bearing) - 63.75) / 48.75::double, 1) * 0.25::double + case when closing then 0.05::double else 0 end)
        else greatest(0.1, least(0.45, 1 - d / 250)) end)), 6) as confidence from c2)"""


def _met(spark, sf):
    pairs = encounters.candidate_pairs(_states(spark, sf), SPAN).drop("distance", "closest_distance", "frames_to_closest", "relative_speed", "risk", "candidate")
    return encounters.classify(encounters.cut(encounters.both_ways(pairs)))


@query(ENCOUNTER + " select sequence, span, own_id, other_id, round(bearing, 6) as bearing, round(turn, 6) as turn, case when kind not in ('UNKNOWN', 'NO_INTERACTION') and confidence < 0.6 then 'UNKNOWN' else kind end as encounter, confidence from c3")
def classify_encounter(spark, sf):
    """Encounters of all candidate pairs, as seen from either vessel."""
    return _met(spark, sf).select(*SPAN, "own_id", "other_id", "bearing", "turn", "encounter", "confidence")


PRIORS = ENCOUNTER + f""", k0 as (select sequence, span, own_id, other_id, case when kind not in ('UNKNOWN', 'NO_INTERACTION') and confidence < 0.6 then 'UNKNOWN' else kind end as encounter from c3),
    k1 as (select k0.*, s.* exclude (sequence, span, id), case when encounter in ('HEAD_ON', 'CROSSING_GIVE_WAY') then 5 else 0 end as yaw, case when encounter = 'CROSSING_GIVE_WAY' then 0.85::double else 1 end as slow, case when encounter = 'OVERTAKING' then 20 else 0 end as side,
        case encounter when 'HEAD_ON' then 12 when 'CROSSING_GIVE_WAY' then 15 when 'CROSSING_STAND_ON' then 8 when 'OVERTAKING' then 14 else 20 end::double as sh from k0 join st s on s.sequence = k0.sequence and s.span = k0.span and s.id = k0.own_id),
    k2 as (select *, {NORM.format("heading + yaw")} as ph, speed * slow as ps, cos(radians(heading + 90)) as ax, sin(radians(heading + 90)) as ay, round(greatest(5, speed * 2), 6) as sigma from k1)"""


@query(PRIORS + """ select sequence, span, own_id, other_id, encounter, round(px + cos(radians(ph)) * ps * 10 + ax * side, 6) as prior_px, round(py + sin(radians(ph)) * ps * 10 + ay * side, 6) as prior_py,
    round(ps, 6) as prior_speed, round(ph, 6) as prior_heading, sigma as prior_sigma, sh as prior_sigma_heading from k2""")
def motion_priors(spark, sf):
    numbers = ["prior_px", "prior_py", "prior_speed", "prior_heading", "prior_sigma", "prior_sigma_heading"]
    df = priors.predict(encounters.cut(_met(spark, sf)), F.lit(10)).select(*SPAN, "own_id", "other_id", "encounter", *numbers)
    for some in (numbers[:2], numbers[2:4]):  # the spreads are rounded
        df = encounters.cut(df).withColumns({c: round_six(F.col(c)) for c in some})
    return df


@query(PRIORS + f""", k3 as (select k2.*, n.px as sx, n.py as sy, n.speed as ss, n.heading as sg, greatest(1, n.frame - k2.frame) as dt, {NORM.format("n.heading - k2.heading")} as turned, {NORM.format("n.heading - ph")} as off
        from k2 join st n on n.sequence = k2.sequence and n.span = k2.span + 1 and n.id = k2.own_id),
    k4 as (select *, greatest(0.0::double, 1 - sqrt(power(sx - (px + cos(radians(ph)) * ps * dt + ax * side), 2) + power(sy - (py + sin(radians(ph)) * ps * dt + ay * side), 2)) / (sigma * 3)) as pos, greatest(0.0::double, 1 - abs(off) / (sh * 3)) as hd,
        case when ps <= 1e-9 then (ss <= 1e-9)::int::double else greatest(0.0::double, 1 - abs(ss / ps - 1) / 0.35::double) end as sp, least(1.0::double, greatest(0.0::double, (turned + 5) / 10)) as star, case when ss <= speed * 0.9::double then 1 else 0.5::double end as slowed,
        least(1.0::double, abs((sx - px - vx * dt) * ax + (sy - py - vy * dt) * ay) / 20) as aside, greatest(0.0::double, 1 - abs(turned) / 10) as kh, case when speed <= 1e-9 then (ss <= 1e-9)::int::double else greatest(0.0::double, 1 - abs(ss / speed - 1) / 0.2::double) end as ks from k3)
    select sequence, span, own_id, other_id, encounter, coalesce(round(case encounter when 'HEAD_ON' then pos + hd + star when 'CROSSING_GIVE_WAY' then pos + greatest(star, slowed) + sp when 'CROSSING_STAND_ON' then kh + ks + pos when 'OVERTAKING' then pos + aside + sp end / 3 + 1e-9::double, 6), 0.5::double) as consistency from k4""")
def motion_consistency(spark, sf):
    later = _states(spark, sf).select("sequence", (F.col("span") - 1).alias("span"), F.col("id").alias("own_id"), *[F.col(k).alias(f"seen_{k}") for k in ("frame", "px", "py", "speed", "heading")])
    df = priors.consistency(_met(spark, sf).join(later, [*SPAN, "own_id"]))
    return df.select(*SPAN, "own_id", "other_id", "encounter", "consistency")


HIDDEN = """+ h0 as (select sequence, id, frame, w, h, x + w / 2 as cx, y + h / 2 as cy from pred),
    h1 as (select *, coalesce((cx - lag(cx) over o) / greatest(1, frame - lag(frame) over o), 0) as vx, coalesce((cy - lag(cy) over o) / greatest(1, frame - lag(frame) over o), 0) as vy, lead(frame) over o as nxt from h0 window o as (partition by sequence, id order by frame)),
    hid as (select sequence, id, (frame + g)::int as frame, g::int as gap, round(cx + vx * g, 6) as predicted_x, round(cy + vy * g, 6) as predicted_y, round(12 + 3.5::double * g, 6) as uncertainty, round((12 + 3.5::double * g) * sqrt(2.0::double), 6) as radius,
        case when g > 5 then 'OCCLUDED' else 'TEMPORARILY_LOST' end as state from h1 join range(1, 31) r(g) on g < nxt - frame)"""


@query(HIDDEN + " select * from hid")
def gap_predictions(spark, sf):
    return occlusion.gap_predictions(predictions(spark, sf))


@query(HIDDEN + """ select coalesce(sequence, 'OVERALL') as sequence, count(*) as predictions, count(distinct id) as tracks, count(*) filter (state = 'OCCLUDED') as occluded,
    round(avg(uncertainty), 6) as mean_uncertainty, max(gap) as max_gap from hid group by rollup (sequence)""")
def occlusion_summary(spark, sf):
    return occlusion.summary(occlusion.gap_predictions(predictions(spark, sf)))


@query("select sequence, id, frame, gap from (select *, frame - lag(frame) over (partition by sequence, id order by frame) - 1 as gap from pred) where gap > 0")
def reappearances(spark, sf):
    return occlusion.reappearances(predictions(spark, sf))


OCCLUDERS = HIDDEN + """, fast as (select h1.sequence, h1.id, h1.frame + g as frame, g, h1.w, h1.h, vx, vy, round(cx + vx * g, 6) as px, round(cy + vy * g, 6) as py from h1 join range(1, 31) r(g) on g < nxt - h1.frame),
    oc as (select f.sequence, f.id, f.frame::int as frame, s.id as occluder_id, px - f.w / 2 as x, py - f.h / 2 as y, f.w, f.h, s.vx as svx, s.vy as svy, s.cx - s.w / 2 as sx, s.cy - s.h / 2 as sy, s.w as sw, s.h as sh,
        greatest(0, 1 - sqrt((px - s.cx) * (px - s.cx) + (py - s.cy) * (py - s.cy)) / (greatest(f.w, f.h, s.w, s.h, 1) * 1.75::double)) as near,
        least(1, sqrt((f.vx - s.vx) * (f.vx - s.vx) + (f.vy - s.vy) * (f.vy - s.vy)) / greatest(sqrt(f.vx * f.vx + f.vy * f.vy) + sqrt(s.vx * s.vx + s.vy * s.vy), 1)) as motion
        from fast f join h1 s on s.sequence = f.sequence and s.frame = f.frame and s.id <> f.id),
    oi as (select *, greatest(0, least(x + w, sx + sw) - greatest(x, sx)) * greatest(0, least(y + h, sy + sh) - greatest(y, sy)) as i from oc where near > 0),
    of as (select *, round(0.45::double * case when w * h + sw * sh - i > 0 then i / (w * h + sw * sh - i) else 0 end + 0.4::double * near + 0.15::double * motion + 1e-9::double, 6) as confidence from oi)"""
BEST = "select {out} from of where confidence >= 0.2 qualify row_number() over (partition by sequence, id, frame order by confidence desc, occluder_id) = 1"


@query(f"{OCCLUDERS} {BEST.format(out='sequence, id, frame, occluder_id, confidence')}")
def occluder_pairs(spark, sf):
    return occlusion.occluders(predictions(spark, sf))


def _cameras(spark, sf):
    return observations(spark, sf), predictions(spark, sf)


@query("""+ a as (select sequence, frame, id as a_id, row_number() over (partition by sequence, frame order by x + w / 2, id) as rank, count(*) over (partition by sequence, frame) as n from obs),
    b as (select sequence, frame, id as b_id, row_number() over (partition by sequence, frame order by x + w / 2, id) as rank, count(*) over (partition by sequence, frame) as n from pred)
    select sequence, frame, rank, a_id, b_id from a join b using (sequence, frame, rank, n)""")
def rank_x_pairs(spark, sf):
    return cameras.ranked_pairs(*_cameras(spark, sf))


@query("""+ j as (select a.sequence, a.frame, a.id as a_id, b.id as b_id, round(sqrt(power((a.x + a.w / 2) / 1920 - (b.x + b.w / 2) / 1920, 2) + power((a.y + a.h / 2) / 1080 - (b.y + b.h / 2) / 1080, 2)), 6) as distance
    from obs a join pred b on a.sequence = b.sequence and a.frame = b.frame) select * from j where distance <= 0.55""")
def center_distance_candidates(spark, sf):
    return cameras.near_pairs(*_cameras(spark, sf))


@query()
def fuse_cameras(spark, sf):
    a, b = _cameras(spark, sf)
    return cameras.fuse(a, b, cameras.paired(a, b))


def _detectors(spark, sf):
    first, second = observations(spark, sf), predictions(spark, sf)
    return first.withColumn("source", F.lit("primary")).unionByName(second.withColumns({"id": F.col("id") + 100000, "source": F.lit("secondary")}))


NMS = """+ bx as (select *, row_number() over (partition by sequence, frame order by confidence desc, id) as k
           from (select *, 'primary' as source from obs union all select * replace (id + 100000 as id), 'secondary' as source from pred)),
    walk as (select sequence, frame, k, [{'k': k, 'x': x, 'y': y, 'w': w, 'h': h}] as kept, null::bigint as by_k from bx where k = 1
        union all select b.sequence, b.frame, b.k, case when o is null then list_append(kept, {'k': b.k, 'x': x, 'y': y, 'w': w, 'h': h}) else kept end, o
        from (select b.*, kept, list_filter(kept, lambda a: greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))
                  / (a.w * a.h + b.w * b.h - greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))) >= 0.55::double)[1].k as o
              from walk join bx b on b.sequence = walk.sequence and b.frame = walk.frame and b.k = walk.k + 1) b),
    stands as (select sequence, frame, coalesce(by_k, k) as k, count(*) - 1 as absorbed, string_agg(distinct source, ',' order by source) as sources from walk join bx using (sequence, frame, k) group by 1, 2, 3),
    fused as (select bx.* exclude (k), absorbed, sources from bx join stands using (sequence, frame, k))"""


@query(NMS + " select * from fused")
def union_nms(spark, sf):
    """Boxes of two detectors as one set."""
    return cameras.union_nms(_detectors(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query(
    NMS
    + """, n as (select sequence, count(*) as boxes, round(avg(confidence), 6) as mean_confidence from bx group by 1)
    select sequence, boxes, mean_confidence, count(*) as fused, sum(absorbed)::bigint as duplicates_removed, count(*) filter (sources like '%,%') as mixed, round(avg(confidence), 6) as mean_fused_confidence,
           count(*) filter (sources = 'primary') as only_primary, count(*) filter (sources = 'secondary') as only_secondary from fused join n using (sequence) group by 1, 2, 3"""
)
def fusion_stats(spark, sf):
    """What the fusion of two detectors removed."""
    boxes = _detectors(spark, sf)
    df = cameras.fusion_stats(boxes, cameras.union_nms(boxes))
    return df.withColumns({f"only_{s}": F.coalesce(F.col("alone")[s], F.lit(0)) for s in ("primary", "secondary")}).drop("alone")


for _name in ("union_nms", "fusion_stats"):
    ORACLES[_name] = ORACLES[_name].replace("with", "with recursive", 1)


@query("select a.vec_id as a_id, b.vec_id as b_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0")
def cosine_similarity(spark, sf):
    return appearance.similarities(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("vec_id") % 20 == 0, "vec_id", "embedding")


@query("select label, (dim - 1)::int as dim, round(avg(v), 6) as mean from (select label, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding)::double as v from embeddings) group by 1, 2")
def appearance_prototypes(spark, sf):
    return appearance.prototypes(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", "embedding")


from trackspark import queries_live, queries_motion  # noqa: E402, F401  add their queries
