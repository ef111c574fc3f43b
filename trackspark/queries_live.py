"""Queries on live re-identification and replay, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from trackspark.operators import annotate, ledger, occlusion, replay, zoom
from trackspark.operators.encounters import EncounterConfig
from trackspark.plans.observations import predictions
from trackspark.plans.storage import checkpoint
from trackspark.queries import HIDDEN, NORM, ORACLES, QUERIES, query

LIVE = ledger.LedgerConfig()


def _live(spark, sf):
    return ledger.live_identities(predictions(spark, sf), LIVE)


#: Runs of existing frames, decisions and lost runs; ``confirm``, ``tail`` and ``box`` are numbers of rows.
RUNS = """+ frames as (select sequence, frame, row_number() over s as k, lead(frame) over s as next_frame, max(frame) over (partition by sequence) as final_frame
               from (select distinct sequence, frame from pred) window s as (partition by sequence order by frame)),
    rows_of as (select p.*, x + w / 2 as cx, y + h / 2 as cy, k, next_frame, final_frame, coalesce(k - lag(k) over t > 1, true)::int as starts
                from pred p join frames using (sequence, frame) window t as (partition by sequence, id order by k, x, y)),
    numbered as (select *, sum(starts) over (partition by sequence, id order by k, x, y rows unbounded preceding) as run from rows_of),
    seen as (select *, row_number() over (partition by sequence, id, run order by k, x, y) as place, count(*) over (partition by sequence, id, run) as n from numbered),
    due as (select *, case when confirmed is not null then 2 when absent is not null then 0 else 3 end as phase, coalesce(confirmed, absent, final_frame) as decision_frame,
                   coalesce(confirmed, case when absent is not null then last_seen end, final_frame) as checked
            from (select sequence, id, min(frame) as first_frame, max(frame) as last_seen, max_by(next_frame, place) as absent, max(final_frame) as final_frame, max(frame) filter (place = {confirm}) as confirmed,
                         min_by(class_id, place) as class_id, round(avg(w) filter (place <= {confirm}), 6) as hw, round(avg(h) filter (place <= {confirm}), 6) as hh,
                         round(avg(cx) filter (place <= {confirm}), 6) as hx, round(avg(cy) filter (place <= {confirm}), 6) as hy
                  from seen where run = 1 group by 1, 2)),
    lost as (select *, lead(run_start) over (partition by sequence, id order by run) as returns
             from (select sequence, id, run, min(frame) as run_start, max(frame) as last_frame, max_by(next_frame, place) as lost_at, max_by(class_id, place) as class_id, max_by(cx, place) as lx, max_by(cy, place) as ly,
                          round(avg(w) filter (n - place < {box}), 6) as tw, round(avg(h) filter (n - place < {box}), 6) as th,
                          round((max_by(cx, place) - min_by(cx, place) filter (n - place < {tail})) / greatest(1, max(frame) - min(frame) filter (n - place < {tail})), 6) as vx,
                          round((max_by(cy, place) - min_by(cy, place) filter (n - place < {tail})) / greatest(1, max(frame) - min(frame) filter (n - place < {tail})), 6) as vy
                   from seen group by 1, 2, 3))"""


PAIRS = """,
    pairs as (select d.sequence, d.id as new_id, l.id as lost_id, l.run::int as lost_run, d.first_frame, d.decision_frame, d.phase, case d.phase when 2 then 0 else d.first_frame end as turn, hx, hy, hw, hh, lx, ly, vx, vy, tw, th,
                     greatest(0, d.first_frame - l.last_frame - 1) as gap, greatest(1, d.first_frame - l.last_frame) as elapsed
              from due d join lost l on l.sequence = d.sequence and l.class_id = d.class_id and l.id <> d.id and l.lost_at <= d.checked and d.checked <= l.last_frame + 901
              where l.lost_at is not null and (l.returns is null or l.returns > d.decision_frame or (l.returns = d.decision_frame and (d.phase = 0 or (d.phase = 2 and l.id > d.id))))),
    measured as (select *, sqrt((lx - hx) ** 2 + (ly - hy) ** 2) as dd, sqrt((lx + vx * elapsed - hx) ** 2 + (ly + vy * elapsed - hy) ** 2) as md, 100 + 1.25::double * gap as radius,
                        greatest(tw * th, hw * hh, 1e-9) / greatest(least(tw * th, hw * hh), 1e-9) as ar, abs(tw / greatest(th, 1e-9) - hw / greatest(hh, 1e-9)) as ad from pairs)
    select sequence, new_id, lost_id, lost_run, first_frame, decision_frame, phase, turn, gap, round(dd + 1e-9::double, 6) as direct_distance, round(md + 1e-9::double, 6) as motion_distance,
           round(ar + 1e-9::double, 6) as area_ratio, round(ad + 1e-9::double, 6) as aspect_delta,
           round((greatest(0, 1 - gap / 900.0::double) + greatest(0, 1 - least(dd, md) / greatest(300, radius)) + greatest(0, least(1, 1 - (ar - 1) / 1.5::double)) + greatest(0, 1 - ad / 0.5::double)) / 4 + 1e-9::double, 6) as score
    from measured where gap <= 900 and (md <= radius or dd <= 300) and ar <= 2.5::double and ad <= 0.5::double"""


@query(RUNS.format(confirm=10, tail=10, box=10) + PAIRS)
def live_eligible(spark, sf):
    """Decisions and the lost runs that they may continue, before earlier choices use any up."""
    seen = ledger.sightings(predictions(spark, sf))
    return ledger.eligible_pairs(ledger.decisions_due(seen, LIVE), ledger.lost_runs(seen, LIVE), LIVE)


@query()
def live_reid(spark, sf):
    """Identity of each id."""
    return _live(spark, sf)[0]


@query()
def live_decisions(spark, sf):
    """Every eligible candidate with what became of it."""
    return _live(spark, sf)[1]


@query()
def live_rows(spark, sf):
    """Rows under their identities."""
    return ledger.remapped(predictions(spark, sf), _live(spark, sf)[0])


@query()
def live_summary(spark, sf):
    """Counts by sequence."""
    return ledger.summary(*_live(spark, sf))


@query(RUNS.format(confirm=1, tail=2, box=1) + PAIRS)
def replay_eligible(spark, sf):
    """New ids and the lost runs that they may continue at their first row."""
    return replay.replay_pairs(ledger.sightings(predictions(spark, sf)), LIVE)


@query(
    RUNS.format(confirm=1, tail=2, box=1)
    + """, cells as (select sequence, id, run, place, n, w * h as area, case when h > 0 then w / h else 0 end as aspect from seen),
    kept as (select *, round(area, 6) as mean_area, round(aspect, 6) as mean_aspect from cells where place = 1
             union all select c.*, round((k.mean_area * k.place + c.area) / c.place + 1e-9::double, 6), round((k.mean_aspect * k.place + c.aspect) / c.place + 1e-9::double, 6)
             from kept k join cells c on c.sequence = k.sequence and c.id = k.id and c.run = k.run and c.place = k.place + 1)
    select sequence, id, run::int as run, n as rows, mean_area, mean_aspect as mean_aspect_ratio from kept where place = n"""
)
def replay_states(spark, sf):
    """Running means of each run, rounded row by row."""
    return replay.track_states(ledger.sightings(predictions(spark, sf))).select("sequence", "id", "run", "rows", "mean_area", "mean_aspect_ratio")


ORACLES["replay_states"] = ORACLES["replay_states"].replace("with", "with recursive", 1)


@query()
def replay_reid(spark, sf):
    """Identity of each id by replay."""
    return replay.replay(predictions(spark, sf), LIVE)[0]


@query()
def replay_decisions(spark, sf):
    """Every eligible candidate of the replay with what became of it."""
    return replay.replay(predictions(spark, sf), LIVE)[1]


def _annotated(spark, sf):
    seen = checkpoint(ledger.sightings(predictions(spark, sf).select("sequence", "frame", "id", "x", "y", "w", "h", "class_id")))
    due = checkpoint(ledger.decisions_due(seen, LIVE))
    lost = checkpoint(ledger.still_asked(ledger.lost_runs(seen, LIVE), due))
    return annotate.annotated(ledger.eligible_pairs(due, lost, LIVE), seen, LIVE, rules=EncounterConfig(min_observations=2)), due, lost


@query()
def live_annotated(spark, sf):
    """Eligible candidates with the encounter of both ends."""
    return _annotated(spark, sf)[0]


@query()
def live_tie_breaks(spark, sf):
    """Decisions where the bonus of a candidate may break ties."""
    pairs, due, lost = _annotated(spark, sf)
    config = replace(LIVE, tie_break_margin=0.05)
    return ledger.decisions(due, lost, ledger.choices(pairs, config), config)


@query()
def live_transponders(spark, sf):
    """Eligible candidates with what transponders say of both ids."""
    seen = ledger.sightings(predictions(spark, sf))
    pairs = ledger.eligible_pairs(ledger.decisions_due(seen, LIVE), ledger.lost_runs(seen, LIVE), LIVE)
    return annotate.with_transponders(pairs, QUERIES["ais_assign_by_scores"](spark, sf))


_MEANS = ", ".join(f"coalesce(round((n.{p} + l.{p}) / 2 + 1e-9::double, 6), n.{p}, l.{p}, 0.5::double) as ais_{p}" for p in ("position", "heading", "speed"))
ORACLES["live_transponders"] = f"""
    with assigned as ({ORACLES["ais_assign_by_scores"]}), pairs as ({ORACLES["live_eligible"]})
    select p.*, n.mmsi as new_mmsi, l.mmsi as lost_mmsi, coalesce(n.score, 0.5::double) as new_mmsi_score, coalesce(l.score, 0.5::double) as lost_mmsi_score, {_MEANS},
           case when n.mmsi = l.mmsi then 1.0::double when n.mmsi <> l.mmsi then 0.0::double else 0.5::double end as identity_score,
           case when n.mmsi = l.mmsi then 'mmsi_match' when n.mmsi <> l.mmsi then 'mmsi_mismatch_reporting_only' else 'missing_ais_assignment_neutral' end as identity_note
    from pairs p left join assigned n on n.sequence = p.sequence and n.id = p.new_id left join assigned l on l.sequence = p.sequence and l.id = p.lost_id"""


@query(
    HIDDEN
    + """ select p.sequence, p.id, p.frame, case when back >= p.frame then back end as reappearance_frame from hid p left join
       (select sequence, id, max(frame) as back from (select *, frame - lag(frame) over (partition by sequence, id order by frame) as step from pred) where step > 1 group by 1, 2) using (sequence, id)"""
)
def occlusion_returns(spark, sf):
    """Predictions of hidden tracks with the frame in which their id is seen again."""
    return occlusion.hidden_returns(predictions(spark, sf))


@query()
def occlusion_recovery(spark, sf):
    """Predictions of hidden tracks with what became of them."""
    tracks = predictions(spark, sf)
    due, _, chosen = ledger.settled(tracks, LIVE)
    return occlusion.hidden_recoveries(tracks, ledger.identities(due, chosen), chosen)


ROI = (
    HIDDEN
    + """, un as (select sequence, frame, min(predicted_x - radius) as x1, min(predicted_y - radius) as y1, max(predicted_x + radius) as x2, max(predicted_y + radius) as y2 from hid group by 1, 2),
    pad as (select *, (x1 + x2) / 2 as mx, (y1 + y2) / 2 as my, least(greatest((x2 - x1) * 1.6::double, 160), 1920) as pw, least(greatest((y2 - y1) * 1.6::double, 160), 1080) as ph from un),
    lo as (select *, greatest(0, least(round_even(mx - pw / 2, 0)::int, 1918)) as a, greatest(0, least(round_even(my - ph / 2, 0)::int, 1078)) as b from pad),
    roi as (select sequence, frame, a as x1, b as y1, greatest(a + 1, least(round_even(mx + pw / 2, 0)::int, greatest(1920, a + 1))) as x2, greatest(b + 1, least(round_even(my + ph / 2, 0)::int, greatest(1080, b + 1))) as y2 from lo)"""
)


def _regions(spark, sf):
    return zoom.regions(occlusion.hidden_rects(predictions(spark, sf)))


@query(ROI + " select * from roi")
def zoom_regions(spark, sf):
    """The region around the hidden tracks of each frame."""
    return _regions(spark, sf)


@query(
    ROI
    + """, turned as (select *, row_number() over (partition by sequence order by frame) as k from roi),
    walk as (select * from turned where k = 1 union all
        select t.sequence, t.frame, round_even(w.x1 * 0.75::double + t.x1 * 0.25::double, 0)::int, round_even(w.y1 * 0.75::double + t.y1 * 0.25::double, 0)::int,
               round_even(w.x2 * 0.75::double + t.x2 * 0.25::double, 0)::int, round_even(w.y2 * 0.75::double + t.y2 * 0.25::double, 0)::int, t.k
        from walk w join turned t on t.sequence = w.sequence and t.k = w.k + 1)
    select * exclude (k) from walk"""
)
def zoom_smoothed(spark, sf):
    """The same, smoothed along each sequence."""
    return zoom.smoothed(_regions(spark, sf))


ORACLES["zoom_smoothed"] = ORACLES["zoom_smoothed"].replace("with", "with recursive", 1)


#: Encounters of the lost vessel's last rows and the new one's first, by the rules of ``queries.RISK``, ``ENCOUNTER`` and ``PRIORS``.
ENDS = """, own as (select sequence, id as lost_id, run::int as lost_run, max_by(frame, place) as frame, count(*) as n, max_by(cx, place) as px, max_by(cy, place) as py,
            (max_by(cx, place) - min_by(cx, place)) / greatest(1, max_by(frame, place) - min_by(frame, place)) as vx, (max_by(cy, place) - min_by(cy, place)) / greatest(1, max_by(frame, place) - min_by(frame, place)) as vy
            from seen s where s.n - place < 10 group by 1, 2, 3 having count(*) >= 2),
    oth as (select sequence, id as new_id, max_by(frame, place) as frame, count(*) as n, max_by(cx, place) as px, max_by(cy, place) as py,
            (max_by(cx, place) - min_by(cx, place)) / greatest(1, max_by(frame, place) - min_by(frame, place)) as vx, (max_by(cy, place) - min_by(cy, place)) / greatest(1, max_by(frame, place) - min_by(frame, place)) as vy
            from seen where run = 1 and place <= 10 group by 1, 2 having count(*) >= 2),
    b0 as (select sequence, new_id, lost_id, lost_run, a.frame as fa, b.frame as fb, a.px as ax, a.py as ay, a.vx as avx, a.vy as avy, b.px as bx, b.py as by_, b.vx as bvx, b.vy as bvy, least(a.n, b.n) as obs_n,
                  sqrt(a.vx * a.vx + a.vy * a.vy) as sa, sqrt(b.vx * b.vx + b.vy * b.vy) as sb, case when a.vx = 0 and a.vy = 0 then 0 else {norm_a} end as ha, case when b.vx = 0 and b.vy = 0 then 0 else {norm_b} end as hb
           from cands join own a using (sequence, lost_id, lost_run) join oth b using (sequence, new_id)),
    b1 as (select *, bx - ax as rx, by_ - ay as ry, bvx - avx as rvx, bvy - avy as rvy, {bearing} as bearing, {back} as back, abs({turn}) as turn from b0),
    b2 as (select *, sqrt(rx * rx + ry * ry) as d, sqrt(rvx * rvx + rvy * rvy) as rs, abs(180 - turn) as err, rx * rvx + ry * rvy < 0 as closing from b1),
    b3 as (select *, greatest(0, least(30, case when rs <= 1e-9 then 0 else -(rx * rvx + ry * rvy) / greatest(rs * rs, 1e-9) end)) as t from b2),
    b4 as (select *, round(sqrt((rx + rvx * t) * (rx + rvx * t) + (ry + rvy * t) * (ry + rvy * t)), 6) as closest_distance, round(t, 6) as frames_to_closest, round(rs, 6) as relative_speed,
        case when obs_n < 2 or least(sa, sb) <= 1e-6 then 'UNKNOWN' when err <= 20 and abs(bearing) <= 20 and abs(back) <= 20 and closing then 'HEAD_ON' when turn <= 45 and abs(back) >= 112.5 and sa > sb then 'OVERTAKING'
        when turn > 25 and err > 20 and bearing between 15 and 112.5 then 'CROSSING_GIVE_WAY' when turn > 25 and err > 20 and bearing between -112.5 and -15 then 'CROSSING_STAND_ON' else 'NO_INTERACTION' end as kind from b3),
    b5 as (select *, round(least(1, greatest(0, 0.45::double * least(1, greatest(0, 1 - d / 250)) + 0.4::double * least(1, greatest(0, 1 - closest_distance / 250)) + 0.15::double * least(1, greatest(0, relative_speed / 0.5::double))
        + case when frames_to_closest > 0 then 0.15::double * least(1, greatest(0, 1 - closest_distance / 250)) else 0 end)) + 1e-9::double, 6) as risk,
        round(least(1, greatest(0, case when kind = 'UNKNOWN' then 0 when kind = 'HEAD_ON' then 0.65::double + 0.35::double * (1 - (err + abs(bearing) + abs(back)) / 60)
        when kind = 'OVERTAKING' then 0.65::double + 0.2::double * least((abs(back) - 112.5) / 67.5::double, 1) + 0.15::double * least((sa - sb) / greatest(sb, 1e-9), 1)
        when kind like 'CROSSING%' then least(1, 1 - least(abs(abs(bearing) - 63.75) / 48.75::double, 1) * 0.25::double + case when closing then 0.05::double else 0 end)
        else greatest(0.1, least(0.45, 1 - d / 250)) end)), 6) as confidence from b4),
    b6 as (select *, case when kind not in ('UNKNOWN', 'NO_INTERACTION') and confidence < 0.6 then 'UNKNOWN' else kind end as encounter, d <= 250 or (closest_distance <= 250 and relative_speed >= 0.5) or risk >= 0.2 as near from b5),
    b7 as (select *, case when encounter in ('HEAD_ON', 'CROSSING_GIVE_WAY') then 5 else 0 end as yaw, sa * case when encounter = 'CROSSING_GIVE_WAY' then 0.85::double else 1 end as ps, case when encounter = 'OVERTAKING' then 20 else 0 end as side,
        case encounter when 'HEAD_ON' then 12 when 'CROSSING_GIVE_WAY' then 15 when 'CROSSING_STAND_ON' then 8 when 'OVERTAKING' then 14 else 20 end::double as sh, cos(radians(ha + 90)) as ux, sin(radians(ha + 90)) as uy, round(greatest(5, sa * 2), 6) as sigma, greatest(1, fb - fa) as dt from b6),
    b8 as (select *, {ahead} as ph, {turned} as turned from b7),
    b9 as (select *, {off} as off from b8),
    c0 as (select *, greatest(0.0::double, 1 - sqrt(power(bx - (ax + cos(radians(ph)) * ps * dt + ux * side), 2) + power(by_ - (ay + sin(radians(ph)) * ps * dt + uy * side), 2)) / (sigma * 3)) as pos, greatest(0.0::double, 1 - abs(off) / (sh * 3)) as hd,
        case when ps <= 1e-9 then (sb <= 1e-9)::int::double else greatest(0.0::double, 1 - abs(sb / ps - 1) / 0.35::double) end as sp, least(1.0::double, greatest(0.0::double, (turned + 5) / 10)) as star, case when sb <= sa * 0.9::double then 1 else 0.5::double end as slowed,
        least(1.0::double, abs((bx - ax - avx * dt) * ux + (by_ - ay - avy * dt) * uy) / 20) as aside, greatest(0.0::double, 1 - abs(turned) / 10) as kh, case when sa <= 1e-9 then (sb <= 1e-9)::int::double else greatest(0.0::double, 1 - abs(sb / sa - 1) / 0.2::double) end as ks from b9),
    said as (select sequence, new_id, lost_id, lost_run, encounter, confidence, round(bearing, 6) as bearing, round(turn, 6) as heading_difference, round(d, 6) as distance, closest_distance, frames_to_closest, relative_speed, risk, near,
        coalesce(round(case encounter when 'HEAD_ON' then pos + hd + star when 'CROSSING_GIVE_WAY' then pos + greatest(star, slowed) + sp when 'CROSSING_STAND_ON' then kh + ks + pos when 'OVERTAKING' then pos + aside + sp end / 3 + 1e-9::double, 6), 0.5::double) as fit from c0),
    noted as (select *, concat_ws(';', case when encounter = 'UNKNOWN' then 'unknown_encounter' end, case when not near then 'outside_proximity_filter' end,
        case when encounter = 'OVERTAKING' and confidence >= 0.85 and fit < 0.35 then 'high_confidence_overtaking_low_motion_score' end) as suspicious from said)
    select c.*, coalesce(encounter, 'UNKNOWN') as encounter, coalesce(confidence, 0) as confidence, bearing, heading_difference, distance, closest_distance, frames_to_closest, relative_speed, risk, coalesce(near, false) as near, fit,
        coalesce(suspicious, 'insufficient_colreg_history') as suspicious, case when near and encounter not in ('UNKNOWN', 'NO_INTERACTION') and confidence >= 0.85 and fit >= 0.65 and suspicious = '' then greatest(0, round(0.02::double * (fit - 0.5), 6)) else 0 end as bonus
    from cands c left join noted using (sequence, new_id, lost_id, lost_run)"""
_ANGLES = {
    "norm_a": NORM.format("degrees(atan2(a.vy, a.vx))"), "norm_b": NORM.format("degrees(atan2(b.vy, b.vx))"), "bearing": NORM.format("degrees(atan2(by_ - ay, bx - ax)) - ha"),
    "back": NORM.format("degrees(atan2(ay - by_, ax - bx)) - hb"), "turn": NORM.format("ha - hb"), "ahead": NORM.format("ha + yaw"), "turned": NORM.format("hb - ha"), "off": NORM.format("hb - ph"),
}
_PAIRS, _, _LAST = ORACLES["live_eligible"].rpartition("select sequence, new_id")
ORACLES["live_annotated"] = f"{_PAIRS.rstrip()}, cands as (select sequence, new_id{_LAST}){ENDS.format(**_ANGLES)}"
