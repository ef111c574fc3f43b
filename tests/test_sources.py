"""Files whose headers, forms and folders differ."""

import json

from trackspark.sources import ais, clips, headed


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,timestamp_ms,pixel_x,pixel_y\n7,0,1,2\n7,1000,,4\n")
    (tmp_path / "b.csv").write_text("\ufeffPixel Y, pixel_x ,timestamp_ms,MMSI,more\r\n7.5,0.5,2,8,\"a, b\"\r\n\r\n9\r\n")
    (tmp_path / "c.csv").write_text("mmsi,mmsi\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("mmsi\n")
    rows = {(r.mmsi, r.timestamp_ms, r.pixel_x, r.pixel_y, r.has_pixel) for r in ais.fixes_csv(spark, str(tmp_path)).collect()}
    assert rows == {("7", 0.0, 1.0, 2.0, True), ("7", 1000.0, None, 4.0, False), ("8", 2.0, 0.5, 7.5, True), (None, None, None, 9.0, False), ("2", None, None, None, False)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # lines of one file in several tasks
    try:
        again = headed.headed(spark, str(tmp_path / "b.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.cells.get("more", "") for r in again) == ["", "a, b"]


def test_all_forms_of_records_are_equal(spark, tmp_path):
    rows = [{"MMSI": 111, "timestamp": 5, "x": 100.5, "cog": "0"}, {"mmsi": "222", "timestamp": "2024-01-01T00:00:01Z", "y": "bad"}, {"mmsi": "222", "timestamp": "2024-01-01 02:00:01+02:00", "x": 3}, {"mmsi": "222", "timestamp": "2024-01-01 00:00:02"}]
    bad = [{"mmsi": " ", "timestamp": 1}, {"mmsi": "5", "timestamp": "later"}]
    for n, content in enumerate([rows + bad, {"all": [{k.lower(): v for k, v in r.items()} for r in rows], "rest": bad}, {"111": {"timestamp": 5, "x": 100.5, "cog": "0"}, "222": [{k: v for k, v in r.items() if k != "mmsi"} for r in rows[1:]], "5": bad[1], "z": [bad[0], 7]}]):
        path = tmp_path / f"{n}.json"
        path.write_text(json.dumps(content))
        good, warned = ais.records(spark, str(path), form="json")
        assert sorted(((r.mmsi, r.timestamp, r.x, r.cog) for r in good.collect()), key=repr) == [("111", 5.0, 100.5, 0.0), ("222", 1704067201.0, 3.0, None), ("222", 1704067201.0, None, None), ("222", 1704067202.0, None, None)], n
        assert sorted(r.reason for r in warned.collect()) == ["missing MMSI", "missing or invalid timestamp"], n
    (tmp_path / "n.csv").write_text("Ship Id,time,sog\n9,1.5,3\n,2,4\n9,,4\n")
    good, warned = ais.records(spark, str(tmp_path / "n.csv"), ais.Columns(mmsi="ship id", timestamp="Time"))
    assert [(r.mmsi, r.timestamp, r.sog) for r in good.collect()] == [("9", 1.5, 3.0)] and warned.count() == 2
    (tmp_path / "empty.json").write_text("[]")
    assert ais.records(spark, str(tmp_path / "empty.json"), form="json")[0].count() == 0


def test_true_boxes_by_all_their_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mmsi,frame,bb_left,bb_top,bb_width,bb_height,conf\n1,3,1,2,3,4,0.5\n,3,1,2,3,4,0.5\n2,4,1,,3,4,0.5\n")
    (tmp_path / "b.csv").write_text("W,H,left,top,MMSI,time\n30,40,10,20,2,1.5\n31,41,11,21,2,\n")
    rows = sorted((r.mmsi, r.frame, r.x, r.y, r.w, r.h, r.confidence) for r in clips.true_boxes(spark, str(tmp_path), fps=30).collect())
    assert rows == [("1", 3, 1.0, 2.0, 3.0, 4.0, 0.5), ("2", 1, 11.0, 21.0, 31.0, 41.0, None), ("2", 46, 10.0, 20.0, 30.0, 40.0, None)]


def test_manifests_and_why_they_are_skipped(spark, tmp_path):
    def clip(name, manifest, reports="mmsi,x\n1,2\n", truth="mmsi,x\n1,2\n", video=True):
        folder = tmp_path / "deep" / name
        folder.mkdir(parents=True)
        (folder / "x_alignment_manifest.json").write_text(json.dumps(manifest))
        for file, text in (("ais_clip_aligned.csv", reports), ("gt_fusion_clip_aligned.csv", truth), ("v.mp4", "v" if video else None)):
            if text is not None:
                (folder / file).write_text(text)

    sure = {"clip_video": "v.mp4", "Offset Confidence": 0.9}
    clip("ok", sure | {"clip_fps": 25, "start_time": "2024"})
    clip("windows", {"video_path": "C:\\data\\v.mp4", "confidence": 0.8, "fps": -1})
    clip("moved", {"clip_video": "/elsewhere/v.mp4", "confidence": 0.8})
    clip("no_video", sure, video=False)
    clip("no_reports", sure, reports=None)
    clip("no_truth", sure, truth=None)
    clip("empty_reports", sure, reports="mmsi,x\n")
    clip("empty_truth", sure, truth="mmsi\n")
    clip("told", sure | {"ais_row_count": 5}, reports="mmsi,x\n")
    clip("unsure", {"clip_video": "./v.mp4", "confidence": 0.25})
    clip("silent", {"clip_video": "v.mp4"})
    found = {r.manifest.split("/")[-2]: r for r in clips.manifests(spark, str(tmp_path)).collect()}
    assert {k: r.skipped for k, r in found.items()} == {
        "ok": None, "windows": None, "moved": None, "told": None, "no_video": "missing_clip_video", "no_reports": "missing_ais_clip_aligned_csv", "no_truth": "missing_gt_fusion_clip_aligned_csv",
        "empty_reports": "no_ais_rows_in_clip", "empty_truth": "no_gt_fusion_rows_in_clip", "unsure": "low_offset_confidence:0.2500", "silent": "missing_offset_confidence",
    }
    assert (found["ok"].fps, found["windows"].fps, found["ok"].start_time, found["told"].reports_rows) == (25.0, 30.0, "2024", 5)
    assert found["windows"].video_file.endswith("/windows/v.mp4") and found["moved"].video_file.endswith("/moved/v.mp4")
    assert clips.manifests(spark, str(tmp_path), any_confidence=True).where("skipped is null").count() == 6
