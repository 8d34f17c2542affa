"""Readers and writers on landed files."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sweepframe.operators import caching, reports
from sweepframe.sources import annotations, artifacts, landed


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(folder / name)


REPORT = {
    "clip": "c1", "day": "2024-08-22", "frames": 10, "capture": {"sharpness_mean": 40.5, "standoff_m_mean": 0.6, "water_temperature_c": 12.0},
    "validity_geometry": {"compliance": 0.9, "verdict": "accept"}, "validity_quality": {"share_in_band": 0.5},
    "detections": {"model": "det", "frames_with_detection": 3, "confirmed_events_min3_frames": 1},
}


@pytest.fixture
def warehouse(spark, tmp_path):
    put(tmp_path / "reports", "c1_report.json", json.dumps(REPORT, indent=2))
    put(tmp_path / "reports", "c2_report.json", {"clip": "c2", "frames": 4})
    put(tmp_path / "reports", "bad_report.json", "{not json")
    put(tmp_path / "reports", "err_report.json", {"clip": "c9", "error": "no frames for this clip"})
    put(tmp_path, "sites.json", json.dumps([{"loknr": 1, "name": "A"}, {"loknr": 2, "name": "B"}], indent=1))
    frames = spark.createDataFrame([("c1", "d", 0.61, 40.0, 1), ("c1", "d", 0.59, 42.0, 0), ("c2", "d", None, 1.0, 0)],
                                   "clip string, day string, standoff double, sharpness double, fp_det_v1 int")
    artifacts.write_frames(frames, str(tmp_path / "frames"))
    claims = artifacts.evidence(spark, [("recall", "not measured", "not_validated", None, "synthetic"), ("fa", "measured", "measured_on_real_data", "x.json", None)])
    lake = spark.createDataFrame([("dvl", "c1", 1.0), ("ins", "c1", 2.0)], "stream string, clip string, t double")
    artifacts.write_stream(lake, str(tmp_path / "lake"))
    return {"frames": str(tmp_path / "frames"), "inspections": str(tmp_path / "reports" / "*_report.json"), "sites": str(tmp_path / "sites.json"),
            "telemetry": str(tmp_path / "lake")}, claims


def test_views_and_reports(spark, warehouse):
    paths, claims = warehouse
    views = reports.build_views(spark, paths, claims)
    assert set(views) == {"frames", "inspections", "sites", "telemetry_dvl", "telemetry_ins", "evidence"}
    assert set(reports.build_views(spark, paths, claims)) == set(views), "building twice is harmless"
    q = reports.run_report(spark, "pass_quality").collect()
    assert [(r["clip"], r["coverage_pct"], r["confirmed_events"]) for r in q] == [("c2", None, None), ("c1", 90.0, 1)]
    b = reports.run_report(spark, "detections_by_standoff").collect()
    assert [(r["standoff_band_m"], r["frames"], r["false_alarms"], r["false_alarm_pct"]) for r in b] == [(0.6, 2, 1, 50.0)]
    assert reports.run_report(spark, "unvalidated").first()["topic"] == "recall"
    assert [r["clip"] for r in reports.run_report(spark, "water").collect()] == ["c1", "c2"]
    assert reports.run_report(spark, "clip_vs_day").count() == 2
    assert reports.passes(spark).count() == 2 and reports.claims(spark, topic="fa").count() == 1
    assert reports.sql(spark, "SELECT * FROM sites WHERE loknr >= :n", limit=1, args={"n": 1}).count() == 1
    assert spark.table("telemetry_dvl").columns == ["t", "clip", "stream", "filename"]


def test_missing_artifacts_survive(spark, tmp_path):
    assert reports.build_views(spark, {"frames": str(tmp_path / "no"), "telemetry": str(tmp_path / "none")}) == {}


def test_single_file_streams(spark, tmp_path):
    one = spark.createDataFrame([(1.0,)], "t double").toPandas()
    one.to_parquet(tmp_path / "2024-08-22_1__depth_temp.parquet")
    r = artifacts.read_stream_files(spark, str(tmp_path / "*__*.parquet")).first()
    assert (r["clip"], r["stream"]) == ("2024-08-22_1", "depth_temp")


def test_labels(spark, tmp_path):
    put(tmp_path / "l", "a.txt", "\n0 0.5 0.5 0.2 0.4\n\n1 0.1 0.1 0.2 0.1 0.2 0.2\n")
    put(tmp_path / "l", "b.txt", "0 0.5 0.5 x 0.4\n0 1 2\n0 0.5 0.5 1.2 0.4\n")
    put(tmp_path / "l", "c.txt", "  ")
    parsed = annotations.parse_label_lines(annotations.read_label_lines(spark, str(tmp_path / "l")))
    name = F.substring_index("path", "/", -1)
    assert rows(annotations.label_kinds(parsed).select(name, "kind")) == [("a.txt", "mixed"), ("b.txt", "detection")]
    assert rows(annotations.label_errors(parsed).select("error")) == [
        ("a.txt: mixes detection and segmentation lines",), ("b.txt:1: non-numeric token",),
        ("b.txt:2: expected 4 (box) or even>=6 (polygon) coords, got 2",), ("b.txt:3: box not normalised to [0,1]",)]
    images = spark.createDataFrame([("a.jpg", 100, 50)], "image string, width int, height int")
    b = annotations.label_boxes(parsed, images).first()
    assert [round(b[c], 6) for c in ("x1", "y1", "x2", "y2")] == [40.0, 15.0, 60.0, 35.0] and b["class_name"] == "damage"
    p = annotations.label_polygons(parsed, images).first()
    assert p["class_name"] == "class_1" and [(round(q["x"], 6), round(q["y"], 6)) for q in p["points"]] == [(10, 5), (20, 5), (20, 10)]


COCO = {
    "images": [{"id": 1, "width": 100, "height": 50, "file_name": "d/clip_000001.jpg"}, {"id": 2, "width": 0, "height": 5, "file_name": "z.jpg"}, {"id": 3, "width": 9, "height": 9, "file_name": "gone.jpg"}],
    "annotations": [
        {"image_id": 1, "category_id": 7, "bbox": [10, 10, 20, 20], "segmentation": [[0, 0, 50, 0, 50, 25], [1, 1]]}, {"image_id": 1, "category_id": 3, "bbox": [0, 0, 10, 10], "iscrowd": 1},
        {"image_id": 1, "category_id": 3, "bbox": [0, 0, 10, 10]}, {"image_id": 99, "category_id": 3, "bbox": [0, 0, 1, 1]}],
    "categories": [{"id": 7, "name": "hole"}, {"id": 3, "name": "tear"}],
}


def test_coco(spark, tmp_path):
    images, anns, cats = annotations.read_coco(spark, put(tmp_path, "c.json", COCO))
    b = annotations.coco_boxes(images, anns).orderBy("x1", "cls").collect()
    assert len(b) == 3 and b[-1].asDict() == {"image": "clip_000001.jpg", "grp": "clip", "cls": 7, "x1": 0.1, "y1": 0.2, "x2": 0.3, "y2": 0.6}
    files = spark.createDataFrame([("d/clip_000001.jpg",), ("z.jpg",)], "file_name string")
    lines, skipped = annotations.coco_to_yolo(images, anns, cats, files)
    assert rows(lines.select("line")) == [("0 0.050000 0.100000 0.100000 0.200000",), ("1 0.200000 0.400000 0.200000 0.400000",)]
    assert rows(skipped) == [("gone.jpg",), ("z.jpg",)]
    shapes, _ = annotations.coco_to_yolo(images, anns, cats, files, segmentation=True)
    assert ("1 0.000000 0.000000 0.500000 0.000000 0.500000 0.500000",) in rows(shapes.select("line")) and shapes.count() == 2
    single, _ = annotations.coco_to_yolo(images, anns, cats, files, single_class=True)
    assert all(r["line"].startswith("0 ") for r in single.collect())
    mapped, _ = annotations.coco_to_yolo(images, anns, cats, files, class_map={7: 4})
    assert [r["line"].split()[0] for r in mapped.collect()] == ["4"]


def test_voc(spark, tmp_path):
    obj = "<object><name>{n}</name><bndbox><xmin>10</xmin><ymin>5</ymin><xmax>20</xmax><ymax>25</ymax></bndbox></object>"
    for f, names in (("a", ["tear", ""]), ("b", ["hole", "tear"])):
        put(tmp_path / "v", f"{f}.xml", f"<annotation><filename>{f}.jpg</filename><size><width>100</width><height>50</height></size>{''.join(obj.format(n=n) for n in names)}</annotation>")
    boxes, classes = annotations.read_voc(spark, str(tmp_path / "v"))
    assert rows(classes.select("cls", "class_name")) == [(0, "tear"), (1, "damage"), (2, "hole")]
    assert boxes.count() == 4 and boxes.where("cls = 2").select("x1", "y2").first() == (0.1, 0.5)


def test_yolo_writer(spark, tmp_path):
    b = spark.createDataFrame([("train", "a.jpg", 0, 0.25, 0.25, 0.75, 0.5), ("val", "b.jpg", None, None, None, None, None)],
                              "split string, image string, cls int, x1 double, y1 double, x2 double, y2 double")
    annotations.write_yolo(b, str(tmp_path / "y"), ["hole"])
    back = spark.read.text(str(tmp_path / "y" / "labels"))
    assert rows(back.select("split", "value")) == [("train", "a.jpg\t0 0.500000 0.375000 0.500000 0.250000"), ("val", "b.jpg\t")]
    assert spark.read.json(str(tmp_path / "y" / "classes")).first()["class_name"] == "hole"


def test_frame_index_choice(spark, tmp_path):
    for name, topic, t in (("c__b__frame_index.json", "/b", 2.0), ("c__a__frame_index.json", "/a", 1.0)):
        put(tmp_path / "i", name, {"clip": "c", "topic": topic, "msgtype": "m", "count": 1, "t_start": t, "t_end": t, "times": [t]})
    read = lambda topic=None: landed.read_frame_index(spark, str(tmp_path / "i"), topic).first()["topic"]
    assert (read(), read("/b"), read("/zzz")) == ("/a", "/b", "/a")


@pytest.mark.parametrize("wrap", [True, False])
def test_predictions(spark, tmp_path, wrap):
    images = {"a.jpg": [{"bbox": [1, 2, 3, 4], "score": 0.5, "class_id": 2, "class_name": "hole"}, {"bbox": [0, 0, 1, 1]}], "b.jpg": []}
    im, boxes = landed.read_predictions(spark, put(tmp_path, "p.json", {"meta": {"m": 1}, "images": images} if wrap else images))
    assert rows(im) == [("a.jpg",), ("b.jpg",)]
    assert rows(boxes.select("box_id", "x2", "class_name", "score")) == [(0, 3.0, "hole", 0.5), (1, 1.0, "damage", 1.0)]
    landed.write_predictions(im, boxes, str(tmp_path / "out"))
    im2, boxes2 = landed.read_prediction_lines(spark, str(tmp_path / "out"))
    assert rows(im2) == rows(im) and rows(boxes2) == rows(boxes)


def test_forecast_and_register(spark, tmp_path):
    step = {"time": "2024-01-01T00:00:00Z", "data": {"instant": {"details": {"sea_water_speed": 0.2, "sea_surface_wave_height": 0.4}}}}
    f = landed.read_forecast(spark, put(tmp_path, "f.json", {"properties": {"timeseries": [step, {"time": "2024-01-01T01:00:00Z", "data": {}}]}})).orderBy("time").collect()
    assert (f[0]["sea_water_speed_ms"], f[0]["sea_water_temperature_c"], f[1]["sea_surface_wave_height_m"]) == (0.2, None, None)
    site = {"attributes": {"loknr": 5, "navn": " Nes ", "lat": 60.0, "kapasitet_lok": None, "plassering": "SJØ", "lokalitet_url": "u"}}
    r = landed.read_register(spark, put(tmp_path, "r.json", {"features": [site]})).first()
    assert (r["name"], r["lon"], r["capacity"], r["status"], r["url"]) == ("Nes", None, 0.0, "", "u")
    with pytest.raises(Exception, match="register error"):
        landed.read_register(spark, put(tmp_path, "e.json", {"error": "quota"})).collect()


def test_scoring_cache_runs_only_what_is_missing(spark, tmp_path):
    frames = spark.createDataFrame([(f"f{i}", i) for i in range(5)], "frame string, n int")
    cache = spark.createDataFrame([("f0", "m", 0.25), ("f1", "m", 0.5), ("f2", "other", 0.25)], "frame string, model string, conf double")

    def scorer(batches):
        for b in batches:
            yield b[["frame"]].assign(ndet=b["n"].astype("int32"), score=0.5)

    new = caching.score_missing(frames, cache, "m", 0.25, scorer)
    new.write.mode("append").parquet(str(tmp_path / "cache"))
    again = spark.read.parquet(str(tmp_path / "cache"))
    assert rows(again.select("frame")) == [("f1",), ("f2",), ("f3",), ("f4",)]
    assert caching.missing_frames(frames, cache.unionByName(again.select("frame", "model", "conf")), "m", 0.25).count() == 0


def test_event_sink(spark, tmp_path):
    landed.write_events(spark.createDataFrame([("heartbeat", 50)], "event string, frames int"), str(tmp_path / "e"))
    landed.write_events(spark.createDataFrame([("heartbeat", 100)], "event string, frames int"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    artifacts.write_reports(spark.createDataFrame([("PASS",)], "verdict string"), str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v")).first()["verdict"] == "PASS"


ODD_LINES = [
    "0 .5 .5 .1 .1", "1  0.1 0.2 0.3 0.4 0.5 0.6", "0 .5 .5 .1 .1", "word", "", "   ", "2", "0 a b c d", "0 1.5 .5 .1 .1", "0 -1e-9 .5 .1 .1", "0 1 0 1 0", "0 NaN 0 0 0", "0 .1 NaN .2 -1", "0 Infinity 0 0 0",
    "0 -Infinity 1 1 1", "0 1e400 0 0 0", "0 1d 1f .5 .5", "x .5 .5 .1 .1", "0.9 .5 .5 .1 .1", "0\t.5\t.5 .1 .1", "\t0 .5 .5 .1 .1", "0 .1 .2 .3", "0 .1 .2 .3 .4 .5 .6 .7", "0 0x1 .1 .1 .1", None,
    "0 2 2 2 2 2 2", "0 .1,.2 .3 .4 .5",
]


def test_odd_label_lines_as_numbers_one_by_one(spark):
    """The parser against conversions of one token at a time; a file that mixes kinds is reported once, a repeated line each time."""
    lines = spark.createDataFrame([(p, i + 1, t) for p in ("l/a.txt", "l/b.txt") for i, t in enumerate(ODD_LINES)] + [("l/b.txt", 4, "word")] * 2 + [("l/c.txt", 1, "0 .5 .5 .1 .1")], "path string, line_no int, line string")
    parsed = annotations.parse_label_lines(lines)
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda p: p.try_cast("double"))
    plain = lines.where(F.trim("line") != "").select(
        "path", "line_no", numbers[0].cast("int").alias("class_id"), F.when(F.size(numbers) > 1, F.slice(numbers, 2, F.size(numbers) - 1)).otherwise(F.expr("array()")).alias("coords"),
        F.exists(numbers, lambda v: v.isNull()).alias("broken"), F.exists(numbers, lambda v: v.isNotNull() & ((v < 0) | (v > 1))).alias("far"), F.slice(numbers, 2, 99).alias("tail"))
    assert rows(parsed.select("path", "line_no", "class_id", F.col("coords").cast("string"))) == rows(plain.select("path", "line_no", "class_id", F.col("coords").cast("string")))
    outside = F.exists("tail", lambda v: (v < 0) | (v > 1))
    said = F.when(F.col("broken"), "non-numeric token").when(~(F.size("coords") == 4) & ~((F.size("coords") >= 6) & (F.size("coords") % 2 == 0)), F.concat(F.lit("expected 4 (box) or even>=6 (polygon) coords, got "), F.size("coords").cast("string"))).when(
        (F.size("coords") == 4) & outside, "box not normalised to [0,1]")
    want = [(r["path"], f"{r['path'][2:]}:{r['line_no']}: {r['said']}") for r in plain.withColumn("said", said).where("said IS NOT NULL").collect()]
    assert rows(annotations.label_errors(parsed)) == sorted(want + [(p, f"{p[2:]}: mixes detection and segmentation lines") for p in ("l/a.txt", "l/b.txt")], key=repr)


def test_a_label_line_is_read_once(spark):
    lines = spark.createDataFrame([("l/a.txt", 1, "0 .5 .5 .1 .1")], "path string, line_no int, line string")
    images = spark.createDataFrame([("a.png", 4, 4)], "image string, width int, height int")
    parsed = annotations.parse_label_lines(lines)
    for df in (annotations.label_errors(parsed), annotations.label_boxes(parsed, images), parsed.where("error IS NOT NULL")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
