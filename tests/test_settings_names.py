import json

import pytest
from pyspark.sql import functions as F

from orbitframe.functions import naming
from orbitframe.operators import detections as det
from orbitframe.plans import settings


def args(*argv):
    return {k: v for k, v in vars(settings.arguments().parse_args(argv)).items() if k not in ("config", "input", "output")}


def test_layers():
    s = settings.resolved({"resolution": 1024, "quality": 80}, args("--quality", "70"))
    assert (s["resolution"], s["quality"], s["fov"], s["layout_mode"]) == (1024, 70, 90, "ring")
    s = settings.resolved({"interval": 2.0, "format": "png"}, {})
    assert (s["interval_value"], s["output_format"]) == (2.0, "png")
    assert settings.resolved({"interval": 2.0, "interval_value": 3.0}, {})["interval_value"] == 3.0
    s = settings.resolved({"interval_unit": "Frames", "interval_value": 9}, args("--interval", "0.5"))
    assert (s["interval_value"], s["interval_unit"]) == (0.5, "Seconds")


def test_flags_and_modes():
    mode = lambda config, *argv: settings.resolved(config, args(*argv))["ai_mode"]
    assert mode({}) == "None" and mode({"ai": True}) == "Generate Mask" and mode({"ai": True, "ai_mode": "Skip Frame"}) == "Skip Frame"
    assert mode({"ai_mode": "Skip Frame"}, "--ai") == "Generate Mask" and mode({}, "--ai-skip", "--ai-mask") == "Skip Frame"
    s = settings.resolved({}, args("--targets", "humans, Vehicles", "--flat", "--adaptive", "--motion-threshold", "2", "--ai-mask-cameras", " Down , Back "))
    assert (s["ai_detect_humans"], s["ai_detect_vehicles"], s["ai_detect_plants"], s["is_360"], s["adaptive_mode"], s["adaptive_threshold"]) == (True, True, False, False, True, 2.0)
    assert s["ai_mask_cameras"] == ["Down", "Back"]
    assert settings.resolved({}, args("--image-pattern", "{frame}"))["naming_mode"] == "custom"
    assert settings.resolved({}, args("--image-pattern", "{frame}", "--naming-mode", "simple"))["naming_mode"] == "simple"


def test_saved_settings(tmp_path):
    p = tmp_path / "s.json"
    assert settings.load_saved(str(p)) == settings.DEFAULTS
    p.write_text("{broken")
    assert settings.load_saved(str(p)) == settings.DEFAULTS
    settings.save(str(p), settings.DEFAULTS | {"fov": 70})
    assert settings.load_saved(str(p))["fov"] == 70 and json.loads(p.read_text())["fov"] == 70
    p.write_text("[]")
    with pytest.raises(ValueError):
        settings.load_config(str(p))


def test_names(spark):
    df = spark.createDataFrame([("v", 12, "Up"), ("{camera}", 1234567, "a")], "f string, n int, c string")

    def names(*a):
        return [tuple(r) for r in df.select(*naming.output_names(a[0], F.col("f"), F.col("n"), F.col("c"), *a[1:])).collect()]

    assert names("realityscan", "jpg")[0] == ("v_frame000012_Up.jpg", "v_frame000012_Up.jpg.mask.png")
    assert names("simple", "png")[1] == ("{camera}_frame1234567_a.png", "{camera}_frame1234567_a_mask.png")
    assert names("custom", "jpg", "{filename}", "../{image_name}.{ext}") == [("v.jpg", "v.jpg.jpg"), ("a.jpg", "a.jpg.jpg")]
    with pytest.raises(ValueError):
        names("other", "jpg")


def test_paths(spark):
    df = spark.createDataFrame([("/a/b.c/d.tar.MP4",), ("/x/.hidden",), ("/noext",)], "p string")
    got = [tuple(r) for r in df.select(naming.stem(F.col("p")), naming.suffix(F.col("p")), naming.is_media(F.col("p")), naming.output_dir(F.col("p"), None), naming.output_dir(F.col("p"), "/o/")).collect()]
    assert got[0] == ("d.tar", "mp4", True, "/a/b.c/d.tar_processed", "/o/d.tar_processed")
    assert got[1][0] == ".hidden" and got[2][:3] == ("noext", "", False)


def test_classes_and_scope(spark):
    names = det.COCO
    assert len(names) == 80 and names[16] == "dog" and names[58] == "potted plant" and names[79] == "toothbrush"
    df = spark.createDataFrame([(1, " Dog, cat ,,unknown,DOG"), (2, None), (3, " ")], "id int, t string")
    assert sorted(map(tuple, det.class_ids(df, det.class_table(spark), "id", "t").collect())) == [(1, 15), (1, 16)]
    assert [r[0] for r in df.select(det.face_scope(F.col("t"))).collect()] == [["cat", "dog", "unknown"], None, None]
    views = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "frame_idx int, name string")
    hits = spark.createDataFrame([(1, "a", True), (1, "a", False), (2, "a", False)], "frame_idx int, name string, has_mask boolean")
    on = ["frame_idx", "name"]
    act = lambda mode, scope=None: {(r.frame_idx, r.name): r.ai_action for r in det.outcomes(views, hits, on, mode, scope).collect()}
    assert act("skip_frame") == {(1, "a"): "drop", (1, "b"): "keep", (2, "a"): "drop"}
    assert act("generate_mask", F.col("name") == "a") == {(1, "a"): "mask", (1, "b"): "pass", (2, "a"): "empty_mask"}
    assert set(act("none").values()) == {"pass"}
    assert sorted(map(tuple, det.without_detections(views, hits, on).collect())) == [(1, "b")]


def test_rules_of_columns_are_those_of_a_run(spark):
    from orbitframe.plans.file_queries import settings_rows

    rows = [(k, c) for k in range(1, 43) for c in range(1, 37, 5)]
    df = settings_rows(spark.createDataFrame([(k * 1000 + c, c) for k, c in rows], "o_orderkey long, o_custkey long"))
    for r in df.collect():
        k, c = r.job_id, r.job_id % 1000
        flag = None if c % 2 else c % 4 == 0
        config = {"interval_value": float(c % 7) if k % 3 == 0 else None, "interval": float(c % 5) if k % 5 == 0 else None, "interval_unit": "Frames" if k % 2 == 0 else None, "naming_mode": "simple" if c % 3 == 0 else None}
        config |= {key: flag for key in ("ai_detect_humans", "ai_detect_vehicles", "ai_detect_plants", "adaptive_mode", "export_telemetry", "is_360")}
        on = True if c % 6 == 0 else None
        cli = {"interval": c % 9 / 2 if k % 4 == 0 else None, "targets": {0: "Vehicles, plants", 1: ""}.get(k % 3), "naming_mode": "simple" if k % 7 == 0 else None, "image_pattern": "{frame}" if k % 5 == 1 else None, "mask_pattern": "{camera}" if k % 5 == 2 else None}
        cli |= {"adaptive": on, "export_telemetry": on, "flat": on}
        want = settings.resolved(config, cli)
        assert r.asDict() == {"job_id": k} | {key: want[key] for key in r.asDict() if key != "job_id"}
