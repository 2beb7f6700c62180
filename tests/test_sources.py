import json
import struct
import tempfile
import zlib
from pathlib import Path

import numpy as np
import pytest

from boxlens.operators.raster import grid as G
from boxlens.params import GammaRule, from_mapping
from boxlens.sources import images as I
from boxlens.sources import runs as U
from boxlens.sources import truth as T


def png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def folder():
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (root / "a").mkdir(), (root / ".hidden").mkdir()
    rng = np.random.default_rng(0)
    planes = {"one.png": rng.integers(0, 256, (5, 7, 3), dtype=np.uint8), "a/two.PNG": rng.integers(0, 256, (3, 4, 3), dtype=np.uint8), "a/one.png": rng.integers(0, 256, (2, 2, 3), dtype=np.uint8)}
    for name, data in planes.items():
        png(root / name, data)
    png(root / ".hidden" / "no.png", planes["one.png"])
    (root / "broken.jpg").write_bytes(b"not an image")
    (root / "notes.txt").write_text("x")
    return root, planes


def test_listing_skips_hidden_and_foreign_files(spark, folder):
    rows = I.list_images(spark, str(folder[0])).collect()
    assert [r.rel for r in rows] == ["a/one.png", "a/two.PNG", "broken.jpg", "one.png"]


def test_decoding_keeps_errors_as_rows_and_pixels_exact(spark, folder):
    root, planes = folder
    loaded = I.load_images(spark, str(root))
    status = {r.name: r.status for r in I.error_rows(loaded).collect()}
    assert status == {"one.png": "success", "two.PNG": "success", "broken.jpg": "error"}
    pixels = G.explode_pixels(loaded.filter("rel = 'a/two.PNG'")).collect()
    assert len(pixels) == 12
    for p in pixels:
        assert [p.r, p.g, p.b] == planes["a/two.PNG"][p.y, p.x].tolist() and (p.w, p.h) == (4, 3)


def test_output_names_only_lengthen_when_stems_repeat(spark, folder):
    names = {r.rel: r.output_name for r in I.output_names(I.list_images(spark, str(folder[0]))).collect()}
    assert names["one.png"] == "one" and names["a/one.png"] == "a__one" and names["a/two.PNG"] == "two"


def test_annotation_files(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    doc = {"size": {"width": 600, "height": 400}, "objects": [
        {"classTitle": "pothole", "points": {"exterior": [[10, 40], [5, 20]]}, "tags": [{"value": "D40"}]},
        {"classTitle": "other corruption", "points": {"exterior": [[0, 0], [1, 1]]}, "tags": []},
    ]}
    (root / "x_1.jpg.json").write_text(json.dumps(doc, indent=1))
    (root / "x_2.jpg.json").write_text(json.dumps({"size": {"width": 6, "height": 4}, "objects": []}))
    images, boxes = T.read_annotations(spark, str(root))
    assert {r.image for r in images.collect()} == {"x_1.jpg", "x_2.jpg"}
    b = boxes.collect()
    assert len(b) == 1 and (b[0].image, b[0].kind, b[0].x1, b[0].y1, b[0].x2, b[0].y2, b[0].detail) == ("x_1.jpg", "pothole", 5.0, 20.0, 10.0, 40.0, "D40")


def test_truth_and_detection_files(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (root / "t.csv").write_text("image,x,y,w,h,type\na.jpg,1,2,3,4,Pothole big\nb,5,5,5,5,crack\n")
    images = spark.createDataFrame([("a.jpg",), ("b.jpg",), ("c.jpg",)], "image string")
    rows = {r.image: (r.kind, r.x1, r.x2) for r in T.match_names(images, T.read_truth_csv(spark, str(root / "t.csv"))).collect()}
    assert rows == {"a.jpg": ("pothole", 1.0, 4.0), "b.jpg": ("crack", 5.0, 10.0)}
    (root / "t.json").write_text(json.dumps({"images": [{"source": "a", "boxes": [{"class": "crack", "bbox_xyxy": [9, 1, 2, 3]}]}, {"source": "b", "boxes": []}]}, indent=1))
    rows = {r.image: (r.kind, r.x1, r.x2) for r in T.read_truth_json(spark, str(root / "t.json")).collect()}
    assert rows == {"a": ("crack", 2.0, 9.0), "b": (None, None, None)}
    (root / "d.json").write_text(json.dumps({"a": [{"type": "crack", "bbox": [1, 2, 3, 4]}], "b": []}))
    rows = {r.image: (r.did, r.x, r.h) for r in T.read_detections_json(spark, str(root / "d.json")).collect()}
    assert rows == {"a": (0, 1.0, 4.0), "b": (None, None, None)}


def test_split_and_viewpoint_files(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    (root / "s.csv").write_text("image,source,group,has_damage,n_crack,n_pothole,split\na,s,blur,1,2,0,tune\n")
    (root / "v.csv").write_text("image,viewpoint,note\na,far,\n")
    assert T.read_split(spark, str(root / "s.csv")).first().split == "tune"
    assert T.read_viewpoints(spark, str(root / "v.csv")).first().viewpoint == "far"


SCORES = "image long, detector string, kind string, criterion string, tp long, fp long, fn long, n_gt long, n_cut long, n_det long"


def test_results_and_ledger_append(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = spark.createDataFrame([(1, "D1", k, c, 1, 2, 0, 1, 0, 4) for k in ("crack", "pothole") for c in ("iou50", "iou30", "in50")], SCORES)
    for run in ("r1", "r2"):
        U.write_results(U.wide_results(s), f"{root}/results", run)
        assert U.append_ledger(s, f"{root}/ledger", run, {"config": "base", "dataset": "d"})
    assert not U.append_ledger(s.filter("image < 0"), f"{root}/ledger", "r3")
    led = U.read_ledger(spark, f"{root}/ledger").orderBy("run").collect()
    assert [r.run for r in led] == ["r1", "r2"] and led[0].crack_precision == 0.5 and led[0].crack_frag_per_hit == 2.0
    assert spark.read.parquet(f"{root}/results").filter("run = 'r1'").count() == 1


def test_run_checks(spark):
    rows = spark.createDataFrame([(1, "none", "D1", "True"), (1, "none", "D2", "1"), (2, "none", "D1", "False")], "image long, condition string, detector string, has_gt string")
    with pytest.raises(ValueError):
        U.read_run(rows)
    assert U.read_run(rows, "none/D1").count() == 1
    with pytest.raises(ValueError):
        U.assert_same_images(rows, rows.filter("image = 1"))
    U.assert_same_images(rows, rows)


def test_parameters_reject_unknown_keys():
    assert from_mapping(GammaRule, {"mode": "off", "_note": 1}).mode == "off"
    with pytest.raises(ValueError):
        from_mapping(GammaRule, {"mod": "off"})
    with pytest.raises(ValueError):
        I.guard_dataset("rdd_test")
    assert I.guard_dataset("rdd_dev") == "rdd_dev"


def test_truth_comes_from_the_source_that_lists_the_image(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "image string")
    box = "image string, kind string, x1 double"
    first = (images.filter("image in ('a', 'b')"), spark.createDataFrame([("a", "crack", 1.0)], box))
    rest = (None, spark.createDataFrame([("a", "pothole", 2.0), ("b", "pothole", 3.0), ("c", "crack", 4.0)], box))
    got = T.find_truth(images, [None, first, rest]).select("image", "source_rank", "kind", "x1").orderBy("image").collect()
    assert [tuple(r) for r in got] == [("a", 1, "crack", 1.0), ("b", 1, None, None), ("c", 2, "crack", 4.0), ("d", 2, None, None)]
