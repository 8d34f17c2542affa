import io
import json
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sweepframe.catalog import QUERIES
from sweepframe.catalog import documents as catalog_documents
from sweepframe.sources import annotations, documents, folders


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t if t is None or isinstance(t, str) else json.dumps(t)) for i, t in enumerate(texts)], "doc string, text string")


def test_odd_documents_give_no_rows_and_are_listed(spark):
    d = docs(spark, None, "", "{", "[1, 2]", '"text"', {"error": "gone"}, {"error": None, "features": None}, {"features": "x"}, {"features": [1, None, {}]}, {"error": {"code": 3}})
    assert sorted(map(tuple, documents.rejected(d).collect())) == [("d0", "not a JSON document"), ("d1", "not a JSON document"), ("d2", "not a JSON document"), ("d5", "gone"), ("d9", '{"code":3}')]
    assert [(r["loknr"], r["name"], r["lat"]) for r in documents.register_sites(d).collect()] == [(0, "", None)] * 3
    assert documents.forecast_hours(d).count() == 0
    assert documents.frame_indexes(d).count() == 0
    assert documents.predicted_images(d).count() == 1  # {"features": [...]} reads as a bare map of one image
    assert documents.rejected(docs(spark).limit(0)).count() == 0


def test_predictions_wrapped_and_bare(spark):
    d = docs(spark, {"meta": {"m": 1}, "images": {"a.png": [{"bbox": [1, 2, 3, 4], "score": 0.5, "class_id": 2, "class_name": "x"}], "b.png": []}}, {"c.png": [{"bbox": [0, 0, 1, 1]}]})
    images = documents.predicted_images(d)
    assert sorted((r["doc"], r["image"]) for r in images.collect()) == [("d0", "a.png"), ("d0", "b.png"), ("d1", "c.png")]
    assert sorted(map(tuple, documents.predicted_boxes(images).collect())) == [("d0", "a.png", 0, 1.0, 2.0, 3.0, 4.0, 2, "x", 0.5), ("d1", "c.png", 0, 0.0, 0.0, 1.0, 1.0, 0, "damage", 1.0)]


def test_wanted_topic_wins(spark):
    d = docs(spark, {"clip": "c", "topic": "a", "times": [1.5, 2.5]}, {"clip": "c", "topic": "b", "times": [7.0]})
    first, wanted = (documents.frame_times(documents.frame_indexes(d, topic)).collect() for topic in (None, "b"))
    assert [tuple(r) for r in first] == [("c", 0, 1.5), ("c", 1, 2.5)] and [tuple(r) for r in wanted] == [("c", 0, 7.0)]


def odd_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return "".join(rng.choice('ab"\\{}[],: \né€') for _ in range(rng.randrange(12)))
    if kind == 1:
        return rng.choice([None, True, 3, -1.5e10, ""])
    if kind < 4:
        return rng.randrange(1000)
    if kind == 4:
        return [odd_value(rng, depth + 1) for _ in range(rng.randrange(5))]
    return {rng.choice(["images", "p", 'q"', "a.b", "é"]): odd_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_walk_reads_what_json_reads(block):
    rng = random.Random(block)
    for _ in range(60 if block == 1 else 300):
        value = {"meta": odd_value(rng), "images": [odd_value(rng) for _ in range(rng.randrange(6))], "deep": {"p": [odd_value(rng)], "images": [1]}, "end": odd_value(rng)}
        raw = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        got = [(part, pos, json.loads(e)) for part, pos, e in folders.walk(io.BytesIO(raw), {"images", "deep.p"}, block)]
        assert got == [("images", i, v) for i, v in enumerate(value["images"])] + [("deep.p", i, v) for i, v in enumerate(value["deep"]["p"])]
    assert [e for *_, e in folders.walk(io.BytesIO(b' [1, {"a": [2]}, "x"] '), {""}, block)] == [b"1", b'{"a": [2]}', b'"x"']
    assert list(folders.walk(io.BytesIO(b'{"images": [1, 2'), {"images"}, block)) == [("images", 0, b"1")]


def test_a_large_document_is_many_rows(spark, tmp_path):
    """One document on one line: the same COCO rows as from a column, in batches of elements."""
    coco = {"images": [{"id": i, "width": 640, "height": 480, "file_name": f"a/clip_{i:05d}.png"} for i in range(3000)],
            "annotations": [{"image_id": i % 3100, "category_id": i % 3, "bbox": [i % 7, 1, 5, 5], "segmentation": [[1, 2, 3, 4, 5, 6]]} for i in range(25000)], "categories": [{"id": k, "name": f"k{k}"} for k in range(3)]}
    (tmp_path / "big.json").write_text(json.dumps(coco))
    (tmp_path / "note.txt").write_text("no document")
    got = folders.read_elements(spark, str(tmp_path), "images", "annotations")
    assert {r["part"]: r["count"] for r in got.groupBy("part").count().collect()} == {"images": 3000, "annotations": 25000}
    column = docs(spark, coco)
    for part in ("images", "annotations"):
        large = documents.typed_part(got.where(F.col("part") == part), part).drop("doc")
        small = documents.coco_part(column, part).drop("doc")
        assert large.dtypes == small.dtypes and large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()


def test_label_folder(spark, tmp_path):
    for k in range(7):
        (tmp_path / "train").mkdir(exist_ok=True)
        (tmp_path / "train" / f"clip_{k:03d}.txt").write_text("\n\n0 0.5 0.5 0.2 0.2\r\n1 0.1 0.1 0.4 0.1 0.4 0.4\n\nbad line\n" if k != 3 else "")
    lines = folders.read_label_lines(spark, str(tmp_path))
    plain = annotations.read_label_lines(spark, f"{tmp_path}/train/*.txt").where("line <> '' OR line_no > 1").withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, plain.collect())) and lines.count() == 24
    assert {r["kind"] for r in annotations.label_kinds(annotations.parse_label_lines(lines)).collect()} == {"mixed"}
    sliced = spark.read.format("label_lines").option("path", str(tmp_path)).option("sliceFiles", "2").load()
    assert sliced.rdd.getNumPartitions() == 4 and sliced.count() == 24


ODD_COCO = [
    None, "{", {"error": "gone", "images": [{"id": 1}]}, {}, {"images": "x", "annotations": {"a": 1}}, {"images": None, "annotations": [], "categories": [None, 3, "t", [1], {}]},
    {"images": [{"id": "5", "width": 2.5, "height": "x", "file_name": 7}, {"id": None, "width": 2**40, "file_name": {"a": 1}}, 1, None, []], "categories": [{"id": 1, "name": None}]},
    {"annotations": [{"image_id": 1, "bbox": [1, "2", None, "x"], "segmentation": [[1, 2, 3.5]]}, {"bbox": "x", "iscrowd": True, "segmentation": None}, {"bbox": [1e3, [2]], "segmentation": "s"}, {"category_id": 2.0, "segmentation": []}, None, 4]},
]


@pytest.mark.parametrize("part", ["images", "annotations", "categories"])
def test_parts_read_together_equal_each_part(spark, part):
    d = docs(spark, *ODD_COCO)
    alone = documents.coco_part(d, part)
    together = documents.coco_parts(d, "images", "annotations", "categories")[["images", "annotations", "categories"].index(part)]
    assert together.schema == alone.schema
    assert sorted(map(repr, together.collect())) == sorted(map(repr, alone.collect())) and alone.count()


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson")


def test_a_text_is_parsed_once(spark):
    d = docs(spark, *ODD_COCO)
    assert parses(documents.items(d, "images")) == parses(documents.rejected(d)) == parses(documents.register_sites(d)) == 1
    assert sum(parses(p) for p in documents.coco_parts(d, "images", "annotations")) == 0  # stored


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_comes_out_of_documents_is_not_sent_whole_to_write_label_lines(spark):
    """Names, labels and classes are many rows of few documents, so their size is not what the plan takes it for."""
    coco = {"images": [{"id": i, "width": 100, "height": 50, "file_name": f"p/{i}.png"} for i in (1, 2, 3)], "categories": [{"id": 7, "name": "x"}, {"id": 5, "name": "y"}],
            "annotations": [{"image_id": i, "category_id": 7, "bbox": [10, 10, 20, 10]} for i in (1, 2, 3)] + [{"image_id": 1, "category_id": 5, "bbox": [0, 0, 10, 10]}]}
    images, labels, categories = documents.coco_parts(docs(spark, coco), "images", "annotations", "categories")
    lines, skipped = annotations.coco_to_yolo(images, labels, categories, images.where("id < 3").select("file_name"))
    assert "Broadcast" not in plan_of(lines) and "Broadcast" not in plan_of(skipped)
    assert sorted(map(tuple, lines.collect())) == [
        ("1.png", "0 0.050000 0.100000 0.100000 0.200000"), ("1.png", "1 0.200000 0.300000 0.200000 0.200000"), ("2.png", "1 0.200000 0.300000 0.200000 0.200000")]
    assert [r["file_name"] for r in skipped.collect()] == ["p/3.png"]


def test_times_of_index_documents_are_not_sent_whole(spark):
    assert "Broadcast" not in plan_of(QUERIES["document_frame_lookup"](spark, SF))


def test_documents_of_labels_are_built_without_sending_arrays_whole(spark):
    assert "Broadcast" not in plan_of(catalog_documents.coco_documents(spark, SF)).split("collect_list")[0]
