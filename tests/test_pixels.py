"""Pixel jobs on small images written with the package's own PNG encoder."""

import base64

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliospark.operators import attempts, orient, pixels
from foliospark.schemas import BLOCKS
from foliospark.sources import readers


@pytest.fixture
def images(spark, tmp_path):
    page = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    (tmp_path / "p0.png").write_bytes(pixels.png_bytes(page))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    df = readers.page_images(spark, str(tmp_path))
    return page, df.withColumn("task_id", F.lit("t")).withColumn(
        "page_index", F.when(F.col("origin").contains("p0"), 0).otherwise(1))


def test_decode(images):
    page, df = images
    rows = {r.page_index: r for r in df.collect()}
    assert rows[1].width is None and rows[1].data is None
    assert (pixels.to_array(rows[0].data, 6, 4, 3) == page).all()


def test_flatten_and_rotate(spark, images):
    page, df = images
    r = pixels.flatten_alpha(df).first()
    assert (r.width, r.height, r.channels) == (6, 4, 3)
    clear = np.zeros((1, 1, 4), np.uint8)
    assert pixels.on_white(clear).tolist() == [[[255, 255, 255]]]
    turned = pixels.rotate(df.withColumn("rotation", F.lit(90))).first()
    assert (turned.width, turned.height) == (4, 6)
    assert (pixels.to_array(turned.data, 4, 6, 3) == np.rot90(page)).all()


def test_crop_pictures(spark, images):
    page, df = images
    schema = __import__("pyspark.sql.types", fromlist=["x"]).StructType().add("task_id", "string").add(
        "page_index", "integer").add("blocks", BLOCKS)
    rows = [("t", 0, [([1.0, 1.0, 3.0, 3.0], "Picture", "old"), ([5.0, 1.0, 5.0, 3.0], "Figure", "kept"),
                      ([0.0, 0.0, 2.0, 2.0], "Text", "text"), (None, "Image", "nobox")]),
            ("t", 1, [([0.0, 0.0, 2.0, 2.0], "Image", "no image")])]
    got = {r.page_index: r.blocks for r in pixels.crop_pictures(spark.createDataFrame(rows, schema), df).collect()}
    assert [b.text for b in got[0]][1:] == ["kept", "text", "nobox"]
    assert [b.text for b in got[1]] == ["no image"]
    prefix = "![image](data:image/png;base64,"
    assert got[0][0].text.startswith(prefix)
    assert base64.b64decode(got[0][0].text[len(prefix):-1]) == pixels.png_bytes(page[1:3, 1:3])


def test_crops_read_no_other_page(spark, images, tmp_path):
    """The images of pages without pictures are damaged, and nobody notices."""
    from foliospark.sources import sinks
    page, df = images
    some = df.filter("page_index = 0").drop("task_id", "page_index").crossJoin(
        spark.createDataFrame([(f"t{k}", p) for k in range(3) for p in range(2)], "task_id string, page_index int"))
    sinks.write_page_images(some, str(tmp_path / "images"))
    for file in (tmp_path / "images").rglob("*.parquet"):
        if "task_id=t1/page_index=0" not in str(file):
            file.write_bytes(b"damaged")
    schema = __import__("pyspark.sql.types", fromlist=["x"]).StructType().add("task_id", "string").add(
        "page_index", "integer").add("blocks", BLOCKS)
    rows = [(f"t{k}", p, [([0.0, 0.0, 2.0, 2.0], "Picture" if (k, p) == (1, 0) else "Text", "x")]) for k in range(3) for p in range(2)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages"))
    kind = some.select("origin", "width", "height", "channels", "data", "task_id", "page_index").schema
    done = pixels.crop_pictures(spark.read.parquet(str(tmp_path / "pages")), spark.read.schema(kind).parquet(str(tmp_path / "images")))
    assert "dynamicpruning" in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.task_id, r.page_index): r.blocks[0].text for r in done.collect()}
    assert len(got) == 6 and [k for k, v in got.items() if v != "x"] == [("t1", 0)]


def test_rotation_by_other_angles_is_marked(spark, images):
    page, df = images
    for angle, shape in ((45, (6, 4)), (-90, (4, 6)), (180, (6, 4)), (None, (6, 4))):
        r = pixels.rotate(df.withColumn("rotation", F.lit(angle).cast("int"))).first()
        assert (r.width, r.height) == shape and r.rotated == (angle in (-90, 180))


def test_orientation_plug(spark, images):
    _, df = images
    guess = lambda b: b.assign(orientation="90", confidence=1.0)
    assert {r.orientation for r in orient.predict_orientation(df, guess).collect()} == {"90"}


def test_attempt_rounds(spark):
    """Answers depend on the attempt; tokens and penalties follow the retry rules."""
    script = {"ok": ["stop"], "long": ["length", "length", "stop"], "empty": ["blank"] * 3,
              "mix": ["length", "blank", "stop"], "error": ["error"] * 3}

    def engine(batch):
        kinds = [script[t][a - 1] for t, a in zip(batch["task_id"], batch["attempt"])]
        return pd.DataFrame({
            "task_id": batch["task_id"], "page_index": batch["page_index"], "model_id": "chandra",
            "attempt": batch["attempt"],
            "content": [" " if k == "blank" else f"{m} {p}" for k, m, p in
                        zip(kinds, batch["max_tokens"], batch["penalty"])],
            "finish_reason": ["length" if k == "length" else "stop" for k in kinds],
            "token_count": 5, "error": ["down" if k == "error" else None for k in kinds]})

    requests = spark.createDataFrame([(t, 0) for t in script], "task_id string, page_index int")
    got = {}
    for r in attempts.attempt_rounds(requests, engine, parallelism=2).orderBy("task_id", "attempt").collect():
        got.setdefault(r.task_id, []).append((r.outcome, r.content))
    assert [o for o, _ in got["ok"]] == ["OK"]
    assert [o for o, _ in got["long"]] == ["LENGTH", "LENGTH", "OK"]
    assert got["long"][2][1] == "8096 0.4"
    assert [o for o, _ in got["empty"]] == ["EMPTY"] * 3
    assert [o for o, _ in got["mix"]] == ["LENGTH", "EMPTY", "OK"]
    assert got["mix"][2][1].split()[0] == "6096" and got["mix"][2][1].split()[1] in ("nan", "None")
    assert [o for o, _ in got["error"]] == ["API_ERROR"] * 3


def test_engine_is_called_once_per_attempt(spark, tmp_path):
    """Storing a round must not run the model again."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def engine(batch):
        import uuid
        for t, a in zip(batch["task_id"], batch["attempt"]):
            (calls / f"{t}_{a}_{uuid.uuid4().hex}").write_text("")
        return batch.assign(model_id="chandra", content="x", finish_reason="length", token_count=1, error=None)

    requests = spark.createDataFrame([(f"t{k}", 0) for k in range(20)], "task_id string, page_index int")
    answers = attempts.attempt_rounds(requests, engine)
    assert answers.count() == 60 and answers.filter("outcome = 'LENGTH'").count() == 60
    assert len(list(calls.iterdir())) == 60
