"""The mixed-model chain: unknown models, missing sizes, and the exchanges of bucketed page tables."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark.operators import chain
from foliospark.sources import sinks

ANSWERS = "task_id string, page_index int, model_id string, attempt int, outcome string, content string"
DIV = "<div data-bbox='[0,0,512,1024]' data-label='Text'><p>hi</p></div>"


@pytest.fixture(scope="module")
def tables(spark):
    answers = spark.createDataFrame([
        ("a", 0, "Chandra", 1, "API_ERROR", None), ("a", 0, "Chandra", 2, "OK", DIV), ("a", 1, "gpt", 1, "OK", "x"),
        ("a", 2, None, 1, "OK", "y"), ("b", 0, "chandra", 1, "OK", DIV), ("b", 1, "dots", 1, "OK", '{"bbox": [1,2,3,4], "text": "d"}'),
        ("c", 0, "dots", 1, "API_ERROR", None), ("c", 0, "dots", 2, "API_ERROR", None), ("c", 0, "dots", 3, "API_ERROR", None),
        ("d", 0, "deepseekocr", 1, "OK", "")], ANSWERS)
    sizes = spark.createDataFrame([("a", k, 100, 200) for k in range(3)] + [("d", 0, 10, 10), ("z", 0, 1, 1)],
                                  "task_id string, page_index int, width int, height int")
    return answers, sizes


def test_chain(tables):
    pages = chain.chain_pages(*tables)
    got = {(r.task_id, r.page_index): (r.page_status, r.block_no, r.text, r.bbox) for r in chain.chain_blocks(pages).collect()}
    assert got == {
        ("a", 0): ("OK", 0, "<p>hi</p>", [0, 0, 50, 200]), ("a", 1): ("UNKNOWN_MODEL", None, None, None),
        ("a", 2): ("UNKNOWN_MODEL", None, None, None), ("b", 0): ("NO_SIZE", 0, "<p>hi</p>", None),
        ("b", 1): ("OK", 0, "d", [1, 2, 3, 4])}
    docs = {r.task_id: (r.pages, r.blocks, r.unknown_pages, r.failed_pages, r.status) for r in chain.chain_documents(pages).collect()}
    assert docs == {"a": (3, 1, 2, 0, "Failed"), "b": (2, 2, 0, 0, "Successed"), "c": (1, 0, 0, 1, "Failed"), "d": (1, 0, 0, 0, "Successed")}
    text = {r.task_id: r.markdown for r in chain.chain_documents(pages).collect()}
    assert text["a"] == "hi\n\nPage 1\n\n---\n\n\nPage 2\n\n---\n\n\nPage 3\n\n---\n"


def test_bucketed_tables_need_one_exchange(spark, tables, tmp_path):
    names = [f"t{uuid.uuid4().hex}" for _ in tables]
    for name, df in zip(names, tables):
        sinks.write_page_table(df, name, 4, f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = chain.chain_documents(chain.chain_pages(*[spark.table(n) for n in names]))
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) == 1
        key = F.struct(*sorted(stored.columns))
        assert set(stored.select(key).collect()) == set(chain.chain_documents(chain.chain_pages(*tables)).select(key).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE {name}")
