"""Table operators against plain loops, with hot keys."""

import random

from pyspark.sql import functions as F

from foliospark.functions import blocks as K
from foliospark.operators import assemble, attempts, capacity, intake, orient
from foliospark.operators.dedupe import block_dedupe
from foliospark.operators.running import previous_value, running_sums
from foliospark.schemas import models


def loop_cap(blocks):
    seen, boxes, out = {}, set(), []
    for i, (box, category, text) in enumerate(blocks):
        key = (category, text or "")
        seen[key] = seen.get(key, 0) + 1
        if seen[key] > 10:
            continue
        if box is not None:
            if tuple(box) in boxes:
                continue
            boxes.add(tuple(box))
        out.append(i)
    return out


def random_pages(n, seed=5):
    rng = random.Random(seed)
    return [[(None if rng.random() < .3 else [float(rng.randint(0, 30)), 1.0, 2.0, 3.0],
              rng.choice(["Text", "Title"]), rng.choice(["a", "b", "", None]))
             for _ in range(rng.choice([0, 3, 40, 90]))] for _ in range(n)]


def test_block_dedupe_both_forms(spark):
    pages = random_pages(40)
    schema = "page int, blocks array<struct<bbox:array<float>,category:string,text:string>>"
    df = spark.createDataFrame(list(enumerate(pages)), schema)
    want = {p: [pages[p][i] for i in loop_cap(pages[p])] for p in range(len(pages))}
    nested = {r.page: [(b.bbox, b.category, b.text) for b in r.d]
              for r in df.select("page", K.dedupe(F.col("blocks")).alias("d")).collect()}
    assert nested == want
    rows = df.select("page", F.posexplode("blocks").alias("block_no", "b")).select("page", "block_no", "b.*")
    kept = block_dedupe(rows, ("page",)).orderBy("page", "block_no").collect()
    assert [(r.page, r.block_no) for r in kept] == [
        (p, i) for p in range(len(pages)) for i in loop_cap(pages[p])]


def test_dedupe_limits_before_the_exchange(spark):
    rows = spark.range(1000).selectExpr(
        "id % 1 AS page", "id AS block_no", "string(id % 1) AS category", "string(id % 1) AS text",
        "if(id < 0, array(float(id)), null) AS bbox")
    plan = block_dedupe(rows, ("page",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    assert block_dedupe(rows, ("page",)).count() == 10


def share_loop(demand, limit):
    base = limit // len(demand)
    allow = {w: min(d, base) for w, d in demand.items()}
    left = limit - sum(allow.values())
    while left > 0:
        open_ = sorted((w for w in demand if allow[w] < demand[w]),
                       key=lambda w: (-(demand[w] - allow[w]), -demand[w]))
        if not open_:
            break
        for w in open_[:left]:
            allow[w] += 1
        left -= len(open_[:left])
    return sorted((demand[w], a) for w, a in allow.items())


def test_fair_share(spark):
    rng = random.Random(11)
    cases = {"a": ({"x": 2, "y": 20, "z": 5}, 10), "b": ({"x": 1, "y": 2}, 10)}
    for k in range(60):
        n = rng.randint(1, 30)
        cases[f"r{k}"] = ({f"w{i}": rng.randint(0, rng.choice([2, 9, 50])) for i in range(n)}, rng.randint(0, 120))
    demands = spark.createDataFrame([(m, w, d) for m, (ds, _) in cases.items() for w, d in ds.items()],
                                    "model_id string, worker_id string, demand long")
    limits = spark.createDataFrame([(m, c) for m, (_, c) in cases.items()], "model_id string, capacity long")
    got = {}
    for r in capacity.fair_share(demands, limits).collect():
        got.setdefault(r.model_id, []).append((r.demand, r.allow))
    assert {m: sorted(v) for m, v in got.items()} == {m: share_loop(ds, c) for m, (ds, c) in cases.items()}
    assert sorted(got["a"]) == [(2, 2), (5, 4), (20, 4)]


def test_fair_share_hot_class(spark):
    demands = spark.range(5000).select(F.lit("m").alias("model_id"), F.col("id").cast("string").alias("worker_id"),
                                       F.lit(3).cast("long").alias("demand"))
    limits = spark.createDataFrame([("m", 6001)], "model_id string, capacity long")
    got = capacity.fair_share(demands, limits).groupBy("allow").count().collect()
    assert {r.allow: r["count"] for r in got} == {1: 3999, 2: 1001}


def test_capacity_usage(spark):
    demands = spark.createDataFrame([("a", 4), ("a", 7), ("b", 1)], "model_id string, used int")
    limits = spark.createDataFrame([("a", 11), ("b", 2), ("c", 5)], "model_id string, capacity int")
    got = {r.model_id: (r.used, r.workers, r.exhausted) for r in capacity.capacity_usage(demands, limits).collect()}
    assert got == {"a": (11, 2, True), "b": (1, 1, False), "c": (0, 0, False)}


def outcomes(spark, pages):
    rows = [(p, 0, a + 1, o) for p, seq in pages.items() for a, o in enumerate(seq)]
    return spark.createDataFrame(rows, "task_id string, page_index int, attempt int, outcome string")


def test_retry_params(spark):
    df = outcomes(spark, {"r1": ["LENGTH", "EMPTY", "OK"], "r2": ["REPETITION"] * 3,
                          "r3": ["API_ERROR", "LENGTH", "RUNAWAY"], "r4": ["OK"]})
    got = {}
    for r in attempts.retry_params(df).orderBy("task_id", "attempt").collect():
        got.setdefault(r.task_id, []).append((r.max_tokens, r.frequency_penalty))
    assert got == {"r1": [(4096, None), (6096, .2), (6096, None)],
                   "r2": [(4096, None), (6096, .2), (8096, .4)],
                   "r3": [(4096, None), (4096, None), (6096, .2)], "r4": [(4096, None)]}


def test_select_attempt(spark):
    df = outcomes(spark, {"a": ["LENGTH", "OK", "OK"], "b": ["EMPTY", "EMPTY", "EMPTY"], "c": ["EMPTY"],
                          "d": ["REPETITION"] * 3 + ["OK"], "e": ["API_ERROR", "PARSE_ERROR"]})
    got = {r.task_id: (r.attempt, r.page_status) for r in attempts.select_attempt(df).collect()}
    assert got == {"a": (2, "OK"), "b": (3, "BLANK"), "c": (1, "PENDING"), "d": (3, "FAILED"), "e": (2, "FAILED")}


def test_documents(spark):
    pages = spark.createDataFrame([("t", 1, ""), ("t", 0, "x"), ("u", 0, "y")],
                                  "task_id string, page_index int, markdown string")
    got = {r.task_id: r.markdown for r in assemble.document_markdown(pages).collect()}
    assert got == {"t": "x\n\nPage 1\n\n---\n\n\nPage 2\n\n---\n", "u": "y\n\nPage 1\n\n---\n"}
    many = spark.range(1200).selectExpr("'v' AS task_id", "CAST(id AS int) AS page_index", "'z' AS markdown")
    assert assemble.document_markdown(many).first().pages == 1200


def test_requests_of_any_model_stay(spark):
    from foliospark.operators.requests import request_params
    rows = spark.createDataFrame([(1, "DOTS", None), (2, "nothing", None), (3, None, 0.2)],
                                 "id int, model_id string, frequency_penalty double")
    got = {r.id: r.reason for r in request_params(rows).collect()}
    assert got == {1: None, 2: "NO_MODEL_OR_PROMPT", 3: "NO_MODEL_OR_PROMPT"}


def test_uploads_that_the_scan_lacks_are_rejected(spark):
    rows = spark.createDataFrame([(10, "dots", None, None, None, 3)], "length long, model_id string, "
                                 "file_exists boolean, stored_length long, readable boolean, total_pages int")
    assert intake.validate_uploads(rows).first().reject_reason == "FILE_NOT_FOUND"


def test_running_values_keep_rows_without_an_order_value(spark):
    from foliospark.operators.running import running_sums
    rows = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 9, 3)], "k string, t int, i int")
    got = running_sums(rows, ["k"], ["t", "i"], {"n": F.lit(1)}, ranges=3)
    assert sorted((r.i, r.n) for r in got.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_running_values_on_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < .5 else rng.randint(1, 5), rng.randint(0, 500), i, rng.randint(-3, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int")
    got = running_sums(df, ["k"], ["t", "id"], {"s": F.col("v")}, {"whole": "s"}, ranges=7)
    got = previous_value(got, ["k"], ["t", "id"], "p", "v", ranges=7)
    have = {r.id: (r.s, r.whole, r.p) for r in got.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine, total, last = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 0, None
        whole = sum(r[3] for r in mine)
        for r in mine:
            total += r[3]
            want[r[2]] = (total, whole, last)
            last = r[3]
    assert have == want


def test_orientation_positions(spark):
    pages = spark.createDataFrame([("t", i, i != 1) for i in range(5)], "task_id string, page_index int, has_image boolean")
    batch = '{"status":"success","predictions":[{"orientation":"90"},{"orientation":"x"},{"orientation":"270"}]}'
    batches = spark.createDataFrame([("t", batch)], "task_id string, batch_json string")
    got = {r.page_index: r.rotation for r in orient.apply_orientation(pages, batches).collect()}
    assert got == {0: 90, 1: 0, 2: 0, 3: 270, 4: 0}


def test_validation_order_and_models(spark):
    rows = [(0, "dots", True, 0, True, 1), (5, " dots", True, 5, True, 1), (5, "Dots", False, 0, True, 1),
            (5, "DOTS", True, 0, False, 1), (5, "dots", True, 5, False, 0), (5, "dots", True, 5, True, 0),
            (5, "deepSeekOcr", True, 5, True, 2)]
    df = spark.createDataFrame(rows, "length long, model_id string, file_exists boolean, stored_length long, "
                                     "readable boolean, total_pages int").coalesce(1)
    got = [r.reject_reason for r in intake.validate_uploads(df).collect()]
    assert got == ["NO_FILE", "UNSUPPORTED_MODEL", "FILE_NOT_FOUND", "EMPTY_FILE", "UNREADABLE", "NO_PAGES", None]
    assert models(spark).count() == 3


def test_conflicts_by_suffix(spark):
    up = spark.createDataFrame([("c.pdf",), ("b_c.pdf",), ("x.pdf",), ("a_b_c.pdf",)], "file_name string")
    stored = spark.createDataFrame([("a_b_c.pdf",), ("x.pdf",)], "stored_name string")
    kept = lambda strict: {r.file_name for r in intake.without_conflicts(up, stored, strict).collect()}
    assert kept(True) == {"x.pdf", "a_b_c.pdf"}
    assert kept(False) == {"c.pdf", "a_b_c.pdf"}


def test_names(spark):
    df = spark.createDataFrame([("h-1_scan", "h-1"), ("h-1___scan", "h-1"), ("scan", "h-1")], "s string, t string")
    assert [r.n for r in df.select(intake.output_name(F.col("s"), F.col("t")).alias("n")).collect()] == ["scan"] * 3
    ids = df.select(intake.task_id(F.lit("My.Host_1"), F.col("s")).alias("i")).collect()
    assert all(r.i.startswith("myhost1-") for r in ids) and len({r.i for r in ids}) == 3


def test_a_hot_key_in_one_hour_is_split(spark):
    """A key with all its events in one second lies in several ranges, and its windows know the range."""
    from foliospark.operators.running import dealt
    df = spark.range(4000).selectExpr("'hot' AS k", "timestamp'2024-01-01 10:00:00' AS t", "id", "1 AS v")
    sizes = [r["count"] for r in dealt(df, ["k"], ["t", "id"], 8).groupBy("k", "_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    counted = running_sums(df, ["k"], ["t", "id"], {"n": F.lit(1)}, ranges=8)
    assert counted.filter("n <> id + 1").isEmpty()
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and "_range#" in plan.split("hashpartitioning(k#")[1].split(")")[0]


def test_a_supported_model_without_settings_is_told_apart(spark):
    listed = models(spark)
    names = sorted(r.model_id for r in listed.collect())
    settings = listed.filter(F.col("model_id") != names[0])
    asked = spark.createDataFrame([(n, 1) for n in [*names, "none of them"]], "model_id string, length long")
    checked = intake.validate_uploads(asked.select(
        "*", F.lit(True).alias("file_exists"), F.lit(1).alias("stored_length"), F.lit(True).alias("readable"),
        F.lit(1).alias("total_pages")), settings)
    got = {r.model_id: r.reject_reason for r in checked.collect()}
    assert got == {names[0]: "NO_MODEL_CONFIG", "none of them": "UNSUPPORTED_MODEL", **dict.fromkeys(names[1:])}


def test_model_calls_get_small_batches(spark):
    from foliospark.operators import attempts

    def engine(batch):
        assert len(batch) <= attempts.CALL_ROWS
        return batch[["task_id", "page_index", "attempt"]].assign(
            model_id="deepseekocr", content="x", finish_reason="stop", token_count=len(batch), error=None)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages = spark.range(1000, numPartitions=1).selectExpr("'t' AS task_id", "CAST(id AS INT) AS page_index")
    rows = attempts.attempt_rounds(pages, engine).collect()
    assert len({r.page_index for r in rows}) == len(rows) == 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
