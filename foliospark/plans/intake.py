"""Intake queries: uploads, naming, page fan-out, conflicts, cancellation, outputs, orientation,
capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import capacity, intake
from foliospark.operators import orient
from foliospark.plans import fixtures as X
from foliospark.schemas import MODELS
from foliospark.sources import readers
from foliospark.sources.readers import spread

UPLOADS = X.cte("u", "documents", X.UPLOAD_COLS)
_MODEL = ("CASE lower(model_id) " + " ".join(f"WHEN '{m[0]}' THEN {{{k}}}" for k, m in enumerate(MODELS))
          + " END")
MODEL_NAME = _MODEL.format(*[f"'{m[1]}'" for m in MODELS])
MODEL_LIMIT = _MODEL.format(*[m[2] for m in MODELS])


def _uploads(spark: SparkSession, sf: str) -> DataFrame:
    return X.view(spark, sf, "documents", X.UPLOAD_COLS)


def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return intake.validate_uploads(_uploads(spark, sf)).select("doc_id", "file_name", "reject_reason")


VALIDATE_SQL = f"""WITH {UPLOADS} SELECT doc_id, file_name, CASE
WHEN length = 0 THEN 'NO_FILE'
WHEN lower(model_id) NOT IN ('dots', 'chandra', 'deepseekocr') THEN 'UNSUPPORTED_MODEL'
WHEN NOT file_exists THEN 'FILE_NOT_FOUND' WHEN stored_length = 0 THEN 'EMPTY_FILE'
WHEN NOT readable THEN 'UNREADABLE' WHEN total_pages <= 0 THEN 'NO_PAGES' END AS reject_reason FROM u"""


def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return intake.resolve_models(_uploads(spark, sf)).select(
        "doc_id", "model_id", "queue", "supported", "model_name", "concurrency")


MODEL_LOOKUP_SQL = f"""WITH {UPLOADS} SELECT doc_id, model_id, lower(trim(model_id)) AS queue,
lower(model_id) IN ('dots', 'chandra', 'deepseekocr') AS supported, {MODEL_NAME} AS model_name,
CAST({MODEL_LIMIT} AS INT) AS concurrency FROM u"""


def task_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.table(spark, sf, "documents").select("doc_id", "source", "text")
    host = F.concat(F.lit("OCR_Node."), F.col("source"))
    return docs.select("doc_id", intake.task_id(host, F.col("doc_id").cast("string"),
                                                F.col("text")).alias("task_id"))


TASK_ID_SQL = """SELECT doc_id, concat('ocrnode', lower(regexp_replace(source, '[^a-zA-Z0-9]', '', 'g')),
'-', sha256(concat(doc_id, chr(1), text))) AS task_id FROM documents"""


def output_name(spark: SparkSession, sf: str) -> DataFrame:
    up = X.view(spark, sf, "documents", X.UPLOAD_COLS).select("doc_id", "file_name")
    task = F.concat(F.lit("host-"), F.col("doc_id"))
    stem = F.regexp_replace("file_name", r"\.pdf$", "")
    stored = F.when(F.col("doc_id") % 3 == 0, F.concat(task, F.lit("_"), stem)).when(
        F.col("doc_id") % 3 == 1, F.concat(task, F.lit("___"), stem)).otherwise(stem)
    when = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id)")
    return up.select("doc_id", intake.output_name(stored, task).alias("clean_name"),
                     intake.output_file(stored, task, when).alias("output_file"))


OUTPUT_NAME_SQL = f"""WITH {UPLOADS}, n AS (SELECT doc_id, replace(file_name, '.pdf', '') AS clean_name FROM u)
SELECT doc_id, clean_name, concat(clean_name, '_host-', doc_id, '_', strftime(
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id), '%Y%m%d_%H%M%S'), '.md') AS output_file FROM n"""


def page_fanout(spark: SparkSession, sf: str) -> DataFrame:
    tasks = X.view(spark, sf, "orders", ("o_orderkey AS task_id", "CAST(o_orderkey % 9 - 1 AS INT) AS total_pages"))
    return intake.page_fanout(tasks)


PAGE_FANOUT_SQL = """SELECT task_id, total_pages, CAST(unnest(range(total_pages)) AS INT) AS page_index
FROM (SELECT o_orderkey AS task_id, CAST(o_orderkey % 9 - 1 AS INT) AS total_pages FROM orders)
WHERE total_pages > 0"""


def conflict_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads whose name no stored file ends with."""
    up = _uploads(spark, sf).select("doc_id", "file_name")
    stored = X.view(spark, sf, "documents", (
        "CASE WHEN doc_id % 97 < 60 THEN concat('host-', doc_id, '_', source, '_', lang, "
        "CAST(doc_id % 97 AS INT), '.pdf') ELSE concat('x', source, lang, '.pdf') END AS stored_name",))
    return intake.without_conflicts(up, stored)


CONFLICT_SQL = f"""WITH {UPLOADS}, s AS (SELECT DISTINCT CASE WHEN doc_id % 97 < 60 THEN concat('host-', doc_id, '_',
source, '_', lang, CAST(doc_id % 97 AS INT), '.pdf') ELSE concat('x', source, lang, '.pdf') END AS stored_name
FROM documents) SELECT doc_id, file_name FROM u
WHERE NOT EXISTS (SELECT 1 FROM s WHERE ends_with(stored_name, '_' || file_name))"""

_WORK = ("o_custkey AS task_id", "o_orderkey AS work_id", "o_orderpriority AS model_id")


def _cancelled(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("task_id"))


def cancel_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    return intake.without_cancelled(X.view(spark, sf, "orders", _WORK), _cancelled(spark, sf))


def cancel_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return intake.cancelled_found(X.view(spark, sf, "orders", _WORK), _cancelled(spark, sf))


CANCEL_ANTI_SQL = f"""SELECT {', '.join(_WORK)} FROM orders WHERE o_custkey NOT IN
(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""
CANCEL_SEMI_SQL = """SELECT DISTINCT c_custkey AS task_id FROM customer
WHERE c_acctbal < 0 AND c_custkey IN (SELECT o_custkey FROM orders)"""


def latest_output(spark: SparkSession, sf: str) -> DataFrame:
    outputs = X.view(spark, sf, "orders", (
        "concat('/out/scan_', o_orderpriority, '_c', o_custkey, '_20240101_', "
        "CAST(100000 + o_orderkey % 800000 AS INT), '.md') AS path", "o_orderdate AS modified"))
    return intake.latest_output(outputs)


LATEST_OUTPUT_SQL = """WITH o AS (SELECT concat('c', o_custkey) AS task_id, concat('/out/scan_',
o_orderpriority, '_c', o_custkey, '_20240101_', CAST(100000 + o_orderkey % 800000 AS INT), '.md') AS path,
o_orderdate AS modified FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY task_id
ORDER BY modified DESC, path DESC) AS k, count(*) OVER (PARTITION BY task_id) AS versions FROM o)
SELECT task_id, path, versions FROM r WHERE k = 1"""

_TASKS = ("o_orderkey AS task_id", "CAST(o_orderkey % 7 + 1 AS INT) AS total_pages",
          "CAST(o_orderkey % 3 - 1 AS INT) AS surplus")


def orientation_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as tasks: some pages have no image, some batches are too short, some values bad."""
    tasks = spread(X.table(spark, sf, "orders").select("o_orderkey")).selectExpr(*_TASKS)
    fan = intake.page_fanout(tasks.select("task_id", "total_pages"))
    pages_ = fan.select("task_id", "page_index",
                        ((F.col("task_id") + F.col("page_index")) % 4 != 0).alias("has_image"))
    count = F.greatest(F.col("total_pages") + F.col("surplus"), F.lit(0))
    angle = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>")), lambda k: F.struct(
            F.concat(F.lit("page_"), k + 1, F.lit(".jpg")).alias("filename"),
            F.when(k % 5 == 4, "n/a").otherwise(((F.col("task_id") + k) % 4 * 90).cast("string"))
            .alias("orientation"), F.lit(0.5).alias("confidence")))
    batches = tasks.select("task_id", F.to_json(F.struct(
        F.lit("success").alias("status"), angle.alias("predictions"),
        count.alias("processed"), count.alias("total_uploaded"))).alias("batch_json"))
    return orient.apply_orientation(pages_, batches)


ORIENTATION_SQL = f"""WITH t AS (SELECT {', '.join(_TASKS)} FROM orders),
pg AS (SELECT task_id, total_pages, surplus, CAST(unnest(range(total_pages)) AS INT) AS page_index FROM t),
h AS (SELECT *, (task_id + page_index) % 4 <> 0 AS has_image FROM pg),
n AS (SELECT *, count(*) FILTER (WHERE has_image) OVER (PARTITION BY task_id ORDER BY page_index) - 1 AS k FROM h),
r AS (SELECT task_id, page_index, has_image, CAST(CASE WHEN has_image AND k < total_pages + surplus AND k % 5 <> 4
  THEN (task_id + k) % 4 * 90 ELSE 0 END AS INT) AS rotation FROM n)
SELECT task_id, page_index, has_image, rotation, -rotation AS correction FROM r"""

_DEMAND = "SELECT o_orderpriority AS model_id, o_custkey AS worker_id, count(*) AS demand FROM orders GROUP BY ALL"
# Limits that leave each model in another situation: plenty, scarce, less than one slot each.
_LIMIT = ("CASE left(o_orderpriority, 1) WHEN '1' THEN 2 * count(*) WHEN '2' THEN CAST(floor(count(*) * 3 / 4) AS BIGINT) "
          "WHEN '3' THEN CAST(floor(count(*) / 2) AS BIGINT) + 7 WHEN '4' THEN 13 ELSE CAST(floor(count(*) * 9 / 10) AS BIGINT) END")


def _demands(spark: SparkSession, sf: str) -> DataFrame:
    orders = X.table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("model_id"),
                          F.col("o_custkey").cast("string").alias("worker_id")).agg(
        F.count("*").alias("demand"))


def _limits(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model_id")).agg(
        F.expr(_LIMIT).alias("capacity"))


def fair_share(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.fair_share(_demands(spark, sf), _limits(spark, sf))


# The allocation is replayed in rounds: an equal first share, then one slot per round to every
# worker below its demand, largest gap first, until the slots run out.
FAIR_SHARE_SQL = f"""WITH RECURSIVE d AS (SELECT o_orderpriority AS model_id, CAST(o_custkey AS VARCHAR) AS worker_id,
  count(*) AS demand FROM orders GROUP BY ALL),
l AS (SELECT o_orderpriority AS model_id, {_LIMIT} AS capacity FROM orders GROUP BY o_orderpriority),
w AS (SELECT d.*, capacity, count(*) OVER (PARTITION BY d.model_id) AS n FROM d JOIN l USING (model_id)),
start AS (SELECT model_id, worker_id, demand, capacity, least(demand, capacity // n) AS allow FROM w),
play AS (
  SELECT 0 AS step, model_id, worker_id, demand, allow,
         CAST(capacity - sum(allow) OVER (PARTITION BY model_id) AS BIGINT) AS spare FROM start
  UNION ALL
  SELECT step + 1, model_id, worker_id, demand, allow + given,
         CAST(spare - sum(given) OVER (PARTITION BY model_id) AS BIGINT)
  FROM (SELECT *, CASE WHEN demand > allow AND row_number() OVER (PARTITION BY model_id
          ORDER BY demand > allow DESC, demand - allow DESC, demand DESC, md5(worker_id)) <= spare
          THEN 1 ELSE 0 END AS given,
          bool_or(demand > allow) OVER (PARTITION BY model_id) AS open FROM play) WHERE spare > 0 AND open),
last_step AS (SELECT model_id, max(step) AS step FROM play GROUP BY model_id)
SELECT model_id, worker_id, demand, allow FROM play JOIN last_step USING (model_id, step)"""


def capacity_usage(spark: SparkSession, sf: str) -> DataFrame:
    used = X.view(spark, sf, "orders", ("o_orderpriority AS model_id", "o_custkey AS worker_id",
                                        "o_orderkey % 3 AS used"))
    return capacity.capacity_usage(used, _limits(spark, sf))


CAPACITY_SQL = f"""SELECT o_orderpriority AS model_id, {_LIMIT} AS capacity,
CAST(sum(o_orderkey % 3) AS BIGINT) AS used, count(*) AS workers,
sum(o_orderkey % 3) >= {_LIMIT} AS exhausted FROM orders GROUP BY o_orderpriority"""

QUERIES = {
    "validate_uploads": (validate_uploads, VALIDATE_SQL),
    "model_lookup": (model_lookup, MODEL_LOOKUP_SQL),
    "task_id": (task_id, TASK_ID_SQL),
    "output_name": (output_name, OUTPUT_NAME_SQL),
    "page_fanout": (page_fanout, PAGE_FANOUT_SQL),
    "conflict_anti_join": (conflict_anti_join, CONFLICT_SQL),
    "cancel_anti_join": (cancel_anti_join, CANCEL_ANTI_SQL),
    "cancel_semi_join": (cancel_semi_join, CANCEL_SEMI_SQL),
    "latest_output": (latest_output, LATEST_OUTPUT_SQL),
    "orientation_apply": (orientation_apply, ORIENTATION_SQL),
    "fair_share": (fair_share, FAIR_SHARE_SQL),
    "capacity_usage": (capacity_usage, CAPACITY_SQL),
}
