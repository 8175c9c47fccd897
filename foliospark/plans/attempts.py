"""Retry queries over conversations (a conversation is a page, a turn an attempt) and documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import attempts, requests
from foliospark.plans import fixtures as X
from foliospark.schemas import MODELS, PROMPTS

ATTEMPTS = X.cte("a", "conversations", X.ATTEMPT_COLS)
REPETITIVE = ("(len({0}) >= 1000 AND contains(substr({0}, greatest(len({0}) - 2500, 0) + 1, "
              "least(len({0}) - 500, 2000)), right({0}, 500)))")
CLASSIFIED = f"""{ATTEMPTS}, c AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'API_ERROR'
WHEN {REPETITIVE.format('content')} THEN 'REPETITION'
WHEN lower(finish_reason) = 'length' AND token_count > 10000 THEN 'RUNAWAY'
WHEN lower(finish_reason) = 'length' THEN 'LENGTH'
WHEN model_id <> 'dots' AND trim(content) = '' THEN 'EMPTY'
WHEN model_id = 'dots' AND trim(content) <> '' AND NOT contains(content, '"bbox"') THEN 'PARSE_ERROR'
ELSE 'OK' END AS outcome FROM a)"""


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.with_outcome(X.view(spark, sf, "conversations", X.ATTEMPT_COLS))


def response_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf).select("conv_id", "turn", "model_id", "outcome")


OUTCOME_SQL = f"WITH {CLASSIFIED} SELECT conv_id, turn, model_id, outcome FROM c"


def attempt_select(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.select_attempt(_classified(spark, sf)).select(
        "task_id", "attempt", "outcome", "page_status", "content")


SELECT_SQL = f"""WITH {CLASSIFIED}, r AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY
  CASE WHEN outcome IN ('OK', 'PARSE_ERROR') THEN 0 ELSE 1 END,
  CASE WHEN outcome IN ('OK', 'PARSE_ERROR') THEN attempt ELSE -attempt END) AS k FROM c WHERE attempt <= 3)
SELECT task_id, attempt, outcome, CASE WHEN outcome = 'OK' THEN 'OK' WHEN outcome = 'PARSE_ERROR' THEN 'FAILED'
WHEN attempt < 3 THEN 'PENDING' WHEN outcome = 'EMPTY' THEN 'BLANK' ELSE 'FAILED' END AS page_status, content
FROM r WHERE k = 1"""


def retry_params(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.retry_params(_classified(spark, sf).select(
        "task_id", "page_index", "attempt", "outcome")).drop("page_index")


RETRY_SQL = f"""WITH {CLASSIFIED}, f AS (SELECT task_id, attempt, outcome,
  CASE WHEN outcome IN ('LENGTH', 'REPETITION') THEN 1 ELSE 0 END AS up,
  count(*) FILTER (WHERE outcome = 'EMPTY') OVER (PARTITION BY task_id ORDER BY attempt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS era FROM c WHERE attempt <= 3),
g AS (SELECT *, coalesce(sum(up) OVER (PARTITION BY task_id ORDER BY attempt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ups,
  coalesce(sum(up) OVER (PARTITION BY task_id, era ORDER BY attempt
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS recent FROM f)
SELECT task_id, attempt, outcome, CAST(4096 + 2000 * ups AS INT) AS max_tokens,
CASE recent WHEN 0 THEN NULL WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS frequency_penalty,
CASE recent WHEN 0 THEN NULL WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS presence_penalty FROM g"""


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return attempts.quarantine(_classified(spark, sf)).select(
        "task_id", "attempt", "reason", "content_length", "head", "tail")


QUARANTINE_SQL = f"""WITH {CLASSIFIED} SELECT task_id, attempt,
CASE outcome WHEN 'REPETITION' THEN 'REPETITION' ELSE 'LENGTH' END AS reason,
CAST(len(content) AS INT) AS content_length, left(content, 500) AS head,
CASE WHEN len(content) > 500 THEN right(content, 500) ELSE '' END AS tail FROM c
WHERE outcome IN ('LENGTH', 'REPETITION', 'RUNAWAY')"""


def request_params(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.view(spark, sf, "conversations", X.ATTEMPT_COLS).select(
        "conv_id", "turn", "model_id",
        F.when(F.col("turn") % 3 > 0, F.round(F.col("turn") % 3 * 0.2, 1)).alias("frequency_penalty"))
    return requests.request_params(rows).select(
        "conv_id", "turn", "is_retry", "temperature", "top_p", "repetition_penalty",
        "prompt_text", "message")


def _per_model(values: dict) -> str:
    return "CASE m " + " ".join(
        f"WHEN '{k}' THEN " + ("CAST(NULL AS DOUBLE)" if v is None else f"CAST({v} AS DOUBLE)")
        for k, v in values.items()) + " END"


_PROMPT = "CASE m " + " ".join(
    "WHEN '{}' THEN concat({}, '{}')".format(
        m[0], ", chr(10), ".join(f"'{part}'" for part in m[7].split("\n")),
        next(p[2] for p in PROMPTS if p[0] == m[0] and p[1] == "default")) for m in MODELS) + " END"
REQUEST_SQL = f"""WITH {ATTEMPTS}, q AS (SELECT conv_id, turn, lower(model_id) AS m, turn % 3 > 0 AS is_retry FROM a),
p AS (SELECT *, {_PROMPT} AS prompt_text FROM q)
SELECT conv_id, turn, is_retry,
CASE WHEN is_retry THEN {_per_model({m[0]: m[4] for m in MODELS})} ELSE {_per_model({m[0]: m[3] for m in MODELS})} END AS temperature,
{_per_model({m[0]: m[5] for m in MODELS})} AS top_p,
CASE WHEN is_retry THEN {_per_model({m[0]: m[6] for m in MODELS})} END AS repetition_penalty, prompt_text,
concat('{{"role":"user","content":[{{"type":"image","text":""}},{{"type":"text","text":"',
replace(prompt_text, chr(10), concat(chr(92), 'n')), '"}}]}}') AS message FROM p"""


def stub_engine(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a model: echoes the page text, with faults by page and attempt."""
    turn = batch["doc_id"] + batch["attempt"]
    size = batch["body"].str.len()
    return pd.DataFrame({
        "task_id": batch["task_id"], "page_index": batch["page_index"], "model_id": "deepseekocr",
        "attempt": batch["attempt"],
        "content": batch["body"].where(turn % 7 != 0, " "),
        "finish_reason": (size > batch["max_tokens"]).map({True: "length", False: "stop"}),
        "token_count": size.astype("int32"),
        "error": pd.Series("timeout", index=batch.index).where(turn % 9 == 0, None),
    })


def attempt_rounds(spark: SparkSession, sf: str) -> DataFrame:
    pages = X.pages(spark, sf).select("doc_id", "task_id", "page_index", "body")
    return attempts.attempt_rounds(pages, stub_engine).select(
        "task_id", "page_index", "attempt", "outcome", "token_count")


def _round(k: int) -> str:
    before = "SELECT *, 4096 AS max_tokens FROM p" if k == 1 else (
        f"SELECT * EXCLUDE (content, outcome, max_tokens), max_tokens + CASE WHEN outcome IN "
        f"('LENGTH', 'REPETITION') THEN 2000 ELSE 0 END AS max_tokens FROM o{k - 1} "
        f"WHERE outcome NOT IN ('OK', 'PARSE_ERROR')")
    return f"""w{k} AS ({before}),
e{k} AS (SELECT *, CASE WHEN (doc_id + {k}) % 7 = 0 THEN ' ' ELSE body END AS content FROM w{k}),
o{k} AS (SELECT *, CASE WHEN (doc_id + {k}) % 9 = 0 THEN 'API_ERROR'
  WHEN {REPETITIVE.format('content')} THEN 'REPETITION'
  WHEN len(body) > max_tokens AND len(body) > 10000 THEN 'RUNAWAY' WHEN len(body) > max_tokens THEN 'LENGTH'
  WHEN content = ' ' THEN 'EMPTY' ELSE 'OK' END AS outcome FROM e{k})"""


ROUNDS_SQL = (f"WITH {X.cte('p', 'documents', X.PAGE_COLS)}, {_round(1)}, {_round(2)}, {_round(3)} "
              + " UNION ALL ".join(f"SELECT task_id, page_index, {k} AS attempt, outcome, "
                                   f"CAST(len(body) AS INT) AS token_count FROM o{k}" for k in (1, 2, 3)))

QUERIES = {
    "response_outcome": (response_outcome, OUTCOME_SQL),
    "attempt_select": (attempt_select, SELECT_SQL),
    "retry_params": (retry_params, RETRY_SQL),
    "quarantine": (quarantine, QUARANTINE_SQL),
    "request_params": (request_params, REQUEST_SQL),
    "attempt_rounds": (attempt_rounds, ROUNDS_SQL),
}
