"""Retry handling: outcomes, attempt choice, retry parameters, quarantine and model rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.quality import outcome
from foliospark.operators.lineage import cut
from foliospark.schemas import (BASE_MAX_TOKENS, MAX_ATTEMPTS, PENALTY_STEP, RESPONSE, TOKEN_STEP)

PAGE = ("task_id", "page_index")
RETRIED = ("LENGTH", "REPETITION")
BAD = ("LENGTH", "REPETITION", "RUNAWAY")
FINAL = ("OK", "PARSE_ERROR")
#: Requests that a model gets at a time, at most: they and their answers are what a Python process holds.
CALL_ROWS = 256


def with_outcome(responses: DataFrame) -> DataFrame:
    return responses.withColumn("outcome", outcome(
        F.col("model_id"), F.col("content"), F.col("finish_reason"), F.col("token_count"),
        F.col("error")))


def select_attempt(classified: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """The deciding attempt of each page and its ``page_status`` (OK, BLANK, FAILED).

    The first OK or PARSE_ERROR attempt decides, otherwise the last allowed one. Both rules are one
    rank, so a single min_by aggregate sends one row per page and task, however hot the page.
    """
    rest = [c for c in classified.columns if c not in keys]
    rank = F.when(F.col("outcome").isin(*FINAL), F.col("attempt")).otherwise(
        2 * MAX_ATTEMPTS - F.col("attempt") + 1)
    picked = (classified.filter(F.col("attempt") <= MAX_ATTEMPTS).groupBy(*keys)
              .agg(F.min_by(F.struct(*rest), rank).alias("r")))
    status = (F.when(F.col("outcome") == "OK", "OK")
              .when((F.col("outcome") == "EMPTY") & (F.col("attempt") == MAX_ATTEMPTS), "BLANK")
              .when(F.col("outcome").isin(*FINAL) | (F.col("attempt") == MAX_ATTEMPTS), "FAILED")
              .otherwise("PENDING"))
    return (picked.select(*keys, *[F.col(f"r.{c}") for c in rest])
            .withColumn("page_status", status))


def retry_params(classified: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Parameters in force before each attempt of a page, one row per attempt seen.

    Tokens grow with every LENGTH or REPETITION so far; the penalties grow with those since the
    last EMPTY and are null when there is none. A page has three attempts at most, so the outcomes
    are pivoted by a partial aggregate into three fields instead of a window over the page.
    """
    steps = range(1, MAX_ATTEMPTS + 1)
    wide = classified.groupBy(*keys).agg(*[
        F.max(F.when(F.col("attempt") == k, F.col("outcome"))).alias(f"o{k}") for k in steps])

    def flag(k: int):
        return F.coalesce(F.col(f"o{k}").isin(*RETRIED), F.lit(False)).cast("int")

    def reset(k: int):
        return F.coalesce(F.col(f"o{k}") == "EMPTY", F.lit(False))

    rows = []
    raised, since = F.lit(0), F.lit(0)
    for k in steps:
        rows.append(F.struct(
            F.lit(k).alias("attempt"), F.col(f"o{k}").alias("outcome"),
            (F.lit(BASE_MAX_TOKENS) + raised * TOKEN_STEP).alias("max_tokens"),
            F.when(since > 0, F.round(since * PENALTY_STEP, 1)).alias("penalty")))
        raised = raised + flag(k)
        since = F.when(reset(k), 0).otherwise(since + flag(k))
    return (wide.select(*keys, F.inline(F.filter(F.array(*rows), lambda r: r["outcome"].isNotNull())))
            .select(*keys, "attempt", "outcome", "max_tokens",
                    F.col("penalty").alias("frequency_penalty"),
                    F.col("penalty").alias("presence_penalty")))


def quarantine(classified: DataFrame) -> DataFrame:
    """Bad responses with their reason, length and a preview of both ends; content stays whole."""
    n = F.length("content")
    return (classified.filter(F.col("outcome").isin(*BAD))
            .withColumn("reason", F.when(F.col("outcome") == "REPETITION", "REPETITION").otherwise("LENGTH"))
            .withColumn("content_length", n)
            .withColumn("head", F.left("content", F.lit(500)))
            .withColumn("tail", F.when(n > 500, F.right("content", F.lit(500))).otherwise("")))


@contextmanager
def _small_batches(session: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``CALL_ROWS`` rows; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = session.conf.get(name)
    session.conf.set(name, str(min(int(before), CALL_ROWS) if int(before) > 0 else CALL_ROWS))
    try:
        yield
    finally:
        session.conf.set(name, before)


def attempt_rounds(requests: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame],
                   keys: tuple[str, ...] = PAGE, parallelism: int | None = None) -> DataFrame:
    """Run a pluggable model over page requests in up to three rounds.

    ``engine`` maps a batch of requests (with ``attempt``, ``max_tokens`` and the penalties) to the
    response columns, at most ``CALL_ROWS`` at a time; ``parallelism`` bounds how many tasks call it at once. Each round's answers
    are stored before they are used, so a lost executor never repeats finished model calls. Every
    answer is kept: the result holds one row per attempt with its outcome.
    """
    key_fields = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    schema = (key_fields + ", model_id string, attempt int, content string, finish_reason string, "
              "token_count int, error string")
    names = [*keys, *[f.name for f in RESPONSE if f.name not in keys]]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield engine(batch)[names]

    pending = (requests.withColumn("max_tokens", F.lit(BASE_MAX_TOKENS))
               .withColumn("penalty", F.lit(None).cast("double")))
    answers = None
    for attempt in range(1, MAX_ATTEMPTS + 1):
        work = pending.withColumn("attempt", F.lit(attempt))
        if parallelism:
            work = work.repartition(parallelism)
        with _small_batches(requests.sparkSession):
            done = cut(with_outcome(work.mapInPandas(call, schema)))
        answers = done if answers is None else answers.unionByName(done)
        if attempt < MAX_ATTEMPTS:
            again = done.filter(~F.col("outcome").isin(*FINAL)).select(*keys, "outcome")
            raised = F.col("outcome").isin(*RETRIED)
            pending = pending.join(again, [*keys]).select(
                *requests.columns,
                F.when(raised, F.col("max_tokens") + TOKEN_STEP).otherwise(F.col("max_tokens"))
                .alias("max_tokens"),
                F.when(raised, F.coalesce("penalty", F.lit(0.0)) + PENALTY_STEP)
                .when(F.col("outcome") != "EMPTY", F.col("penalty")).alias("penalty"))
    return answers
