"""Model request parameters and message bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.schemas import models, prompts


def request_params(requests: DataFrame, mode: str = "default") -> DataFrame:
    """Sampling parameters, prompt and message of each page request.

    Model ids match in any case. A request whose model is unknown or has no prompt for the mode stays,
    with a ``reason`` and without parameters. A request is a retry when it carries a penalty. Both dimensions are fixed local relations, so
    the joins are map-side.
    """
    spark = requests.sparkSession
    catalogue = prompts(spark).filter(F.col("mode") == mode).drop("mode")
    settings = models(spark).join(catalogue, "model_id")
    retry = F.col("frequency_penalty").isNotNull()
    part = F.struct(F.lit("text").alias("type"), F.col("prompt_text").alias("text"))
    image = F.struct(F.lit("image").alias("type"), F.lit("").alias("text"))
    settings = settings.withColumnRenamed("model_id", "_model")
    return (requests.join(settings, F.lower("model_id") == F.col("_model"), "left")
            .withColumn("reason", F.when(F.col("_model").isNull(), "NO_MODEL_OR_PROMPT")).drop("_model")
            .withColumn("is_retry", retry)
            .withColumn("request_temperature",
                        F.when(retry, F.col("retry_temperature")).otherwise(F.col("temperature")))
            .withColumn("repetition_penalty", F.when(retry, F.col("retry_repetition_penalty")))
            .withColumn("prompt_text", F.concat("prompt_prefix", "prompt"))
            .withColumn("message", F.to_json(F.struct(
                F.lit("user").alias("role"), F.array(image, part).alias("content"))))
            .drop("temperature", "retry_temperature", "retry_repetition_penalty", "prompt_prefix",
                  "prompt")
            .withColumnRenamed("request_temperature", "temperature"))
