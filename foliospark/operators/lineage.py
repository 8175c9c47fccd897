"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpoint_dir(df: DataFrame) -> str:
    """The shared folder the session names; only where none is set (tests on one machine) a
    temporary one is chosen."""
    session = df.sparkSession
    context = session.sparkContext
    folder = (session.conf.get("spark.checkpoint.dir", None)
              or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir())
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="foliospark-")


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the checkpoint folder and continue from the table.

    A table is written in one pass, while ``checkpoint()`` computes its input once to count it and
    once more to save it, which would repeat costly calls in the input.
    """
    path = f"{checkpoint_dir(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
