"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target t and size s is wanted t / s times: its whole part for certain,
the rest with a probability. Two documents with probabilities strictly between 0 and 1 move mass
from one to the other, in words, so that the words wanted in total stay the same and each
probability stays right on average, until one of the two is 0 or 1. A chunk of documents leaves at
most one fractional document; these meet in groups of ``FAN_IN`` in the next level of a tree, until
each source has one left, which is rounded by its own probability.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from foliospark.operators.lineage import cut

from .common import mix_int, n_words, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
CHUNK = 20_000
FAN_IN = 64
NEAR = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, n_docs, source_size, target from rows (source, size); one row per source.

    Sources in code point order, null last, get the weights in turn. Targets share all words by
    weight, stop at ``most`` times the source's size, and the rest is shared again: with the sources
    in order of size over weight, the first one whose share fits sets the level for all after it.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # a row per source from here on, so the windows without a key hold a short table
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", turn)
    tight = F.col("source_size") * most / F.col("weight")
    line = W.orderBy(tight, F.col("source").isNull(), "source")
    before = line.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)))
             / F.sum("weight").over(line.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("level", level).withColumn("fits", F.col("level") <= tight * (1 + 1e-12))
    first = F.min_by("level", F.when(F.col("fits"), tight)).over(whole)
    return by.withColumn("water", first).select(
        "source", "n_docs", "source_size",
        F.least(F.col("source_size") * most, F.coalesce(F.col("water") * F.col("weight"), F.lit(0.0))).alias("target"))


def chance(a: int, b: int, seed: int) -> float:
    """A number in [0, 1) that depends on two ids and the seed only."""
    return mix_int(mix_int(a ^ seed * 0x9E3779B9) ^ b) / 2.0 ** 64


def pivot(ids: list[int], sizes: list[float], probs: list[float], seed: int) -> list[float]:
    """Probabilities after pairing: at most one is still between 0 and 1."""
    probs = list(probs)
    held = None
    for i, p in enumerate(probs):
        if not NEAR < p < 1 - NEAR:
            probs[i] = float(round(p))
            continue
        if held is None:
            held = i
            continue
        j = held
        a, b, pj, pi = sizes[j], sizes[i], probs[j], probs[i]
        up = min((1 - pj) * a, pi * b)      # words that can move from i to j
        down = min(pj * a, (1 - pi) * b)    # and back
        if chance(ids[j], ids[i], seed) * (up + down) < down:
            pj, pi = pj + up / a, pi - up / b
        else:
            pj, pi = pj - down / a, pi + down / b
        held = None
        for k, v in ((j, pj), (i, pi)):
            if NEAR < v < 1 - NEAR:
                held, probs[k] = k, v
            else:
                probs[k] = float(round(v))
    return probs


def mixed_copies(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST,
                 seed: int = 17) -> DataFrame:
    """Rows (key, source, size) with source_size, target and copies, the times each is taken.

    ``key`` is a long that orders equal sources and seeds the choice; ties are equal rows, between
    which it does not matter. Rows without words are never taken. Null sources are one source.
    """
    targets = cut(source_targets(sizes, weights, most))
    t = targets.select(F.col("source").alias("of"), "n_docs", "source_size", "target")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.when(F.abs(want - F.round(want)) < NEAR, F.round(want)).otherwise(want)
    rows = (sizes.join(t, sizes["source"].eqNullSafe(t["of"])).drop("of")
            .withColumn("want", F.when(F.col("size") > 0, near).otherwise(F.lit(0.0)))
            .withColumn("sure", F.floor("want")).withColumn("p", F.col("want") - F.col("sure"))
            .withColumn("chunk", F.pmod(F.xxhash64("key", "size"),
                                        F.ceil(F.col("n_docs") / CHUNK).cast("long"))))
    columns = ["key", "source", "size", "source_size", "target", "sure", "p", "chunk"]
    rows = rows.select(*columns)
    kind = rows.schema

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "size"], kind="stable")
        keys = [0 if pd.isna(k) else int(k) for k in pdf["key"]]
        pdf["p"] = pivot(keys, pdf["size"].astype(float).tolist(), pdf["p"].tolist(), seed)
        return pdf

    most_docs = targets.agg(F.max("n_docs")).first()[0] or 0
    chunks = -(-most_docs // CHUNK)
    done = []
    loose = rows
    while True:
        loose = cut(loose.groupBy("source", "chunk").applyInPandas(level, kind))
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        if chunks <= 1:
            last = F.pmod(F.xxhash64(F.coalesce("key", F.lit(0)), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
            done.append(loose.withColumn("p", F.when(whole, F.col("p")).otherwise(
                F.when(last < F.col("p"), 1.0).otherwise(0.0))))
            break
        done.append(loose.filter(whole))
        loose = loose.filter(~whole).withColumn("chunk", F.floor(F.col("chunk") / FAN_IN).cast("long"))
        chunks = -(-chunks // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("key", "source", "size", "source_size", "target",
                      (F.col("sure") + F.col("p")).cast("long").alias("copies"))


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of ``docs``; ``taken`` in words.

    Null texts have no words. Rows that repeat a doc_id count as documents each. Reruns agree, as
    every choice depends on ids and sizes only. An empty table gives no rows.
    """
    sizes = docs.select(F.col("doc_id").alias("key"), "source", n_words(F.col("text")).alias("size"))
    return mixed_copies(sizes).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged.

    Rows are told apart by a hash of id, source and text; equal rows share their copies in order.
    """
    key = F.xxhash64("doc_id", "source", "text")
    turn = F.row_number().over(W.partitionBy("_key").orderBy(F.lit(0)))
    rows = docs.select(whole_row(docs), key.alias("_key"), "source",
                       n_words(F.col("text")).alias("size"))
    copies = mixed_copies(rows.select(F.col("_key").alias("key"), "source", "size"))
    copies = copies.select(F.col("key").alias("_key"), "copies", F.row_number().over(
        W.partitionBy("key").orderBy(F.desc("copies"))).alias("_turn"))
    return (rows.withColumn("_turn", turn).join(copies, ["_key", "_turn"])
            .filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("_row.*"))
