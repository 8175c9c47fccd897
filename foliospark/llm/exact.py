"""Exact de-duplication with counting quotient filters.

A fingerprint of 64 bits is split into a quotient (its high bits, the home slot) and a remainder.
A filter keeps, per occupied quotient, a run of sorted remainders with their counters. Nothing of
the fingerprint is lost, so two filters merge by walking their runs in order and adding counters.
Filters are built per task and cut into ranges of quotients; a range is merged in one task and its
size is a share of the documents. Fingerprints with a count above one route their documents to the
comparison of the bytes; all others are done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS

FLUSH = 1_000_000
PER_RANGE = 100_000


class QuotientFilter:
    """Runs of sorted remainders with counters; ``q`` quotient bits, ``64 - q`` remainder bits."""

    def __init__(self, q: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray,
                 counts: np.ndarray):
        self.q, self.occupied, self.run_ends = q, occupied, run_ends
        self.remainders, self.counts = remainders, counts

    @classmethod
    def build(cls, prints: np.ndarray, q: int, counts: np.ndarray | None = None) -> QuotientFilter:
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.r_[True, prints[1:] != prints[:-1]] if len(prints) else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        prints, counts = prints[starts], (np.add.reduceat(counts, starts) if len(starts) else counts)
        shift = np.uint64(64 - q)
        home = prints >> shift
        ends = np.flatnonzero(np.r_[home[1:] != home[:-1], True]) if len(home) else starts
        mask = np.uint64((1 << (64 - q)) - 1)
        return cls(q, home[ends].astype(np.uint64), ends.astype(np.int64), prints & mask, counts)

    def prints(self) -> np.ndarray:
        """The fingerprints, in order."""
        lengths = np.diff(np.r_[-1, self.run_ends])
        return (np.repeat(self.occupied, lengths) << np.uint64(64 - self.q)) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        return QuotientFilter.build(np.concatenate([self.prints(), other.prints()]), self.q,
                                    np.concatenate([self.counts, other.counts]))

    def dump(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (self.occupied.tobytes(), self.run_ends.tobytes(), self.remainders.tobytes(),
                self.counts.tobytes())

    @classmethod
    def load(cls, q: int, occupied: bytes, ends: bytes, remainders: bytes, counts: bytes):
        return cls(q, np.frombuffer(occupied, np.uint64), np.frombuffer(ends, np.int64),
                   np.frombuffer(remainders, np.uint64), np.frombuffer(counts, np.int64))


def normal(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def repeated_prints(prints: DataFrame, total: int) -> DataFrame:
    """``fp`` of every fingerprint that counts above one among the rows of ``prints`` (fp long)."""
    bits = max(0, int(np.ceil(np.log2(max(1, total) / PER_RANGE))))  # ranges of quotients
    q = max(bits, 16)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def flush():
            filled = QuotientFilter.build(np.concatenate(held), q)
            values, at = filled.prints(), filled.counts
            part = values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)
            edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            rows = [(int(part[a]), *QuotientFilter.build(values[a:b], q, at[a:b]).dump())
                    for a, b in zip(edges[:-1], edges[1:])]
            return pd.DataFrame(rows, columns=["part", "occupied", "ends", "remainders", "counts"])

        for pdf in batches:
            held.append(pdf["fp"].to_numpy(np.int64).view(np.uint64))
            n += len(pdf)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        filters = [QuotientFilter.load(q, *row) for row in
                   pdf[["occupied", "ends", "remainders", "counts"]].itertuples(index=False)]
        while len(filters) > 1:  # pairwise, so that each entry is moved log(filters) times
            filters = [filters[i].merge(filters[i + 1]) if i + 1 < len(filters) else filters[i]
                       for i in range(0, len(filters), 2)]
        many = filters[0].prints()[filters[0].counts > 1]
        return pd.DataFrame({"fp": many.view(np.int64)})

    blocks = prints.mapInPandas(
        build, "part long, occupied binary, ends binary, remainders binary, counts binary")
    return blocks.groupBy("part").applyInPandas(merge, "fp long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same without white space. Of equal texts the row with the
    most code points stays, then the smallest doc_id (null last). Null texts are empty texts; rows
    that repeat a doc_id count each and share its result; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("chars"),
                       normal(F.col("text")).alias("body"))
    prints = rows.select(F.xxhash64("body").alias("fp"))
    many = repeated_prints(prints, docs.count())
    rows = rows.withColumn("fp", F.xxhash64("body"))
    # byte comparison: the texts themselves are the grouping key, combined before the shuffle
    routed = rows.join(many, "fp", "left_semi")
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    same = (routed.groupBy("body").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
            .select(F.sha2("body", 256).alias("sha"), F.col("best.doc_id").alias("keep_id"),
                    "group_size", F.lit(True).alias("grouped")))
    single = rows.select("doc_id", F.sha2("body", 256).alias("text_sha256"))
    out = single.join(same, single.text_sha256 == same.sha, "left")
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
