"""Document fingerprints from closed syncmers.

Of all windows of ``K`` characters those are anchors whose least inner substring of ``S`` characters
stands at the first or the last place. Whether a window is an anchor depends on its characters
alone, so an edit elsewhere moves no anchor. A fingerprint is the ``SIZE`` anchors of least hash with
their places, so anchors that two texts share can be matched in the order of their places.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import mix

K, S, SIZE = 12, 5, 64


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the closed syncmers, in order of place. A text shorter than a window is
    one anchor, an empty one none."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(code) < K:
        h = np.zeros(1, np.uint64)
        for c in code:
            h = mix(h + c + np.uint64(1))
        return h, np.zeros(1, np.int64)
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(code) - S + 1
    inner = code[:n].copy()
    for j in range(1, S):
        inner = inner * base + code[j:j + n]
    inner = mix(inner)
    span = K - S + 1
    m = len(code) - K + 1
    least = inner[:m].copy()
    for j in range(1, span):
        np.minimum(least, inner[j:j + m], out=least)
    place = np.flatnonzero((inner[:m] == least) | (inner[span - 1:span - 1 + m] == least))
    whole = code[place].copy()
    for j in range(1, K):
        whole = whole * base + code[place + j]
    return mix(whole), place


def fingerprint(text: str | None) -> str:
    """Hexadecimal: per kept anchor 8 digits of hash and 8 of place, in order of hash; each hash
    once, at its first place."""
    h, place = anchors(text or "")
    h32 = (h >> np.uint64(32)).astype(np.uint32)
    if len(h32) > 4 * SIZE:  # only the least can be kept; equal hashes need a margin
        bound = np.partition(h32, 4 * SIZE)[4 * SIZE]
        few = h32 <= bound
        if len(np.unique(h32[few])) >= SIZE:
            h32, place = h32[few], place[few]
    keys, first = np.unique(h32, return_index=True)
    pairs = np.empty((min(SIZE, len(keys)), 2), ">u4")
    pairs[:, 0] = keys[:SIZE]
    pairs[:, 1] = place[first[:SIZE]]
    return pairs.tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of the least anchors of both texts together that stand in both and in the same order: the
    longest chain of them, whatever their distances, so that an edit that moves what follows loses
    only the anchors it touches. Two empty fingerprints are alike."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u4").astype(np.int64).reshape(-1, 2) for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x[:, 0], y[:, 0])[:SIZE]
    same, i, j = np.intersect1d(x[:, 0], y[:, 0], assume_unique=True, return_indices=True)
    shared = np.isin(same, union, assume_unique=True)
    places = y[j, 1][shared][np.argsort(x[i, 1][shared])]
    ends: list[int] = []  # least last place of a chain of each length
    for place in places.tolist():
        at = bisect_left(ends, place)
        ends[at:at + 1] = [place]
    return len(ends) / len(union)


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many first ones of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k] if k else text


RESULT = ("doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next doc_id, after the last the first; null ids come last, rows
    that repeat an id are ordered by the hash of their text. Null texts are empty. A single row is its
    own next. An empty table gives no rows.

    Documents are dealt by ranges of doc_id and each range is read in order, one text at a time; the
    first row of a range is also sent to the end of the range before.
    """
    import hashlib

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    count = ranges or 4 * n  # several ranges per partition even out the work
    at = [i / count for i in range(1, count)]
    # limits of the ranges: any limits give the same rows, even ones give even work
    limits = sorted(set(ids.approxQuantile("doc_id", at, 0.2 / count))) if at and not ids.isEmpty() else []
    part = F.lit(0)
    if limits:
        cuts = F.array(*[F.lit(x) for x in limits])
        part = F.when(F.col("doc_id").isNull(), F.lit(len(limits))).otherwise(
            F.size(F.filter(cuts, lambda x: x <= F.col("doc_id"))))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"))
    rows = rows.select(part.cast("int").alias("part"), order.alias("at"), "text")
    heads = sorted(rows.groupBy("part").agg(F.min("at").alias("at")).collect())  # one per range
    if not heads:
        return spark.createDataFrame([], RESULT.format(kind=kind))
    # the first row of each range, to be sent to the range before (after the last: the first)
    firsts = spark.createDataFrame(
        [(heads[i - 1].part, h.part, h["at"].doc_id, h["at"].h) for i, h in enumerate(heads)],
        f"target int, of int, id {kind}, h long")
    last = (rows.join(F.broadcast(firsts), (F.col("part") == F.col("of")) & F.col("at.doc_id").eqNullSafe(F.col("id"))
                      & (F.col("at.h") == F.col("h"))).dropDuplicates(["target"])
            .select(F.col("target").alias("part"), "at", "text"))
    dealt = (rows.select("part", F.lit(0).alias("tail"), "at", "text")
             .union(last.select("part", F.lit(1).alias("tail"), "at", "text"))
             .repartition(n, "part").sortWithinPartitions("part", "tail", "at")
             .select("part", "tail", F.col("at.doc_id").alias("doc_id"), "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        columns = RESULT.split(",")
        names = [c.split()[0] for c in columns]
        for pdf in batches:
            out = []
            for part, tail, doc, text in zip(pdf["part"], pdf["tail"], pdf["doc_id"].astype(object), pdf["text"]):
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    _, old_doc, old, old_print = held
                    new = edited(old, text)
                    new_print = fingerprint(new) if new != old else old_print
                    out.append((old_doc, len(old), hashlib.sha256(new.encode()).hexdigest(), old_print, new_print,
                                likeness(old_print, new_print), likeness(old_print, own)))
                held = None if tail else (part, None if pd.isna(doc) else doc, text, own)
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(run, RESULT.format(kind=kind))
