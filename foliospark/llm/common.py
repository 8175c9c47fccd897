"""Shared pieces of the operators: reading, hashing, bounded batches, connected components."""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.operators.lineage import cut

#: What parts words: space and the controls 09 to 0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, so that every engine agrees."""
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of a table can clash with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def remainder(doc_id: Column, base: int) -> Column:
    """crc32 of the id as text, modulo ``base``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % base


def crc_mod(doc_id, base: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % base


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    """The same finaliser for one Python number, cut to 64 bits."""
    m = 0xFFFFFFFFFFFFFFFF
    x = (x + 0x9E3779B97F4A7C15) & m
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


#: Odd base and its inverse modulo 2**64, for hashes of byte spans.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_KEYS = mix(np.arange(256, dtype=np.uint64))
_BLANK_BYTE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER_BYTE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    out = []
    for base in (_BASE, _INVERSE):
        power = np.full(n, base, np.uint64)
        power[0] = 1
        out.append(np.multiply.accumulate(power))
    return out[0], out[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of some texts, and the text each belongs to.

    All words are hashed at once: the hash of a span is a difference of running sums of keyed bytes
    times powers of an odd base, shifted back to the span's start. A hash depends on its word only.
    """
    raw = [(t or "").encode().translate(_LOWER_BYTE) for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = _BLANK_BYTE[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    starts, ends = edge[0::2], edge[1::2]
    n = len(data)
    power, back = _powers(1 << n.bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.searchsorted(limits, starts, side="right")


def slices(pdf: pd.DataFrame, text: str, limit: int = 8_000_000) -> Iterator[pd.DataFrame]:
    """Rows in order, in slices of about ``limit`` characters, one long text being a slice alone."""
    if not len(pdf):
        return
    size = pdf[text].map(lambda t: len(t) if t else 0).to_numpy()
    for _, part in pdf.groupby(np.cumsum(size) // limit, sort=False):
        yield part


def components(edges: DataFrame) -> DataFrame:
    """Union-find over (a, b), a null never: (node, root) for every node, root the smallest node.

    First each partition joins its edges in a local union-find forest and sends on one edge from each
    node to the root of its tree, so that stars of a hot root are merged before they are shuffled. Then
    rounds of large and small stars: every edge moves to the least root of its root, and all roots of a
    node to its least root, so that chains shorten by half instead of by one.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            top = x
            while (p := parent.get(top, top)) != top:
                top = p
            while (p := parent.get(x, x)) != top:
                parent[x] = top
                x = p
            return top

        def flush():
            nodes = list(parent)
            return pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]})

        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                a, b = find(a), find(b)
                lo, hi = (a, b) if a < b else (b, a)
                parent[lo] = lo
                parent[hi] = lo
            if len(parent) > 2_000_000:  # bounded memory: the rest goes on as another forest
                yield flush()
                parent.clear()
        if parent:
            yield flush()

    stars = cut(edges.select("a", "b").mapInPandas(forest, f"a {kind}, b {kind}"))
    while True:
        low = cut(stars.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")))
        up = low.select(F.col("a").alias("b"), F.col("lo").alias("top"))
        step = cut(stars.join(up, "b", "left").select("a", "b", F.coalesce("top", "b").alias("top")).distinct())
        if low.filter("lo <> hi").isEmpty() and step.filter("b <> top").isEmpty():
            return step.select(F.col("a").alias("node"), F.col("top").alias("root"))
        # each edge goes on to the least root of its root; then the roots of a node are tied to the least one
        stars = step.select("a", F.col("top").alias("b"))
        small = stars.groupBy("a").agg(F.min("b").alias("lo"))
        ties = stars.join(small, "a").select(F.col("b").alias("a"), F.col("lo").alias("b"))
        stars = cut(ties.union(small.select("a", F.col("lo").alias("b"))).distinct())


def empty_like(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)
