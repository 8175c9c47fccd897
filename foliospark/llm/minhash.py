"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

Every shingle draws a permutation of the signature's slots and a value for each: its j-th slot gets
j plus a number below one, and a slot keeps the least value of all shingles. The ranks of a shingle
are without repetition, so its values are correlated and the estimate varies less than with
independent hashes. Values of rank j are at least j: a document stops as soon as all its slots hold
values below the next rank, long documents after one or two ranks.

Documents with the same shingle set are one node. Nodes that share a band meet the first node of that
bucket, in one order for all buckets, so that a cloud of copies has few different pairs and its links
are stars. Confirmed links form groups. Nodes of a bucket that are still in different groups meet a few
neighbours in an order that each bucket draws anew, and those left apart by this are compared with each
other. A link between two nodes of one group changes no group, so no component is lost. Pairs are verified only where one bit of each
slot agrees often enough; this loses a pair of similarity 0.8 about as rarely as the bands do. The nodes
compared last are first held against each other by the parity of their shingles in 1024 cells: no more
cells differ than shingles do, so this filter loses nothing. It is sharp up to about 2,000 shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.operators.lineage import cut

from .common import components, mix, slices, whole_row, word_hashes

SLOTS = 128
BANDS = 32   # of four slots: of pairs with a similarity of 0.8, one in 10**7 shares no band
SHINGLE, CONTRACT_SHINGLE = 5, 4
PERCENT = 80
BATCH = 2_000_000
DIFFER = 32        # of 128 slot bits; at a similarity of 0.8 13 differ on average, at 0.2 51
NEIGHBOURS = 3
CELLS = 1024


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and the text of each. Shingles are k
    consecutive words; a text of fewer words has all of them as its one shingle, none has none."""
    words, owner = word_hashes(texts)
    if not len(words):
        return words, owner
    counts = np.bincount(owner, minlength=len(texts))
    out = np.zeros(len(words), np.uint64)
    take = np.minimum(counts[owner], k)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    ok = place + take <= counts[owner]
    for j in range(k):
        part = np.zeros(len(words), np.uint64)
        part[:len(words) - j] = words[j:]
        out = np.where(j < take, mix(out + part), out)
    out, owner = mix(out + take.astype(np.uint64))[ok], owner[ok]
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    first = np.r_[True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])]
    return out[first], owner[first]


def signatures(elements: np.ndarray, owner: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of all documents at once; rows without elements stay infinite."""
    out = np.full(docs * slots, np.inf)
    perms = None
    for j in range(slots):
        if not len(elements):
            break
        draw = mix(elements ^ np.uint64((0x51ED27 + j) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = j + (draw >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
        pick = j + (mix(draw) % np.uint64(slots - j)).astype(np.int64)
        if perms is None:
            slot = pick
        else:
            rows = np.arange(len(elements))
            slot = perms[rows, pick].astype(np.int64)
            perms[rows, pick] = perms[:, j]
        np.minimum.at(out, owner * slots + slot, value)
        worst = out.reshape(docs, slots).max(1)
        open_docs = worst >= j + 1
        stay = open_docs[owner]
        if perms is None:
            perms = np.tile(np.arange(slots, dtype=np.uint8), (int(stay.sum()), 1))
            rows = np.arange(len(perms))
            perms[rows, pick[stay]] = 0  # the first exchange: slot 0 goes where the pick was
        else:
            perms = perms[stay]
        elements, owner = elements[stay], owner[stay]
    return out.reshape(docs, slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    docs, slots = signature.shape
    bits = signature.view(np.uint64).reshape(docs, bands, slots // bands)
    key = np.tile(np.arange(bands, dtype=np.uint64), (docs, 1))
    for r in range(bits.shape[2]):
        key = mix(key + bits[:, :, r])
    return key


def slot_bits(signature: np.ndarray) -> np.ndarray:
    """One bit per slot, as two 64-bit numbers per document."""
    bits = (mix(signature.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64).reshape(len(signature), -1)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, node (hash of the shingle set), n, bands, slot bits s0 and s1."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text", BATCH):
                items, owner = shingle_sets(part["text"].tolist(), k)
                n = np.bincount(owner, minlength=len(part))
                node = _set_hash(items, owner, n)
                signature = signatures(items, owner, len(part))
                keys, bits = band_keys(signature), slot_bits(signature)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "node": node.view(np.int64), "n": n,
                                    "bands": list(keys.view(np.int64)), "s0": bits[:, 0], "s1": bits[:, 1]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        run, f"doc_id {kind}, node long, n long, bands array<long>, s0 long, s1 long")


def _set_hash(items: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(n), np.uint64)
    np.add.at(sums, owner, mix(items))
    return mix(sums + n.astype(np.uint64))


def parities(items: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """One bit per cell, set where an odd number of a document's shingles fall in; as 64-bit numbers."""
    odd = np.zeros(docs * CELLS, np.uint8)
    np.add.at(odd, owner * CELLS + (mix(items) % np.uint64(CELLS)).astype(np.int64), np.uint8(1))
    return np.packbits((odd & 1).reshape(docs, CELLS), axis=1).view(np.int64)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, n, items, cells) of rows with words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text", BATCH):
                items, owner = shingle_sets(part["text"].tolist(), k)
                n = np.bincount(owner, minlength=len(part))
                node = _set_hash(items, owner, n).view(np.int64)
                split = np.split(items.view(np.int64), np.cumsum(n)[:-1])
                yield pd.DataFrame({"node": node, "n": n, "items": split, "cells": list(parities(items, owner, len(part)))})

    return docs.select("text").mapInPandas(run, "node long, n long, items array<long>, cells array<long>").filter("n > 0")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b"))


def _alike(x: dict, y: dict, percent: int) -> Column:
    """Sizes that allow the similarity, and enough equal slot bits."""
    differ = F.bit_count(x["s0"].bitwiseXOR(y["s0"])) + F.bit_count(x["s1"].bitwiseXOR(y["s1"]))
    return (F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent) & (differ <= DIFFER)


def _cells_allow(x: dict, y: dict, percent: int) -> Column:
    """Of sets that are similar enough at most (100 - percent) / (100 + percent) of both sizes differ."""
    differ = sum((F.bit_count(F.get(x["cells"], F.lit(j)).bitwiseXOR(F.get(y["cells"], F.lit(j))))
                  for j in range(1, CELLS // 64)),
                 F.bit_count(F.get(x["cells"], F.lit(0)).bitwiseXOR(F.get(y["cells"], F.lit(0)))))
    return differ * (100 + percent) <= (x["n"] + y["n"]) * (100 - percent)


_NODE = ["node", "n", "s0", "s1"]


def _meet(members: DataFrame, order: Column, neighbours: int, percent: int) -> DataFrame:
    """``members`` with the size of their bucket and ``some``: the nodes that may match among the first
    of the bucket and the neighbours before it. Nodes of one group (``root``, if known) need not meet."""
    grouped = "root" in members.columns
    window = W.partitionBy("bucket").orderBy(order, "node")
    me = F.struct(*_NODE, *(["root"] if grouped else []))
    others = F.array(F.first(me).over(window), *[F.lag(me, j).over(window) for j in range(1, neighbours + 1)])
    met = members.select("*", F.count("*").over(W.partitionBy("bucket")).alias("size"), others.alias("others"))
    names = ("n", "s0", "s1")
    some = F.filter("others", lambda o: (o["node"] != F.col("node")) & _alike(
        {c: F.col(c) for c in names}, {c: o[c] for c in names}, percent)
        & (o["root"] != F.col("root") if grouped else F.lit(True)))
    return met.withColumn("some", F.transform(some, lambda o: o["node"])).drop("others")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select("node", F.explode("some").alias("o")).select(
        F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b")).distinct()


def _split(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members of buckets with nodes of several groups, and their ``root``."""
    known = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = known.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    return known.join(split.select("bucket"), "bucket", "left_semi")


def _rest(split: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of a bucket in different groups that may match, each from its first common
    bucket only: nodes of different groups are together in every bucket they share."""
    known = split.join(reps.select("node", "bands"), "node").join(sets.select("node", "cells"), "node")
    names = ("n", "s0", "s1", "cells")
    x = known.select("bucket", *[F.col(c).alias(f"x_{c}") for c in (*_NODE, "root", "bands", "cells")])
    y = known.select(F.col("bucket").alias("same"), F.struct(*_NODE, "root", "bands", "cells").alias("o"))
    return x.join(y, (F.col("bucket") == F.col("same")) & (F.col("x_node") < F.col("o.node")) & (F.col("x_root") != F.col("o.root"))
                  & _alike({c: F.col(f"x_{c}") for c in names}, {c: F.col(f"o.{c}") for c in names}, percent)
                  & _cells_allow({c: F.col(f"x_{c}") for c in names}, {c: F.col(f"o.{c}") for c in names}, percent)
                  & (F.element_at(F.array_intersect("x_bands", "o.bands"), 1) == F.col("bucket"))).select(
        F.col("x_node").alias("a"), F.col("o.node").alias("b"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups (node, root) with further links."""
    if links.isEmpty():
        return groups
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def near_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, node, n_shingles, component_id.

    Rows link when ``100 * intersection >= percent * union`` of their distinct k-word shingles (A-Z
    lower-cased); component_id is the least doc_id that can be reached. Rows without words (null
    and empty texts) link with nothing. Rows that repeat a doc_id are rows like others; null ids
    come after all other ids. An empty table gives no rows.
    """
    signed = cut(_signed(docs, k))
    reps = cut(signed.filter("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bands", "s0", "s1")]))
    members = reps.select(F.explode("bands").alias("bucket"), "node", "n", "s0", "s1")
    met = _meet(members, F.col("node"), 0, percent).filter("size > 1")
    met = cut(met.select("bucket", *_NODE, "size", "some"))
    pairs = cut(_pairs(met))
    # in buckets of two both have met; larger ones may hold more pairs
    larger = met.filter("size > 2").select("bucket", *_NODE)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(
        larger.select("node")).distinct()
    ids = reps.join(wanted, "node", "left_semi").select(F.col("rep").alias("doc_id"))
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    sets = cut(_sets(texts, k).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    groups = components(cut(_confirm(pairs, sets, percent)))
    split = cut(_split(larger, groups))
    if not split.isEmpty():
        second = cut(_pairs(_meet(split, F.xxhash64("node", "bucket"), NEIGHBOURS, percent)).join(pairs, ["a", "b"], "left_anti"))
        groups = _joined(groups, cut(_confirm(second, sets, percent)))
        rest = _rest(_split(split.drop("root"), groups), reps, sets, percent)
        groups = _joined(groups, cut(_confirm(rest.join(pairs.union(second), ["a", "b"], "left_anti"), sets, percent)))
    least = (reps.join(groups, "node").groupBy("root").agg(F.min("rep").alias("component_id")))
    of_node = reps.join(groups, "node", "left").join(least, "root", "left").select(
        F.col("node").alias("_node"), F.coalesce("component_id", "rep").alias("component_id"))
    out = signed.join(of_node, (F.col("n") > 0) & (F.col("node") == F.col("_node")), "left")
    return out.select("doc_id", "node", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def contract(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row, shingles of four words."""
    return near_groups(docs, CONTRACT_SHINGLE).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The row of least doc_id of each group, columns unchanged; rows without words all stay.

    Of rows that repeat this doc_id the one of least text hash stays.
    """
    groups = near_groups(docs, k, percent)
    keep = (groups.filter("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("best"))
        .select(F.col("best.doc_id").alias("_id"), F.col("best.node").alias("_node")))
    bare = groups.filter("n_shingles = 0").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(whole_row(docs), "doc_id", "text")
    empty = F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\n\x0b\x0c\r", "")) == ""
    stay = rows.filter(~empty).join(keep, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # repeats of a kept id: one row
    first = stay.groupBy("doc_id").agg(F.min_by("_row", F.xxhash64("text")).alias("_row"))
    return first.select("_row.*").unionByName(rows.filter(empty).select("_row.*"))
