"""Filter interaction audit by a stream that retracts.

All files of ``documents`` run through one available-now stream, some files a micro-batch. A row
becomes a mask of the filters A to D that it fails, which depends on its text alone. Filter E, "the
text of a smaller id", depends on all other rows: a state keyed by text holds the smallest id seen
so far and how many rows of each part stand at it. When a smaller id arrives, the rows held so far
fail E after all: their earlier masks are retracted (a negative count) and counted again with E.
The sink gets signed counts a part and mask; their sums are the part counters, and every order of
the filters is read off these 32 counters a part, without going back to the rows.

Text states live in cells (a cell is a share of the text hashes that gets about ``PER_CELL`` texts a
micro-batch), so that one call of the state function serves many texts. Before the exchange each Arrow batch is
combined: of equal texts only those at the batch's smallest id go to the state, all others fail E
for certain and are sent as counts, so a text that holds a third of all rows stays small.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.operators.lineage import checkpoint_dir

from .common import BLANK, BLANKS

FILTERS = "ABCDE"
E = 16
PER_CELL = 256
#: A table goes through the stream in about this many micro-batches, of at least so many bytes of files each.
BATCHES = 4
BATCH_BYTES = 1 << 26
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROW = "cell long, print string, has_id boolean, id long, part string, mask int, good int, toxic int, n long"
_DELTA = "part string, mask int, good int, toxic int, n long"
_STATE = "print array<string>, id array<long>, part array<string>, mask array<int>, good array<int>, toxic array<int>, n array<long>"
_HELD = ["print", "id", "part", "mask", "good", "toxic", "n"]
_COUNTED = ["part", "mask", "good", "toxic"]


def row_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, print (of the text) and mask: bit 0 to 3 for failing A to D. Null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("w", F.when(F.btrim("t", F.lit(BLANKS)) == "", F.array().cast("array<string>"))
                           .otherwise(F.split(F.btrim("t", F.lit(BLANKS)), BLANK)))
    bits = (F.size("w") < 50,
            100 * F.size(F.array_distinct("w")) < 65 * F.size("w"),
            100 * F.regexp_count("t", F.lit("[A-Z]")) > 5 * F.length("t"),
            F.col("t").rlike(r"[#$%&*|]"))
    mask = sum((b.cast("int") * (1 << k) for k, b in enumerate(bits)), F.lit(0))
    return rows.select("doc_id", "part", F.sha2("t", 256).alias("print"), mask.cast("int").alias("mask"))


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows at the smallest id of their text in the batch stay; all later ones become plain counts."""
    for pdf in batches:
        if not len(pdf):
            continue
        low = pdf["id"].where(pdf["has_id"]).groupby(pdf["print"]).transform("min")
        later = pdf["has_id"] & (pdf["id"] > low)
        sure = pdf[later].assign(mask=pdf["mask"] | E, print="", has_id=False, id=0)
        # a settled count needs no state and may go to any cell: the first of its batch and mask
        sure["cell"] = sure.groupby(_COUNTED)["cell"].transform("first")
        both = pd.concat([pdf[~later], sure])
        yield both.groupby(["cell", "print", "has_id", "id", *_COUNTED], as_index=False, sort=False)["n"].sum()[
            ["cell", "print", "has_id", "id", *_COUNTED, "n"]]


def _retract(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Signed counts that bring the counters up to date; the state keeps the rows at the smallest ids."""
    fresh = pd.concat(list(batches), ignore_index=True)
    plain, fresh = fresh[~fresh["has_id"]], fresh[fresh["has_id"]]
    held = pd.DataFrame(dict(zip(_HELD, state.get)) if state.exists else {c: [] for c in _HELD})
    held = held.astype({c: "int64" for c in ("id", "mask", "good", "toxic", "n")})
    both = pd.concat([held.assign(old=True), fresh[_HELD].assign(old=False)], ignore_index=True)
    both["old"] = both["old"].astype(bool)
    fails = both["id"] > both.groupby("print")["id"].transform("min")
    late = both[fails & both["old"]]
    changes = pd.concat([
        plain[[*_COUNTED, "n"]], both[~both["old"] & ~fails][[*_COUNTED, "n"]],
        both[fails].assign(mask=both["mask"] | E)[[*_COUNTED, "n"]], late.assign(n=-late["n"])[[*_COUNTED, "n"]]])
    stay = both[~fails].groupby(_HELD[:-1], as_index=False, sort=False)["n"].sum()
    if len(stay):
        state.update(tuple(stay[c].tolist() for c in _HELD))
    out = changes.groupby(_COUNTED, as_index=False, sort=False)["n"].sum()
    yield out[out["n"] != 0].astype({"mask": "int32", "good": "int32", "toxic": "int32", "n": "int64"})


def signed_counts(docs: DataFrame, labels: DataFrame, cells: int) -> DataFrame:
    """The stream of signed counts (part, mask, good, toxic, n) of a stream ``docs``.

    ``labels`` may repeat a doc_id: a document is good (toxic) if any of its rows says 1.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    masks = row_masks(docs)
    rows = masks.join(marks, masks["doc_id"] == marks["_of"], "left").select(
        F.pmod(F.xxhash64("print"), F.lit(cells)).alias("cell"), "print", F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "part", "mask",
        F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"),
        F.lit(1).cast("long").alias("n"))
    return rows.mapInPandas(_combined, _ROW).groupBy("cell").applyInPandasWithState(
        _retract, _DELTA, _STATE, "append", GroupStateTimeout.NoTimeout)


def part_counters(spark: SparkSession, path: str, labels: DataFrame, batch_bytes: int | None = None,
                  files_per_batch: int | None = None) -> DataFrame:
    """part, mask, good, toxic, n: how many rows of the documents below ``path`` fail exactly ``mask``.

    One available-now stream reads every file, ``batch_bytes`` (or ``files_per_batch`` files) at a
    time, by default a share of the table, so that later batches retract what earlier ones counted. Its
    checkpoint and its sink lie in the session's checkpoint folder, so an executor that is lost costs a
    retried task and a restart goes on behind the last whole batch.
    """
    table = spark.read.parquet(path)
    files, total = spark.read.format("binaryFile").load(path).agg(F.count("*"), F.sum("length")).first()
    reader = spark.readStream.schema(table.schema)
    if files_per_batch:
        reader, batches = reader.option("maxFilesPerTrigger", files_per_batch), -(-files // files_per_batch)
    else:
        batch_bytes = batch_bytes or max(BATCH_BYTES, -(-(total or 0) // BATCHES))
        reader, batches = reader.option("maxBytesPerTrigger", batch_bytes), min(files, -(-(total or 0) // batch_bytes))
    cells = max(1, table.count() // (PER_CELL * max(1, batches)))
    # a stream takes a folder or a pattern, but no single file: the pattern matches ``path`` alone
    pattern = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    folder = f"{checkpoint_dir(table)}/{uuid.uuid4().hex}"
    # states beyond memory, in many small stores that set no disk aside; a query keeps the settings it starts with
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        query = (signed_counts(reader.parquet(pattern), labels, cells).writeStream.format("parquet")
                 .option("path", f"{folder}/counts").option("checkpointLocation", f"{folder}/state")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    counts = spark.read.schema(_DELTA).parquet(f"{folder}/counts")
    return counts.groupBy(*_COUNTED).agg(F.sum("n").alias("n")).filter("n <> 0")


def interactions(counters: DataFrame) -> DataFrame:
    """All orders of the filters over the counters: one row per part, order and step."""
    steps = [(order, k + 1, sum(1 << FILTERS.index(f) for f in order[:k]), 1 << FILTERS.index(order[k]))
             for order in map("".join, permutations(FILTERS)) for k in range(len(order))]
    table = F.from_json(F.lit(json.dumps([dict(zip(("filter_order", "step", "before", "bit"), s)) for s in steps])),
                        "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    counts = [F.struct(F.lit(m).alias("mask"), *[
        F.coalesce(F.sum(F.when((F.col("mask") == m) & extra, F.col("n"))), F.lit(0)).alias(name)
        for name, extra in (("n", F.lit(True)), ("good", F.col("good") == 1), ("toxic", F.col("toxic") == 1))])
        for m in range(1 << len(FILTERS))]
    by_part = counters.groupBy("part").agg(F.array(*counts).alias("c"))
    rows = by_part.select("part", "c", F.explode(table).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")

    def total(chosen, value):
        return F.aggregate("c", F.lit(0).cast("long"), lambda acc, x: acc + F.when(chosen(x["mask"]), value(x)).otherwise(F.lit(0)))

    def here(m):
        return (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) == 0)

    # of the orders, those in which a filter comes first among the ones a mask fails: 120 / failing filters
    share = F.array(*[F.lit(120 // max(1, m.bit_count())) for m in range(32)])
    return rows.select(
        "part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"),
        total(lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0, lambda x: x["n"]).alias("kept"),
        total(here, lambda x: x["n"]).alias("removed"),
        total(lambda m: (m.bitwiseAND(bit) != 0) & (m.bitwiseAND(before) != 0), lambda x: x["n"]).alias("redundant"),
        total(lambda m: m == bit, lambda x: x["n"]).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"), total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(lambda m: m.bitwiseAND(bit) != 0, lambda x: x["n"] * F.get(share, x["mask"])).alias("shapley"))


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, **batches) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null texts are empty, null sources the part "" (as are empty ones). Rows with a null doc_id
    fail no E and make none fail; rows that repeat doc_id and text count each and do not fail E for
    one another. Ids without a label are neither good nor toxic. An empty table gives no rows.
    """
    return interactions(part_counters(spark, path, labels, **batches))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
l AS (SELECT doc_id AS of, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.of),
x AS (SELECT v AS f FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) z(v)),
o AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order
  FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
m AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic,
         (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed
  FROM f GROUP BY 1, 2, 3, 4, 5, 6),
g AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS now, n, good, toxic, failed,
         contains(failed, substr(filter_order, step, 1)) AS fails,
         len(list_filter(range(1, step), lambda k: contains(failed, substr(filter_order, CAST(k AS BIGINT), 1)))) > 0 AS gone
  FROM m, o, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
r AS (
  SELECT part, filter_order, step, now,
         CAST(sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failed = now THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM g GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, now) AS BIGINT) AS shapley
FROM r
"""
