"""Line de-duplication as an exact set-similarity join, in DataFrame operations only.

A line is the set of its distinct lower-cased words; lines without a word are left alone. Each word
becomes a key whose first byte is a rarity class, so that the order of keys is an order by rarity. Lines
with the same set are one set, at its first place. Of two sets with a Jaccard similarity of t or more the
larger holds a common word in its first ``n - ceil(t n) + 1`` keys that is among the first
``n - ceil(2t / (1 + t) n) + 1`` keys of the smaller (prefix filter), so sets meet under single words and
the rows are linear in the prefixes. Sets that meet are held against each other by length, by place (words
before and after the common one bound the overlap) and by a parity bitmap (as many bits differ as words
differ, at most); what is left is verified on the full sets. A line goes if an earlier line (by doc_id,
then line number) is similar.

Large groups: sets first meet the first set with the same least and greatest word hash (one aggregation).
Under a word of many lines (its rarity class says so before any row is shuffled) they also meet a near
predecessor of about their length (one window), and once a set is known to go, no earlier one need meet
it there: what is left grows with the sets that stay and not with the pairs of a group. Such a word is
split into blocks: the smaller sets are dealt to them, the larger ones visit each.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.operators.lineage import checkpoint_dir, cut

from .common import whole_row

PERCENT = 80
#: Lines of a word in one block of a meeting place.
BLOCK = 1 << 15
#: Words that occur more often are common: their sets meet predecessors first.
COMMON = 1 << 10
#: Predecessors that a set looks back at under a common word.
BACK = 4
SKETCH = 1 << 17
#: Sets of more words have bitmaps of 128 cells.
LONG = 48


def _plain(text: Column) -> Column:
    """Lower-cased, every blank but the line feed a space."""
    plain = F.lower(text)
    for blank in "\t\x0b\x0c\r":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    return plain


def _bucket(word: Column) -> Column:
    return F.pmod(word, F.lit(SKETCH))


def rarity_classes(docs: DataFrame) -> bytes:
    """A class per bucket of words from the number of times that words of the bucket occur, in steps of
    a quarter of a power of two: ``SKETCH`` bytes, whatever the number of words."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).cast("int").alias("b")).count()
    table = np.zeros(SKETCH, np.int64)
    got = counts.toPandas()
    table[got["b"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    return np.minimum(100, np.floor(4 * np.log2(np.maximum(1, table)))).astype(np.uint8).tobytes()


def keyed_lines(docs: DataFrame, classes: bytes) -> DataFrame:
    """doc_id, th (hash of the text), line_no from 0, keys (sorted by rarity), n, id (hash of the set),
    near (of its least and greatest word hash). Null texts have no lines; lines without words are left out."""
    table = F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # folded to one literal
    rank = lambda h: F.get(table, _bucket(h).cast("int"))
    # never null, so that arrays of keys are sorted as plain numbers
    key = lambda h: F.coalesce(F.shiftleft(rank(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8)), F.lit(0))
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    words = F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"),
                        F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line_no", "line"))
    lines = lines.filter(F.trim("line") != "")  # a filter on n would take every line's words twice
    return (lines.select("doc_id", "th", "line_no", words.alias("words"))
            .select("doc_id", "th", "line_no", F.sort_array(F.transform("words", key)).alias("keys"),
                    F.xxhash64(F.array_min("words"), F.array_max("words")).alias("near"))
            .select("*", F.size("keys").alias("n"), F.xxhash64("keys").alias("id")))


def _store(df: DataFrame) -> DataFrame:
    """A table in the checkpoint folder; words repeat, so large dictionaries pay."""
    path = f"{checkpoint_dir(df)}/{uuid.uuid4().hex}"
    df.write.option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _need(total: Column, percent: int) -> Column:
    """The least number of common words of two similar sets of ``total`` words together."""
    return F.ceil(total * F.lit(percent) / F.lit(100 + percent))


def _parity(keys: Column) -> Column:
    """A bitmap of 64 cells: which of them hold an odd number of the keys."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(
        F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(63).cast("int"))))


def _alike(a: str, b: str, percent: int) -> Column:
    """Length and bitmap filters; neither drops a pair that reaches the similarity.

    ``sig`` has 64 cells; for sets of more than ``LONG`` words ``high`` tells the keys of one more bit
    apart, which makes 128 cells (``sig`` is the exclusive or of both halves).
    """
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    sig = F.col(f"{a}sig").bitwiseXOR(F.col(f"{b}sig"))
    high = F.col(f"{a}high").bitwiseXOR(F.col(f"{b}high"))
    differ = F.when(F.least(n, m) > LONG, F.bit_count(high) + F.bit_count(sig.bitwiseXOR(high))).otherwise(F.bit_count(sig))
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & (differ <= n + m - 2 * _need(n + m, percent)))


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def _met(small: DataFrame, large: DataFrame, percent: int, on: list[str], open_: Column) -> DataFrame:
    """a_id, b_id of sets that meet in places (key, id, sig, high, n, pos), pass the filters and are ``open_``."""
    n, m, i, j = F.col("a_n"), F.col("b_n"), F.col("a_pos"), F.col("b_pos")
    least = F.least(n, m)  # n itself; written with both sides so that both read one exchange
    within = i < least - _need(2 * least, percent) + 1
    smaller = (n < m) | ((n == m) & (F.col("a_id") < F.col("b_id")))
    place = F.least(i, j) + F.least(n - i, m - j) >= _need(n + m, percent)
    keys = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on]
    return (small.join(large, [*keys, smaller, within, place, _alike("a_", "b_", percent), open_])
            .select("a_id", "b_id"))


def _often(key: Column) -> Column:
    """At most so many times the words of a key's bucket occur: a class is a quarter power of two."""
    return F.pow(F.lit(2.0), (F.shiftright(key, 24) + 1) / 4)


def _common(key: Column, block: int) -> Column:
    return _often(key) > min(COMMON, block)


def _places(sets: DataFrame, *more: Column) -> DataFrame:
    return sets.select("id", "sig", "high", "n", *more, F.posexplode("prefix").alias("pos", "key"))


def common_places(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, blocks, at (of the set), id, sig, high, n, pos of the sets' common words."""
    some = sets.filter(F.exists("prefix", lambda k: _common(k, block)))
    return _places(some, F.struct("doc_id", "line_no", "th").alias("at")).filter(_common(F.col("key"), block)).withColumn(
        "blocks", F.ceil(_often(F.col("key")) / block).cast("int"))


def predecessors(places: DataFrame, percent: int) -> DataFrame:
    """a_id, b_id: for each common place the nearest of the ``BACK`` places before it that passes the filters.

    Places are in the order of the table, in parts of a block and of sets of about one length."""
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)))
    mine = F.struct("id", "n", "sig", "high")
    order = W.partitionBy("key", "salt", "band").orderBy("at", "id")
    rows = (places.withColumn("salt", F.pmod("id", "blocks")).withColumn("band", band)
            .select(*[F.col(c).alias(f"a_{c}") for c in ("id", "n", "sig", "high")],
                    *[F.lag(mine, k).over(order).alias(f"b{k}") for k in range(1, BACK + 1)]))
    before = F.coalesce(*[F.when(_alike("a_", f"b{k}.", percent), F.col(f"b{k}.id")) for k in range(1, BACK + 1)])
    return rows.select("a_id", before.alias("b_id")).filter("b_id IS NOT NULL").distinct()


def candidates(reps: tuple[DataFrame, DataFrame], percent: int, block: int = BLOCK) -> DataFrame:
    """a_id, b_id of two tables, the sets (id, n, sig, high, prefix, doc_id, line_no, th) and those known to
    go (id): the pairs that pass all filters, but for pairs under common words whose later set goes."""
    sets, gone = reps
    few = _places(sets).filter(~_common(F.col("key"), block))
    places = common_places(sets, block).join(gone.withColumn("gone", F.lit(True)), "id", "left").withColumn(
        "gone", F.coalesce("gone", F.lit(False)))
    dealt = places.withColumn("salt", F.pmod("id", "blocks").cast("int")).drop("blocks")
    visits = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    stays = ~F.when(F.col("a_at") > F.col("b_at"), F.col("a_gone")).otherwise(F.col("b_gone"))
    return _met(_prefixed(few, "a_"), _prefixed(few, "b_"), percent, ["key"], F.lit(True)).union(
        _met(_prefixed(dealt, "a_"), _prefixed(visits, "b_"), percent, ["key", "salt"], stays)).distinct()


def _full_sets(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """id, at, keys of the sets in the pairs (a_id, b_id), and no others; ``at`` is their first place.

    Spark puts a bloom filter of the pairs in front of the exchange of the sets: its own run-time
    filter, here for tables of any size. (A comparison is needed for Spark to see a selective side.)
    """
    ends = pairs.select(F.col("a_id").alias("id")).union(pairs.select("b_id")).distinct()
    ends = cut(ends.withColumn("use", F.lit(1))).filter("use > 0")
    conf = table.sparkSession.conf
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = conf.get(name)
    conf.set(name, "1")
    try:
        found = table.select("id", "doc_id", "line_no", "th", "keys").join(ends, "id", "left_semi")
        first = F.min(F.struct(F.struct("doc_id", "line_no", "th").alias("at"), "keys")).alias("f")
        return cut(found.groupBy("id").agg(first).select("id", "f.*"))
    finally:
        conf.set(name, before)


def _later(pairs: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """id of the later set of each pair (a_id, b_id) that is similar on the full sets."""
    sets = _full_sets(pairs, table)
    both = F.size(F.array_intersect("a_keys", "b_keys"))
    union = F.size("a_keys") + F.size("b_keys") - both
    return (pairs.join(_prefixed(sets, "a_"), "a_id").join(_prefixed(sets, "b_"), "b_id")
            .filter(100 * both >= percent * union)
            .select(F.when(F.col("a_at") > F.col("b_at"), F.col("a_id")).otherwise(F.col("b_id")).alias("id")).distinct())


def removed_lines(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, th, line_no of the lines that go.

    Lines with the same set are one set at its first place; the others go with it as repeats. A null
    doc_id stands before all others, as in the order of the rows.
    """
    table = _store(keyed_lines(docs, rarity_classes(docs)))
    n = F.col("n")
    # sets of fewer words are similar to equal ones only
    some = n * (100 - percent) >= percent
    # in sets' order of words, half of each key: words that share it only meet in vain
    prefix = F.when(some, F.transform(F.slice("keys", 1, (n - F.ceil(n * percent / 100) + 1).cast("int")),
                                      lambda k: F.shiftright(k, 32).cast("int")))
    high = F.when(n > LONG, _parity(F.filter("keys", lambda k: k.bitwiseAND(64) > 0))).otherwise(0)
    first = F.struct("doc_id", "line_no", "th", "near", "n", F.when(some, _parity(F.col("keys"))).otherwise(0).alias("sig"),
                     high.alias("high"), prefix.alias("prefix"))
    reps = _store(table.groupBy("id").agg(F.min(first).alias("f"), F.count("*").alias("c")).select("id", "f.*", "c"))
    sets = reps.filter("prefix IS NOT NULL")
    mine = ["id", "n", "sig", "high"]
    heads = sets.groupBy("near").agg(F.min(F.struct("doc_id", "line_no", "th", *mine)).alias("h"), F.count("*").alias("c"))
    heads = _prefixed(heads.filter("c > 1").select("near", *[F.col(f"h.{c}").alias(c) for c in mine]), "h_")
    early = _prefixed(sets.select("near", *mine), "x_").join(
        heads, (F.col("x_near") == F.col("h_near")) & (F.col("x_id") != F.col("h_id")) & _alike("x_", "h_", percent)).select(
        F.col("x_id").alias("a_id"), F.col("h_id").alias("b_id"))
    early = cut(early.union(predecessors(common_places(sets, block), percent)))
    gone = cut(_later(early, table, percent))
    rest = cut(candidates((sets, gone), percent, block))
    gone = cut(gone.union(_later(rest, table, percent)).distinct()).withColumn("gone", F.lit(True))
    # what is left to do is told by the sets with repeats and the sets that go
    told = reps.select("id", "c", F.struct("doc_id", "line_no", "th").alias("first")).join(gone, "id", "left")
    told = told.filter((F.col("c") > 1) | F.col("gone")).select("id", "first", "gone")
    return (table.select("doc_id", "th", "line_no", "id").join(told, "id")
            .filter((F.col("first") != F.struct("doc_id", "line_no", "th")) | F.col("gone")).select("doc_id", "th", "line_no"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_lines (numbers from 0, comma-joined) of every row.

    Null texts have no lines, empty texts one. Rows that repeat both doc_id and text are one document
    and share its result. An empty table gives no rows.
    """
    gone = removed_lines(docs).groupBy("doc_id", "th").agg(
        F.array_join(F.array_sort(F.collect_set("line_no")), ",").alias("removed_lines"),
        F.count_distinct("line_no").alias("n_removed")).withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"),
                       F.when(F.col("text").isNotNull(), F.regexp_count("text", F.lit("\n")) + 1).otherwise(0).cast("long").alias("n_lines"))
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed_lines", F.lit("")).alias("removed_lines"))


def without_repeated_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the lines taken out of their texts; a text of which no line is left goes, other
    rows stay, texts without any line too. Columns unchanged."""
    gone = removed_lines(docs).groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("_gone")).withColumnsRenamed(
        {"doc_id": "_id", "th": "_th"})
    rows = docs.select(whole_row(docs), "doc_id", F.col("text").alias("_text"), F.xxhash64("text").alias("th"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    left = F.filter(F.split("_text", "\n"), lambda line, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    kept = joined.filter(F.col("_gone").isNull() | (F.size(left) > 0))
    length = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": F.when(F.col("_gone").isNull(), F.col("_row.n_chars")).otherwise(length) if length is not None else None}
    return kept.select(*[new[c].alias(c) if c in new and new[c] is not None else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, line_no,
         list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\x0b\f\r]+'), lambda w: w <> ''))) AS ws
  FROM l),
k AS (SELECT * FROM s WHERE len(ws) > 0),
r AS (
  SELECT ws, min((doc_id, line_no)) AS who, len(ws) AS n FROM k GROUP BY ws),
f AS (SELECT w, count(*) AS df FROM (SELECT unnest(ws) AS w FROM r) GROUP BY w),
o AS (
  SELECT who, n, w, row_number() OVER (PARTITION BY who ORDER BY df, w) AS pos
  FROM (SELECT who, n, unnest(ws) AS w FROM r) JOIN f USING (w)),
p AS (SELECT * FROM o WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (
  SELECT DISTINCT x.who AS x, y.who AS y FROM p x JOIN p y ON x.w = y.w AND y.who < x.who
   AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
v AS (
  SELECT DISTINCT x FROM (
    SELECT c.x, len(list_intersect(a.ws, b.ws)) AS i, a.n + b.n AS total
    FROM c JOIN r a ON c.x = a.who JOIN r b ON c.y = b.who) WHERE 100 * i >= 80 * (total - i)),
g AS (
  SELECT k.doc_id, k.line_no FROM k JOIN r USING (ws)
  WHERE (k.doc_id, k.line_no) <> r.who OR r.who IN (SELECT x FROM v)),
a AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(line_no, ',' ORDER BY line_no) AS removed_lines FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + 1 END AS n_lines,
       coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
