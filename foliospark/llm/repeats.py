"""Repeated byte strings by suffix arrays: every byte under a string of ``SPAN`` bytes that also
starts anywhere else goes.

A suffix array over all text orders every suffix, though only few can have an equal ``SPAN`` bytes
long. So texts are first cut into blocks: a start of a ``SPAN``-byte string belongs to the anchor of
that string, the place of the smallest hash of ``GRAM`` bytes in it, and a block is a run of starts with one
anchor together with the bytes of their strings. Equal strings have equal anchors at equal
distances, so only blocks whose anchor bytes stand in a second block can hold repeats:

* If all blocks with these anchor bytes are equal, all their strings repeat, and nothing has to be sorted.
* Otherwise one copy of each different block goes to a shard together with all others of its anchor
  bytes. A shard builds a suffix array by Larsson-Sadakane refinement (doubling the compared
  length, sorting only groups that are not single yet) and the common prefixes by Kasai's
  inequality, and the runs of common prefixes of ``SPAN`` bytes and more are the repeated strings.
* Anchor bytes with more than ``LIMIT`` different blocks are dealt to several shards. Each cuts its sorted list
  of string prints at the borders of ranges, and a range merges the lists of all shards by binary
  search; a print found in two lists goes back to its shards.

Blocks are told apart by two 64-bit prints, of the anchor and of the whole block. Whole texts move
twice, to give out blocks and to take the marks; all else is prints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.operators.lineage import cut

from .common import _BASE, _BYTE_KEYS, _INVERSE, mix

SPAN = 200
GRAM = 48
#: Different blocks of one anchor that a single shard takes.
LIMIT = 4_096
#: Bytes of text that meet their marks in one group, and that are hashed at once.
SHARD = 4_000_000
BUFFER = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_POWERS = []
for _b in (_BASE, _INVERSE):
    _p = np.full(BUFFER + 2 * SPAN, _b, np.uint64)
    _p[0] = 1
    _POWERS.append(np.multiply.accumulate(_p))


class _Sums:
    """Hashes of any span of a buffer from running sums of keyed bytes times powers of an odd base."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_KEYS[data] * _POWERS[0][:len(data)], out=self.sums[1:])

    def prints(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _POWERS[1][start] + (end - start).astype(np.uint64))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, ends of the texts inside) of buffers that hold every start of a string once.

    A buffer holds whole texts. A longer text is cut at places counted from its own start, so that a text has the
    same blocks among whatever texts it is read.
    """
    k = 0
    while k < len(offsets) - 1:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BUFFER, "right")) - 1)
        at, last = int(offsets[k]), int(offsets[stop])
        while last - at >= SPAN:
            end = min(last, at + BUFFER + SPAN - 1)
            yield at, end, offsets[k + 1:stop + 1]
            at = end - SPAN + 1
        k = stop


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of the texts data[offsets[i]:offsets[i + 1]]: first and last start, anchor and block print.

    Texts shorter than ``SPAN`` have none. In a text longer than a buffer, a run of starts may be cut in two blocks.
    """
    out = [[np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2]
    for at, end, ends in _pieces(offsets):
        here = data[at:end]
        sums = _Sums(here)
        n = len(here) - GRAM + 1
        place = np.arange(n)
        grams = sums.prints(place, place + GRAM)
        key = (grams & ~_PLACE) | place.astype(np.uint64)
        anchor = (_window_min(key, SPAN - GRAM + 1) & _PLACE).astype(np.int64)
        start = np.arange(len(anchor))
        # the text that holds a byte, as the number of text ends at or before it
        text = np.searchsorted(ends - at, start, "right")
        inside = text == np.searchsorted(ends - at, start + SPAN - 1, "right")
        start, anchor, text = start[inside], anchor[inside], text[inside]
        if not len(start):
            continue
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        first, stop = start[new], start[np.r_[new[1:], len(start)] - 1]
        out.append([first + at, stop + at, grams[anchor[new]], sums.prints(first, stop + SPAN)])
    return tuple(np.concatenate(c) for c in zip(*out))


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes (Larsson and Sadakane); an end comes before all bytes.

    A suffix's rank is the place of its group; only groups of several suffixes are sorted again, by the
    rank of the suffix ``h`` bytes on, and ``h`` doubles.
    """
    n = len(data)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits for a byte plus one, so that an end is below every byte
        key <<= np.uint64(9)
        key[:max(n - k, 0)] |= data[k:].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)  # 0 for the end, else the place of the group plus one
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    h = 7
    while len(loose := np.flatnonzero(~(new & np.r_[new[1:], True]))):
        at = order[loose]
        group, follow = rank[at], rank[np.minimum(at + h, n)]
        # groups stand in order, so sorting by both ranks moves suffixes inside their groups only
        sub = np.argsort(group * np.int64(n + 1) + follow, kind="stable")
        at, group, follow = at[sub], group[sub], follow[sub]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        order[loose], new[loose] = at, fresh
        rank[at] = loose[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] + 1
        h *= 2
    return order


def _words_at(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, zero behind the end."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes shared by each suffix of the order with the one before it, counted up to ``most``.

    Kasai: the suffix one byte on shares at least one byte less with its own neighbour, so the value of
    a place is where the count at a later place may start. Places are filled in strides that halve,
    all places of a stride at once, eight bytes a step.
    """
    n = len(data)
    words = _words_at(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    for stride in (64, 32, 16, 8, 4, 2, 1):
        todo = np.arange(0, n, 64) if stride == 64 else np.arange(stride, n, 2 * stride)
        left = np.maximum(todo - stride, 0)  # filled before, and a stride away
        known = np.maximum(shared[left] - stride, 0)
        at, other, length = todo, before[todo], known
        live = np.flatnonzero(other >= 0)
        while len(live):
            a, b = at[live] + length[live], other[live] + length[live]
            room = np.minimum(n - np.maximum(a, b), most - length[live])
            differ = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
            step = np.minimum(same, np.maximum(room, 0))
            length[live] += step
            live = live[(step == 8) & (room > 8)]
        shared[todo] = length
    return shared[order]


def repeated_starts(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which valid starts share SPAN bytes with another valid start, and one valid start of each class."""
    order = suffix_array(data)
    shared = common_prefixes(data, order, SPAN)
    run = np.cumsum(shared < SPAN) - 1
    ok = valid[order]
    many = np.bincount(run[ok], minlength=run[-1] + 1 if len(run) else 0) > 1
    marked = np.zeros(len(data), bool)
    marked[order[ok & many[run]]] = True
    _, one = np.unique(run[ok], return_index=True)
    return marked, order[ok][one]


def _shard_texts(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block texts end to end, the place of each, and the starts whose strings lie in their block."""
    size = np.array([len(p) for p in pieces], np.int64)
    at = np.r_[0, np.cumsum(size)[:-1]]
    valid = np.ones(int(size.sum()), bool)
    for k in range(1, SPAN):  # the last SPAN - 1 places of a block are no starts
        valid[at + size - k] = False
    return np.frombuffer(b"".join(pieces), np.uint8), at, valid


def _groups(table: pa.Table) -> Iterator[pa.Table]:
    """Rows by anchor, in slices of whole anchors of about ``LIMIT`` blocks, so a slice is small."""
    table = table.sort_by([("anchor", "ascending"), ("print", "ascending")])
    anchor = table["anchor"].to_numpy()
    edges = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if len(anchor) else np.zeros(0, int)
    start = 0
    for e in [*edges[1:], len(anchor)]:
        if e - start >= LIMIT or e == len(anchor):
            if e > start:
                yield table.slice(start, e - start)
            start = e


def _marks(rows: pa.Table, bits: list[bytes]) -> pa.Table:
    return pa.table({"home": rows["home"], "anchor": rows["anchor"], "print": rows["print"],
                     "marks": pa.array(bits, pa.binary())})


def _local_marks(table: pa.Table) -> pa.Table:
    """A bit for each start of each block: whether its string stands at a second start of the shard."""
    out = []
    for part in _groups(table):
        pieces = part["bytes"].to_pylist()
        data, at, valid = _shard_texts(pieces)
        marked, _ = repeated_starts(data, valid)
        bits = [np.packbits(marked[a:a + len(p) - SPAN + 1]).tobytes() for a, p in zip(at.tolist(), pieces)]
        out.append(_marks(part, bits))
    return pa.concat_tables(out) if out else _marks(table, [])


def _string_prints(piece: bytes) -> np.ndarray:
    sums = _Sums(np.frombuffer(piece, np.uint8))
    start = np.arange(len(piece) - SPAN + 1)
    return sums.prints(start, start + SPAN)


def _sorted_lists(table: pa.Table) -> pa.Table:
    """The different strings of a shard as a sorted list of prints, cut at the borders of ranges."""
    rows = []
    for part in _groups(table):
        pieces = part["bytes"].to_pylist()
        data, at, valid = _shard_texts(pieces)
        _, ones = repeated_starts(data, valid)
        holder = np.searchsorted(at, ones, "right") - 1
        prints = [_string_prints(p) for p in pieces]
        found = np.unique(np.array([prints[h][o - at[h]] for h, o in zip(holder.tolist(), ones.tolist())], np.uint64))
        anchor, shard, ranges = part["anchor"][0].as_py(), part["shard"][0].as_py(), part["ranges"][0].as_py()
        borders = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
        edges = np.r_[0, np.searchsorted(found, borders), len(found)]
        rows += [(anchor, shard, k, found[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    names = ["anchor", "shard", "range", "prints"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], names)


def merge_lists(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different values of sorted lists of different values, in order, and how many lists hold each.

    Two lists merge by binary search of one in the other; lists merge in pairs, so a value moves
    log(lists) times.
    """
    merged = [(x, np.ones(len(x), np.int64)) for x in lists]
    while len(merged) > 1:
        done = []
        for k in range(0, len(merged) - 1, 2):
            (a, m), (b, c) = merged[k], merged[k + 1]
            at = np.searchsorted(a, b)
            same = np.zeros(len(b), bool)
            same[at < len(a)] = a[at[at < len(a)]] == b[at < len(a)]
            m = m.copy()
            m[at[same]] += c[same]
            done.append((np.insert(a, at[~same], b[~same]), np.insert(m, at[~same], c[~same])))
        merged = done + merged[len(merged) - len(merged) % 2:]
    return merged[0]


def _shared_prints(table: pa.Table) -> pa.Table:
    """Of one range of one anchor: for each shard, its prints that a second shard holds as well."""
    lists = [np.frombuffer(b, np.uint64) for b in table["prints"].to_pylist()]
    values, held = merge_lists(lists)
    many = values[held > 1]
    back = [x[np.isin(x, many)].tobytes() for x in lists]
    return pa.table({"anchor": table["anchor"], "shard": table["shard"], "prints": pa.array(back, pa.binary())})


def _crossing_marks(rows: pa.Table, shared: pa.Table) -> pa.Table:
    """Marks of the strings of a shard that other shards hold."""
    known = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(b, np.uint64) for b in shared["prints"].to_pylist()]))
    bits = [np.packbits(np.isin(_string_prints(p), known)).tobytes() for p in rows["bytes"].to_pylist()]
    return _marks(rows, bits)


def _texts(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column, without a copy of each text."""
    whole = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(whole):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = whole.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different blocks of each shard in a batch with their number: periodic text has few, many times."""
    for batch in batches:
        data, offsets = _texts(batch.column("text"))
        first, _, anchor, print_ = blocks(data, offsets)
        shard = np.asarray(batch.column("shard"))[np.searchsorted(offsets, first, "right") - 1]
        _, one, n = np.unique(mix(mix(anchor) ^ print_) ^ shard.astype(np.uint64), return_index=True, return_counts=True)
        for a in range(0, len(one), 100_000):
            b = one[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(shard[b], pa.int64()), pa.array(anchor[b].view(np.int64)),
                                              pa.array(print_[b].view(np.int64)), pa.array(n[a:a + 100_000], pa.int64())],
                                             ["shard", "anchor", "print", "n"])


def _match(anchor: np.ndarray, print_: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks stand among the rows of a table sorted by mixed key; -1 where they do not."""
    key = mix(rows["anchor"].to_numpy().view(np.uint64)) ^ rows["print"].to_numpy().view(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    want = mix(anchor) ^ print_
    at = np.searchsorted(key, want)
    hit = np.zeros(len(want), bool)
    hit[at < len(key)] = key[at[at < len(key)]] == want[at < len(key)]
    return np.where(hit, at, -1), order


def _wanted_blocks(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The bytes of the blocks that are wanted from this shard, one copy each."""
    data, offsets = _texts(docs["text"])
    first, last, anchor, print_ = blocks(data, offsets)
    at, order = _match(anchor, print_, wanted)
    hits, places = np.unique(at, return_index=True)
    places, rows = places[hits >= 0], order[hits[hits >= 0]]
    text = [data[f:e + SPAN].tobytes() for f, e in zip(first[places].tolist(), last[places].tolist())]
    chosen = wanted.take(pa.array(rows))
    return pa.table({"home": chosen["shard"], "anchor": chosen["anchor"], "print": chosen["print"],
                     "copies": chosen["copies"], "blocks": chosen["blocks"], "bytes": pa.array(text, pa.binary())})


def _cover(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """The contract's row of each text: its bytes under marked strings go."""
    data, offsets = _texts(docs["text"])
    first, last, anchor, print_ = blocks(data, offsets)
    edge = np.zeros(len(data) + 1, np.int32)
    if len(first) and len(marks):
        # a block may come with several marks: full ones (null), of its shard, of other shards
        marks = marks.group_by(["anchor", "print"]).aggregate([("marks", "list"), ("full", "max")])
        at, order = _match(anchor, print_, marks)
        full = marks["full_max"].to_numpy()
        row = np.where(at >= 0, order[at], -1)
        whole = (row >= 0) & full[row]
        edge[first[whole]] += 1
        edge[last[whole] + SPAN] -= 1
        lists = marks["marks_list"]
        for f, e, r in zip(*(x[(row >= 0) & ~whole].tolist() for x in (first, last, row))):
            n = e - f + 1
            bits = np.zeros(n, bool)
            for m in lists[r].as_py():
                bits |= np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)
            starts = f + np.flatnonzero(bits)
            edge[starts] += 1
            edge[starts + SPAN] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    rise = gone & ~np.r_[False, gone[:-1]]
    rise[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
    total, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(rise)]
    removed, runs = np.diff(total[offsets]), np.diff(spans[offsets])
    sha = [hashlib.sha256(data[a:b] if not r else data[a:b][~gone[a:b]].tobytes()).hexdigest()
           for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist())]
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed),
                     "n_spans": pa.array(runs.astype(np.int64)), "kept_sha256": pa.array(sha)})


def repeated_bytes(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``.

    Null texts are empty. Texts of fewer than ``SPAN`` bytes keep all. Rows that repeat a doc_id or
    a text are texts each, so a row that stands twice loses all strings of ``SPAN`` bytes. A null doc_id
    stays null. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit("")).cast("binary")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // SHARD) or 1
    rows = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"))
    grams = rows.select("shard", "text").mapInArrow(_block_rows, "shard long, anchor long, print long, n long")

    # anchors that stand twice, and whether all their blocks are equal
    # (stored first, so that both sides of the join are dealt out for it and a hot anchor can be split)
    seen = cut(grams.groupBy(F.col("anchor").alias("of")).agg(
        F.sum("n").alias("all"), (F.min("print") != F.max("print")).alias("mixed")).filter("all > 1").drop("all"))
    meeting = cut(grams.join(seen, grams["anchor"] == seen["of"]).select("shard", "anchor", "print", "n", "mixed"))

    # of blocks that differ under one anchor, one copy each goes to a shard of its own
    kinds = cut(meeting.filter("mixed").groupBy("anchor", "print").agg(
        F.min("shard").alias("shard"), F.sum("n").alias("copies")))
    many = kinds.groupBy(F.col("anchor").alias("of")).agg(F.count("*").alias("blocks"))
    wanted = kinds.join(many, kinds["anchor"] == many["of"]).drop("of")
    texts = cut(rows.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(
        _wanted_blocks, "home long, anchor long, print long, copies long, blocks long, bytes binary"))

    mark = "home long, anchor long, print long, marks binary"
    few = texts.filter(F.col("blocks") <= limit).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = texts.filter(F.col("blocks") > limit).withColumn("ranges", F.ceil(F.col("blocks") / limit)).withColumn(
        "shard", F.pmod(F.col("print"), F.col("ranges")))
    lists = dealt.groupBy("anchor", "shard").applyInArrow(
        _sorted_lists, "anchor long, shard long, range long, prints binary")
    shared = lists.groupBy("anchor", "range").applyInArrow(_shared_prints, "anchor long, shard long, prints binary")
    marks = (few.groupBy("shard").applyInArrow(_local_marks, mark)
             .unionByName(dealt.groupBy("anchor", "shard").applyInArrow(_local_marks, mark))
             .unionByName(dealt.groupBy("anchor", "shard").cogroup(shared.groupBy("anchor", "shard")).applyInArrow(
                 _crossing_marks, mark)))

    # a block that stands twice is marked whole wherever it stands, one that stands once by its strings
    none = F.lit(None).cast("binary").alias("marks")
    twice = kinds.filter("copies > 1").select(F.col("anchor").alias("a"), F.col("print").alias("p"))
    mixed = meeting.filter("mixed")
    flags = (meeting.filter("not mixed").select("shard", "anchor", "print", F.lit(True).alias("full"), none)
             .unionByName(mixed.join(twice, (mixed["anchor"] == twice["a"]) & (mixed["print"] == twice["p"])).select(
                 "shard", "anchor", "print", F.lit(True).alias("full"), none))
             .unionByName(marks.select(F.col("home").alias("shard"), "anchor", "print", F.lit(False).alias("full"), "marks")))
    return rows.groupBy("shard").cogroup(flags.groupBy("shard")).applyInArrow(
        _cover, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS k
      FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM d)),
m AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q
      FROM (SELECT r, p, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE n > 1),
g AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM m),
i AS (SELECT r, run, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY 1, 2),
c AS (SELECT i.r, a, b, lag(b, 1, 0) OVER (PARTITION BY i.r ORDER BY a) AS z FROM i),
k AS (SELECT c.r, sum(b - a) AS gone, count(*) AS spans, max(b) AS done,
             string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front
      FROM c JOIN d ON c.r = d.r GROUP BY 1)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(done, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
