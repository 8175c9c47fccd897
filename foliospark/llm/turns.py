"""Conversation structure repair by Viterbi over chunks that run at once (rank convergence).

The repair of a conversation is a cheapest path through four states (nothing yet, after a system
turn, after a user turn, after an assistant turn) with an edit for each row. Costs to the end are a
vector of four numbers before each row, computed backwards. A conversation may hold a third of all
rows, so its rows lie in several ranges of one sort order; the rows of a conversation in a range are a
chunk. All chunks start at once, each from a speculative vector behind its last row. Then fix-up
passes give each chunk the vector its successor really starts with and rerun it from its end until
old and new vectors differ by a constant only: from there on, all choices are the same. Passes end
when no chunk's vector changes by more than a constant.

With these costs known the least audit is traced forwards: among edits that stay cheapest the
ASCII-least goes first. A chunk does not know the state it is entered in, so it follows all four
to their ends; the four ends of each chunk of a conversation, followed in turn, give its entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from foliospark.operators.lineage import cut

from .common import BLANKS

DELETE, INSERT, REROLE = 3, 2, 2
#: States: 0 nothing, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
NEXT = (2, 2, 3, 2)
NAME = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs behind the last row: from nothing and after an assistant turn a conversation may end.
FINAL = (0, 4, 2, 0)
SPECULATIVE = (0, 0, 0, 0)


def kept_state(state: int, initial: str) -> int | None:
    """The state after keeping a row with this role initial, None where it may not be kept."""
    if initial == "s":
        return 1 if state == 0 else None
    if initial == "u":
        return 2 if state != 2 else None
    return 3 if initial == "a" and state == 2 else None


def before_row(after: tuple, initial: str, must_go: bool, truncated: bool) -> tuple:
    """Costs before a row from those behind it, insertions in front of the row included."""
    v = []
    for q in range(4):
        best = DELETE + after[q]
        if not must_go:
            best = min(best, REROLE + truncated + after[NEXT[q]])
            to = kept_state(q, initial)
            if to is not None:
                best = min(best, truncated + after[to])
        v.append(best)
    v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2]), v[2], v[3]


def normal(v: tuple) -> tuple[tuple, int]:
    """A vector from 0 up, and the constant it was raised by."""
    low = min(v)
    return tuple(x - low for x in v), low


def _turn(row) -> tuple[str, bool, bool]:
    return row.initial, row.blank or row.dup, row.trunc


def backwards(rows: list, end: tuple) -> list[tuple]:
    """Costs before each row and behind the last. Later copies of a row can only be deleted, which adds a constant."""
    vectors = [end]
    for row in reversed(rows):
        after = tuple(x + DELETE * (row.m - 1) for x in vectors[-1])
        vectors.append(before_row(after, *_turn(row)))
    return vectors[::-1]


def fix_up(rows: list, old: tuple, new: tuple, start: tuple) -> tuple:
    """The start of a chunk for another end, up to a constant: rerun until old and new run together."""
    for row in reversed(rows):
        if normal(old)[0] == normal(new)[0]:
            return start
        old, new = (before_row(v, *_turn(row)) for v in (old, new))  # later copies add a constant only
    return normal(new)[0]


def trace(rows: list, vectors: list[tuple], state: int, last: bool) -> tuple[list[tuple], int]:
    """(edit, row or None, role) of the least audit from a state, and the state behind the chunk."""
    edits = []
    for row, here, after in zip(rows, vectors, vectors[1:]):
        initial, must_go, truncated = _turn(row)
        after = tuple(x + DELETE * (row.m - 1) for x in after)
        while True:
            cost = here[state]
            if cost == DELETE + after[state]:
                edits.append(("D", None, None))
                break
            if cost == INSERT + here[NEXT[state]]:
                state = NEXT[state]
                edits.append(("I", None, NAME[state]))
                continue
            to = kept_state(state, initial)
            if to is not None and cost == truncated + after[to]:
                state = to
                edits.append(("K", row, row.role))
            else:
                state = NEXT[state]
                edits.append(("R", row, NAME[state]))
            break
        edits += [("D", None, None)] * (row.m - 1)
    while last and vectors[-1][state]:
        state = NEXT[state]
        edits.append(("I", None, NAME[state]))
    return edits, state


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage: ck (id as text), ht and turn, role, text, same (of role and text), m copies."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    role = F.when(kind == 4, "user").otherwise(part("role"))
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("ck"), F.col("turn").isNotNull().alias("ht"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
    # equal rows stand side by side, so they travel as one row with their number
    return (rows.filter("copies > 0").groupBy("ck", "ht", "turn", "role", "text").agg(F.sum("copies").alias("m"))
            .withColumn("same", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def _faults(rows: DataFrame) -> DataFrame:
    """Adds initial, blank, dup and trunc of a row's first copy; later copies are blank or duplicates."""
    first = rows.groupBy(F.col("ck").alias("of"), F.col("same").alias("as_")).agg(F.min(F.struct("ht", "turn")).alias("first"))
    rows = rows.join(first, rows["ck"].eqNullSafe(first["of"]) & (rows["same"] == first["as_"]), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    dup = ~blank & (F.struct("ht", "turn") != F.col("first"))
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return rows.select("ck", "ht", "turn", "same", "role", "text", "m", F.substring("role", 1, 1).alias("initial"),
                       blank.alias("blank"), dup.alias("dup"), (~blank & ~dup & ~end.isin(".", "!", "?")).alias("trunc"))


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[str | None, list]]:
    """The rows of each conversation in a range, in order."""
    pdf = pdf.sort_values(["ck", "ht", "turn", "same"], na_position="first", kind="stable")
    held, name = [], None
    for row in pdf.itertuples(index=False):
        key = row.ck if isinstance(row.ck, str) else None
        if held and key != name:
            yield name, held
            held = []
        name = key
        held.append(row)
    if held:
        yield name, held


_CHUNK = "ck string, part int, last boolean, start array<long>, end array<long>"


def _rerun(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chunk starts for given ends: from the end alone the first time, by fix-up after that."""
    out = []
    for ck, rows in _chunks(pdf):
        r = rows[0]
        end = tuple(r.new_end)
        start = normal(backwards(rows, end)[0])[0] if r.start is None else fix_up(rows, tuple(r.end), end, tuple(r.start))
        out.append((ck, r.part, r.last, list(start), list(end)))
    return pd.DataFrame(out, columns=["ck", "part", "last", "start", "end"])


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state behind a chunk for each of the four states before it."""
    out = []
    for ck, rows in _chunks(pdf):
        vectors = backwards(rows, tuple(rows[0].end))
        out.append((ck, rows[0].part, rows[0].last, list(rows[0].end), [trace(rows, vectors, q, False)[1] for q in range(4)]))
    return pd.DataFrame(out, columns=["ck", "part", "last", "end", "exits"])


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state each chunk of one conversation is entered in."""
    pdf = pdf.sort_values("part")
    state, entry = 0, []
    for exits in pdf["exits"]:
        entry.append(state)
        state = int(exits[state])
    return pdf.assign(entry=entry)[["ck", "part", "last", "end", "entry"]]


def _pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Audit, repaired lines and counts of each chunk."""
    out = []
    for ck, rows in _chunks(pdf):
        r = rows[0]
        inside = r.entry == r.entry  # a conversation in one range has no entry
        end, state, last = (tuple(r.end), int(r.entry), bool(r.last)) if inside else (FINAL, 0, True)
        edits, _ = trace(rows, backwards(rows, end), state, last)
        lines = [f"{role}:{row.text if row is not None else ''}" for e, row, role in edits if e != "D"]
        cost = sum({"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[e] + bool(row is not None and row.trunc)
                   for e, row, _ in edits)
        pairs = sum(row.m - 1 for row in rows) + sum(a.initial + b.initial not in LEGAL for a, b in zip(rows, rows[1:]))
        out.append((ck, r.part, sum(row.m if row.blank else 0 for row in rows),
                    sum(row.m - 1 + row.dup for row in rows if not row.blank), sum(row.trunc for row in rows),
                    pairs, rows[0].initial, rows[-1].initial, cost, "".join(e for e, _, _ in edits),
                    "\n".join(lines) if lines else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])


_PIECE = ("ck string, part int, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
          "cost long, audit string, lines string")
_WHOLE = ("ck string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _assembled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks in order to conversations; the hash takes one chunk's lines at a time."""
    name, held, hasher, audit, tail, any_line = None, None, None, [], "", False

    def whole():
        return pd.DataFrame([(name, *held, "".join(audit), hasher.hexdigest())], columns=[c.split()[0] for c in _WHOLE.split(", ")])

    for pdf in batches:
        done = []
        for r in pdf.itertuples(index=False):
            ck = r.ck if isinstance(r.ck, str) else None
            if held is None or ck != name:
                if held is not None:
                    done.append(whole())
                name, held, hasher, audit, any_line = ck, [0] * 5, hashlib.sha256(), [], False
            else:
                held[3] += tail + r.head not in LEGAL
            for k, value in enumerate((r.blank, r.duplicate, r.truncated, r.illegal, r.cost)):
                held[k] += int(value)
            audit.append(r.audit)
            tail = r.tail
            if isinstance(r.lines, str):
                hasher.update((("\n" if any_line else "") + r.lines).encode())
                any_line = True
        if done:
            yield pd.concat(done)
    if held is not None:
        yield whole()


def _vector(v: tuple) -> Column:
    return F.array(*[F.lit(x).cast("long") for x in v])


def _on(a: DataFrame, b: DataFrame) -> Column:
    return a["ck"].eqNullSafe(b["_ck"]) & (a["part"] == b["_part"])


def _keyed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumnsRenamed({"ck": "_ck", "part": "_part"})


def chunk_entries(rows: DataFrame) -> DataFrame:
    """ck, part, last, end, entry of the chunks of all conversations that lie in several ranges."""
    chunks = rows.groupBy("ck", "part").agg(F.lit(1).alias("one"))
    whole = W.partitionBy("ck")
    chunks = (chunks.withColumn("last", F.col("part") == F.max("part").over(whole))
              .withColumn("parts", F.count("*").over(whole)).filter("parts > 1"))
    none = F.lit(None).cast("array<long>")
    todo = cut(chunks.select("ck", "part", "last", none.alias("start"), none.alias("end"),
                             F.when(F.col("last"), _vector(FINAL)).otherwise(_vector(SPECULATIVE)).alias("new_end")))
    known = todo.limit(0).drop("new_end")
    while not todo.isEmpty():
        keyed = _keyed(todo)
        fresh = rows.join(keyed, _on(rows, keyed)).groupBy("part").applyInPandas(_rerun, _CHUNK)
        keep = known.join(_keyed(todo.select("ck", "part")), known["ck"].eqNullSafe(F.col("_ck")) & (known["part"] == F.col("_part")), "left_anti")
        known = cut(fresh.unionByName(keep))
        follow = F.lead("start").over(W.partitionBy("ck").orderBy("part"))
        todo = cut(known.withColumn("new_end", follow).filter(~F.col("last") & (F.col("new_end") != F.col("end"))))
    keyed = _keyed(known)
    exits = rows.join(keyed, _on(rows, keyed)).groupBy("part").applyInPandas(
        _exits, "ck string, part int, last boolean, end array<long>, exits array<int>")
    return exits.groupBy("ck").applyInPandas(_entries, "ck string, part int, last boolean, end array<long>, entry int")


def repaired(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conv_id.

    Null roles, texts, and ids or turns in the damage key are one space; a null conv_id is a
    conversation, a null turn comes first. Rows of one turn stand in the order of a hash of role and text,
    equal rows side by side. Conversations of which nothing is left get zeros, an empty audit and the
    hash of the empty string. An empty table gives no rows. ``ranges`` is the number of sort ranges,
    else the session's shuffle partitions.
    """
    order = ["ck", "ht", "turn", "same"]
    rows = _faults(damaged(conversations))
    rows = cut((rows.repartitionByRange(ranges, *order) if ranges else rows.repartitionByRange(*order))
               .withColumn("part", F.spark_partition_id()))
    entries = _keyed(cut(chunk_entries(rows)))
    pieces = rows.join(entries, _on(rows, entries), "left").drop("_ck", "_part").groupBy("part").applyInPandas(_pieces, _PIECE)
    whole = pieces.repartition("ck").sortWithinPartitions("ck", "part").mapInPandas(_assembled, _WHOLE)
    turns = rows.filter("ht").groupBy("ck", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("ck").alias("tk")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ids = conversations.select("conv_id").distinct().withColumn("id", F.col("conv_id").cast("string"))
    out = (ids.join(whole, ids["id"].eqNullSafe(whole["ck"]), "left")
           .join(turns, F.col("id").eqNullSafe(F.col("tk")), "left"))
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
