"""Scoring text with a probabilistic suffix tree.

A text is the bytes of its lower-cased (A-Z) words, a blank between words and a line feed as its
end. The model gives each byte after the context of up to ``DEPTH`` bytes before it. A context stays
in the tree if it stands at ``LEAST`` places, an absolute count, so that more text brings more contexts,
and its next-byte distribution diverges from that of its longest proper suffix; suffixes and prefixes
of contexts that stay also stay. Distributions are smoothed by those of the suffix, in the measure of
how many different bytes followed.

The tree is never gathered in one place: it is a table per length of context, and a last table
(``gram_chances``) has the chance of every context and next byte of the corpus. Grams of at least
``FREQUENT_GRAM`` of all places (at most 1 / FREQUENT_GRAM) are looked up in the task; each use of any
other one meets its chance in a join. ``suffix_tree`` makes the same tree as an automaton in memory, for
small corpora; the tests hold the tables against it.

The unigram base needs the count of every word of every text. Words of at least ``FREQUENT`` of all
tokens (at most 1 / FREQUENT words) are looked up in the task; each use of any other word meets its
count in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from foliospark.operators.lineage import cut

from .common import remainder, slices, word_hashes

DEPTH = 6              # with the next byte 7 of the 8 bytes of a key
LEAST = 10             # places
DIVERGENCE = 0.003     # nats
FREQUENT = 1e-6
FREQUENT_GRAM = 2e-7
HELD = 10
END_KEY = 0x656E64
WORD, GRAM, HELD_GRAM = 0, 1, 2
_TABLE = bytes(max(1, b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256))
_MERGE_AT = 3_000_000


def byte_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each between a leading and a closing line feed; index of the text of each
    byte and its place in it. The leading byte is context only. Byte 0 is read as byte 1."""
    raw = [b"\n" + b" ".join((t or "").encode().translate(_TABLE).split()) + b"\n" for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.frombuffer(b"".join(raw), np.uint8), owner, place


def gram_keys(data: np.ndarray, place: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Per predicted byte: the byte in the lowest 8 bits, above it the context, the nearest byte
    lowest; zero where the text has not begun."""
    key = data.astype(np.int64)
    for j in range(1, depth + 1):
        before = np.zeros(len(data), np.int64)
        before[j:] = data[:-j] if j <= len(data) else 0
        key |= np.where(place >= j, before, 0) << (8 * j)
    return key[place > 0]


class Tally:
    """Counts of keys in bounded memory: sorted arrays that are merged as they grow."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def merge(self) -> None:
        keys = np.concatenate(self.keys)
        counts = np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        self.keys, self.counts = [keys[starts]], [np.add.reduceat(counts, starts)]
        self.size = len(starts)

    def frames(self, kind: int) -> Iterator[pd.DataFrame]:
        if self.size:
            self.merge()
            keys, counts = self.keys[0], self.counts[0]
            for at in range(0, len(keys), 500_000):
                yield pd.DataFrame({"kind": kind, "key": keys[at:at + 500_000], "n": counts[at:at + 500_000]})
        self.__init__()


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) over rows (text): words by hash, the end as END_KEY, and byte contexts with
    their next byte. Of rows with ``held_out`` true, if there is this column, only the latter, as
    HELD_GRAM. Counts are merged in each task before they are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies, docs = {WORD: Tally(), GRAM: Tally(), HELD_GRAM: Tally()}, 0
        for pdf in batches:
            for part in slices(pdf, "text", 2_000_000):
                if "held_out" in part:
                    held = part["held_out"].astype(bool)
                    if held.any():
                        data, _, place = byte_stream(part["text"][held].tolist())
                        tallies[HELD_GRAM].add(gram_keys(data, place))
                    part = part[~held]
                    if not len(part):
                        continue
                own = part["text"].tolist()
                docs += len(own)
                data, _, place = byte_stream(own)
                tallies[GRAM].add(gram_keys(data, place))
                tallies[WORD].add(word_hashes(own)[0].view(np.int64))
                for kind, tally in tallies.items():
                    if tally.size > _MERGE_AT:
                        tally.merge()
                    if tally.size > _MERGE_AT:
                        yield from tally.frames(kind)
        for kind, tally in tallies.items():
            yield from tally.frames(kind)
        if docs:
            yield pd.DataFrame({"kind": [WORD], "key": [END_KEY], "n": [docs]})

    rows = texts.mapInPandas(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Automaton:
    """States by number. ``column`` maps a byte to its column; bytes never seen share the last one.
    ``step[state * columns + column]`` is the next state and ``logp`` likewise its log10 chance."""

    def __init__(self, step: np.ndarray, logp: np.ndarray, column: np.ndarray, depth: int):
        self.step, self.logp, self.column, self.depth = step, logp, column, depth

    def log10(self, texts: list[str | None], width: int = 512) -> np.ndarray:
        """log10 probability of each text. The bytes of all texts are cut into rows of ``width``
        that run side by side; a row warms up on the bytes before it, which fix its state."""
        data, owner, place = byte_stream(texts)
        n, warm = len(data), self.depth
        rows = -(-n // width)
        padded = np.full(warm + rows * width, self.column[10], np.int32)
        padded[warm:warm + n] = self.column[data]
        columns = int(self.column.max()) + 1
        at = np.arange(rows) * width
        state = np.zeros(rows, np.int32)
        out = np.empty((width, rows), np.float32)
        for t in range(warm + width):
            slot = state * columns + padded[at + t]
            if t >= warm:
                out[t - warm] = self.logp[slot]
            state = self.step[slot]
        scores = out.T.reshape(-1)[:n].astype(np.float64)
        scores[place == 0] = 0
        return np.bincount(owner, scores, len(texts))


def _mask(d: int) -> int:
    return (1 << 8 * d) - 1


def gram_chances(grams: DataFrame, depth: int = DEPTH, least: int = LEAST,
                 divergence: float = DIVERGENCE) -> DataFrame:
    """(key, logp): log10 of the chance of the byte of each key after the longest context that stays,
    from (key, n), n counting training places only; keys of n = 0 are other texts' and get a chance too.

    ``levels[d]`` has the keys cut to d bytes of context; where a text has not begun d bytes before,
    the key has no such context and its chance is that of the level below.
    """
    n, t = F.col("n"), F.col("t")
    share = n / F.greatest(t, F.lit(1))
    context = F.shiftright("key", 8)
    whole = lambda d: F.shiftright("key", 8 * d) != 0
    down = lambda df, d: df.withColumn("low", F.col("key").bitwiseAND(_mask(d)))
    cuts = {depth: grams.select("key", "n")}
    for d in range(depth - 1, -1, -1):
        cuts[d] = cut(cuts[d + 1].groupBy(F.col("key").bitwiseAND(_mask(d + 1)).alias("key")).agg(F.sum("n").alias("n")))
    total = cuts[0].groupBy().sum("n").first()[0] or 0
    levels = {0: cuts[0].withColumn("t", F.lit(total).cast("long"))}
    for d in range(1, depth + 1):
        up = levels[d - 1].select(F.col("key").alias("low"), share.alias("q"))
        by = W.partitionBy("ctx")  # at most 256 rows
        sums = cuts[d].withColumn("ctx", context).select(
            "*", F.sum("n").over(by).alias("t"), F.sum((n > 0).cast("long")).over(by).alias("back"))
        # only places of the training texts tell how far a context is from its suffix
        apart = F.sum(F.when(n > 0, share * F.log(share / F.col("q"))).otherwise(0.0))
        levels[d] = cut(down(sums, d).join(up, "low").select(
            "key", "n", "t", "back", "ctx", (apart.over(by) >= divergence).alias("far")))
    stay = {}
    for d in range(depth, 0, -1):
        own = levels[d].filter(whole(d) & F.col("far") & (t >= least)).select("ctx")
        if d < depth:  # with all suffixes and prefixes
            own = own.union(stay[d + 1].select(F.col("ctx").bitwiseAND(_mask(d)))).union(
                stay[d + 1].select(F.shiftright("ctx", 8)))
        stay[d] = cut(own.distinct())
    chance = cut(levels[0].select("key", ((n + 0.5) / (t + 128)).alias("p")))
    for d in range(1, depth + 1):
        below = chance.select(F.col("key").alias("low"), F.col("p").alias("r"))
        kept = stay[d].withColumn("kept", F.lit(True))
        rows = down(levels[d], d).join(kept, "ctx", "left").join(below, "low")
        sure = F.col("kept") & whole(d) & (t >= least)
        chance = cut(rows.select("key", F.when(sure, (n + F.col("back") * F.col("r")) / F.greatest(t + F.col("back"), F.lit(1)))
                                 .otherwise(F.col("r")).alias("p")))
    return chance.select("key", F.log10("p").alias("logp"))


def packed(chances: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """key and logp in order of key, brought to the driver as bytes and not as an object per row."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": [pdf["key"].to_numpy("<i8").tobytes()], "p": [pdf["logp"].to_numpy("<f8").tobytes()]})

    got = chances.mapInPandas(pack, "k binary, p binary").collect()
    keys = np.frombuffer(b"".join(r.k for r in got), "<i8")
    order = np.argsort(keys)
    return keys[order], np.frombuffer(b"".join(r.p for r in got), "<f8")[order]


def suffix_tree(grams: DataFrame, total: int, depth: int = DEPTH, least: float = 2e-5,
                divergence: float = DIVERGENCE) -> Automaton:
    """The automaton of the tree learned from (key, n), in memory; ``least`` is a share of ``total``
    here. An empty corpus gives even chances."""
    depths = F.explode(F.array(*[F.lit(d) for d in range(depth + 1)])).alias("d")
    masks = F.create_map(*[F.lit(x) for d in range(depth + 1) for x in (d, _mask(d))])
    context = F.shiftright("key", 8).bitwiseAND(masks[F.col("d")])
    # a context of length d has a byte at place d
    whole = (F.col("d") == 0) | (F.expr("shiftright(ctx, cast(8 * (d - 1) as int))") != 0)
    level = (grams.select(depths, "key", "n").select(
        "d", context.alias("ctx"), F.col("key").bitwiseAND(255).alias("byte"), "n")
        .filter(whole).groupBy("d", "ctx", "byte").agg(F.sum("n").alias("n")))
    totals = level.groupBy("d", "ctx").agg(F.sum("n").alias("t")).filter(F.col("t") >= least * total)
    level = cut(level.join(totals, ["d", "ctx"]))
    parent = level.select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "byte",
                          (F.col("n") / F.col("t")).alias("q"))
    p = F.col("n") / F.col("t")
    child = level.filter("d > 0").withColumn("up", F.col("ctx").bitwiseAND(masks[F.col("d") - 1]))
    apart = (child.join(parent, ["d", "up", "byte"]).groupBy("d", "ctx")
             .agg(F.sum(p * F.log(p / F.col("q"))).alias("kl")).filter(F.col("kl") >= divergence))
    kept = {(0, 0)}
    for d, ctx in apart.select("d", "ctx").toLocalIterator():
        todo = [(d, ctx)]
        while todo:  # with all suffixes and prefixes
            d, ctx = todo.pop()
            if d and (d, ctx) not in kept:
                kept.add((d, ctx))
                todo += [(d - 1, ctx & _mask(d - 1)), (d - 1, ctx >> 8)]
    # at most depth / least contexts with up to 256 bytes each
    table = level.toPandas()
    return build_automaton(table, kept, depth)


def build_automaton(table: pd.DataFrame, kept: set[tuple[int, int]], depth: int) -> Automaton:
    states = sorted(kept)
    number = {s: i for i, s in enumerate(states)}
    counts = np.zeros((len(states), 256))
    rows = [number.get((d, c), -1) for d, c in zip(table["d"].tolist(), table["ctx"].tolist())]
    rows = np.array(rows, np.int64)
    ok = rows >= 0
    np.add.at(counts, (rows[ok], table["byte"].to_numpy(np.int64)[ok]), table["n"].to_numpy(float)[ok])
    p = np.zeros_like(counts)
    for i, (d, ctx) in enumerate(states):  # shorter contexts come first
        if not d:
            p[i] = (counts[i] + 0.5) / (counts[i].sum() + 128)
        else:
            back = np.count_nonzero(counts[i])
            p[i] = (counts[i] + back * p[number[d - 1, ctx & _mask(d - 1)]]) / (counts[i].sum() + back) \
                if back else p[number[d - 1, ctx & _mask(d - 1)]]
    lengths = np.array([d for d, _ in states])
    contexts = np.array([c for _, c in states], np.int64)
    step = np.zeros((len(states), 256), np.int32)
    longer = contexts[:, None] << 8 | np.arange(256)[None, :]
    for d in range(1, depth + 1):
        own = np.flatnonzero(lengths == d)
        if len(own):
            values = contexts[own]  # ascending, as states are sorted
            wanted = longer & _mask(d)
            at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
            hit = (values[at] == wanted) & (lengths[:, None] + 1 >= d)
            step[hit] = own[at][hit]
    seen = np.flatnonzero(counts[0])
    column = np.full(256, len(seen), np.int32)
    column[seen] = np.arange(len(seen))
    # a byte never seen has the same small chance as any other one and leads to the empty context
    one = np.setdiff1d(np.arange(256), seen)[:1]
    p = np.hstack([p[:, seen], p[:, one] if len(one) else np.ones((len(states), 1))])
    step = np.hstack([step[:, seen], np.zeros((len(states), 1), np.int32)])
    return Automaton(step.reshape(-1), np.log10(p).astype(np.float32).reshape(-1), column, depth)


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    The model and the base learn from rows whose crc32(doc_id) mod 10 is not 0. Null texts are
    empty: one token, the end. Repeated rows count each and score alike; an empty table gives no rows;
    without training rows every byte is as likely as any other and no word is known.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       (remainder(F.col("doc_id"), HELD) == 0).alias("held_out"))
    counts = cut(corpus_counts(rows.select("text", "held_out")))
    facts = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    tokens, distinct = (facts[WORD].n, facts[WORD].v) if WORD in facts else (0, 0)
    places = sum(facts[k].n for k in (GRAM, HELD_GRAM) if k in facts)
    grams = cut(counts.filter(F.col("kind") != WORD).groupBy("key").agg(
        F.sum(F.when(F.col("kind") == GRAM, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("used")))
    chances = cut(gram_chances(grams).join(grams.select("key", "used"), "key"))
    # at most 1 / FREQUENT_GRAM grams can have this share of all places
    usual = packed(chances.filter(F.col("used") >= FREQUENT_GRAM * places).select("key", "logp"))
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    # at most 1 / FREQUENT words can have this share of all tokens
    often = words.filter(F.col("n") >= FREQUENT * tokens).toPandas().sort_values("key")
    end = words.filter(F.col("key") == END_KEY).first()
    shared = docs.sparkSession.sparkContext.broadcast(
        (*usual, often["key"].to_numpy(np.int64), np.log10(often["n"].to_numpy(float) + 0.1)))
    end_log, end_known = float(np.log10((end.n if end else 0) + 0.1)), int(end is not None)
    below = float(np.log10(tokens + 0.1 * (distinct + 1)))

    def look_up(asked: np.ndarray, keys: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each value asked for is a key, and its log, 0 if it is none."""
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        known = keys[at] == asked
        return known, np.where(known, logs[at], 0.0)

    def others(asked: np.ndarray, owner: np.ndarray, known: np.ndarray, docs: int) -> list[np.ndarray]:
        """The values that are no keys, by text."""
        return np.split(asked[~known], np.cumsum(np.bincount(owner[~known], minlength=docs))[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram_list, gram_logs, keys, logs = shared.value
        uid = TaskContext.get().partitionId() << 40
        for pdf in batches:
            for part in slices(pdf, "text", 1_000_000):
                own = part["text"].tolist()
                data, of, place = byte_stream(own)
                asked, of = gram_keys(data, place), of[place > 0]
                distinct_keys, back = np.unique(asked, return_inverse=True)
                sure, found = look_up(distinct_keys, gram_list, gram_logs)
                sure, found = sure[back], found[back]
                hashes, owner = word_hashes(own)
                hashes = hashes.view(np.int64)
                known, log = look_up(hashes, keys, logs)
                yield pd.DataFrame({
                    "uid": uid + np.arange(len(own)), "doc_id": part["doc_id"].to_numpy(),
                    "held_out": part["held_out"].to_numpy(), "n_tokens": np.bincount(owner, minlength=len(own)) + 1,
                    "known": np.bincount(owner[known], minlength=len(own)) + end_known,
                    "base": np.bincount(owner, log, len(own)) + end_log,
                    "found": np.bincount(of, found, len(own)),
                    "rest": others(hashes, owner, known, len(own)), "grams": others(asked, of, sure, len(own))})
                uid += len(own)

    schema = (f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, "
              "found double, rest array<long>, grams array<long>")
    first = cut(rows.mapInPandas(run, schema))  # a table, so that uid stays what it is
    rest = (first.select("uid", F.explode("rest").alias("key"))
            .join(words.withColumnRenamed("n", "c"), "key", "left")
            .groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("more"),
                                F.count("c").alias("more_known")))
    rare = (first.select("uid", F.explode("grams").alias("key")).groupBy("uid", "key").count()
            .join(chances.select("key", "logp"), "key")
            .groupBy("uid").agg(F.sum(F.col("count") * F.col("logp")).alias("rare")))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return first.drop("rest", "grams").join(rest, "uid", "left").join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        (F.col("found") + zero("rare")).alias("score"))
