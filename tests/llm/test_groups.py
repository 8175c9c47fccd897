"""Operators that compare rows: exact, line and near duplicates, mixing, language model, pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import exact, lines, minhash, mixing, suffix
from foliospark.llm.common import components, crc_mod

from .conftest import odd_rows, prose, table, vocabulary

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


def last(x):
    return (x is None, x)


# ---- exact duplicates

def brute_exact(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), last(d), d))
    out = []
    for body, members in groups.items():
        keep = min(members)[2]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest()) for *_, d in members]
    return out


def test_exact_groups(odd, sample, none):
    for docs in (odd, sample):
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_groups(docs).collect()]
        assert sorted(got, key=repr) == sorted(brute_exact(rows_of(docs)), key=repr)
    assert exact.exact_groups(none).count() == 0


def test_filters_keep_and_merge_everything():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 5000, np.int64).astype(np.uint64) * np.uint64(2)
    a[:100] = a[100:200]
    b = np.r_[a[:50], rng.integers(0, 1 << 63, 3000, np.int64).astype(np.uint64)]
    fa, fb = (exact.QuotientFilter.build(x, 12) for x in (a, b))
    merged = exact.QuotientFilter.load(12, *fa.merge(fb).dump())
    want = Counter(a.tolist()) + Counter(b.tolist())
    assert dict(zip(merged.prints().tolist(), merged.counts.tolist())) == dict(want)


@pytest.mark.parametrize("share", [1, 100_000])
def test_ranges_do_not_change_the_counts(spark, monkeypatch, share):
    monkeypatch.setattr(exact, "PER_RANGE", share)
    monkeypatch.setattr(exact, "FLUSH", 7)
    prints = spark.createDataFrame([(k * 7919 - 3000,) for k in range(50)] * 2 + [(5,)], "fp long")
    assert exact.repeated_prints(prints, 101).count() == 50


# ---- line duplicates

def brute_lines(rows):
    sets, seen = [], {}
    for d, t, _ in rows:
        for i, line in enumerate([] if t is None else t.split("\n")):
            ws = frozenset(w for w in re.split(r"[ \t\x0b\f\r]+", line.lower()) if w)
            if ws:
                sets.append(((d is not None, d, i), t, ws))
    sets.sort(key=lambda x: (x[0], repr(x[1])))
    gone, unique = defaultdict(set), []
    for place, t, ws in sets:
        if ws in seen:
            if seen[ws] != (place, t):
                gone[place[1], t].add(place[2])
                continue
            continue
        if any(100 * len(ws & v) >= 80 * len(ws | v) for v in unique):
            gone[place[1], t].add(place[2])
        seen[ws] = (place, t)
        unique.append(ws)
    return gone


def line_table(spark, seed=9, docs=60, words=(3, 25)):
    rng = random.Random(seed)
    vocab = vocabulary(200, 1)
    lines_ = [prose(rng, vocab, rng.randint(*words)) for _ in range(40)]
    rows = []
    for d in range(docs):
        own = []
        for _ in range(rng.randint(0, 6)):
            ws = rng.choice(lines_).split()
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                ws[rng.randrange(len(ws))] = rng.choice(vocab)
            own.append(" ".join(ws))
        rows.append((d, "\n".join(own), "a"))
    return table(spark, rows)


@pytest.mark.parametrize("block", [7, lines.BLOCK])
def test_removed_lines(spark, odd, sample, none, monkeypatch, block):
    whole = lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda reps, percent, _: whole(reps, percent, block))
    short = line_table(spark, 11, 200, (1, 9))
    twice = line_table(spark, 12, 40).union(line_table(spark, 12, 40))
    for docs in (line_table(spark), line_table(spark, 10, 150), short, twice, odd, sample):
        rows = rows_of(docs)
        gone = brute_lines(rows)
        want = [(d, 0 if t is None else t.count("\n") + 1, ",".join(map(str, sorted(gone[d, t])))) for d, t, _ in rows]
        got = [(r.doc_id, r.n_lines, r.removed_lines) for r in lines.line_report(docs).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lines.line_report(none).count() == 0


@pytest.mark.parametrize("block", [100, lines.BLOCK])
def test_near_equal_lines_meet_in_linear_number(spark, monkeypatch, block):
    rng, vocab = random.Random(4), vocabulary(300, 2)
    base, rows = prose(rng, vocab, 60).split(), []
    for d in range(400):
        ws = list(base)
        for k in rng.sample(range(len(ws)), rng.randint(0, 7)):
            ws[k] = f"w{d}x{k}"
        rows.append((d, " ".join(ws), "a"))
    docs, whole, pairs = table(spark, rows), lines.candidates, []

    def counted(reps, percent, _):
        found = whole(reps, percent, block).cache()
        pairs.append(found.count())
        return found

    monkeypatch.setattr(lines, "candidates", counted)
    monkeypatch.setattr(lines, "COMMON", 50, raising=False)
    gone = brute_lines(rows_of(docs))
    got = {(r.doc_id, r.line_no) for r in lines.removed_lines(docs).collect()}
    assert got == {(d, i) for (d, _), own in gone.items() for i in own} and len(got) > 300
    assert pairs[0] < 10 * len(rows)


def test_words_of_a_line_are_hashed_once(sample):
    plan = lines.keyed_lines(sample, bytes(lines.SKETCH))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lambdafunction(xxhash64") == 1


def test_texts_without_repeated_lines(spark, odd):
    docs = line_table(spark)
    gone = brute_lines(rows_of(docs))
    want = {}
    for d, t, _ in rows_of(docs):
        left = [x for i, x in enumerate(t.split("\n")) if i not in gone[d, t]]
        if left:
            want[d] = "\n".join(left)
    got = lines.without_repeated_lines(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    kept = lines.without_repeated_lines(odd).collect()
    assert sum(r.text is None for r in kept) == 2 and any(r.text == "" for r in kept)


def test_line_plan_runs_no_python(spark, sample):
    plan = lines.line_report(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# ---- near duplicates

def shingles(text, k):
    ws = words(text)
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute_near(rows, k, percent=80):
    sets = [shingles(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        groups[find(i)].append(last(d))
    return [(d, len(sets[i]), min(groups[find(i)])[1]) for i, (d, *_) in enumerate(rows)]


def near_table(spark, seed=2):
    """Chains and clouds of copies at all distances around the limit."""
    rng = random.Random(seed)
    vocab = vocabulary(500, 3)
    rows, d = [], 100
    for _ in range(8):
        text = prose(rng, vocab, rng.choice([6, 30, 120, 200])).split()
        for _ in range(rng.randint(2, 12)):
            rows.append((d, " ".join(text), "a"))
            d += rng.randint(1, 3)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                text[rng.randrange(len(text))] = rng.choice(vocab)
    rng.shuffle(rows)
    return table(spark, rows)


def test_near_groups(spark, odd, sample, none):
    for docs in (near_table(spark), near_table(spark, 5), odd, sample):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.contract(docs).collect()]
        assert sorted(got, key=repr) == sorted(brute_near(rows_of(docs), 4), key=repr)
    assert minhash.contract(none).count() == 0


def test_near_groups_in_a_cloud(spark):
    """One cloud of copies of which many are just too far from each other: groups, single texts, bridges."""
    rng = random.Random(9)
    vocab = vocabulary(500, 3)
    base = prose(rng, vocab, 150).split()
    rows = []
    for d in range(150):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 7, 9])):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        rows.append((d, " ".join(text), "a"))
    docs = table(spark, rows)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.contract(docs).collect()]
    assert sorted(got) == sorted(brute_near(rows, 4))


@pytest.mark.parametrize("n", [1, 3, 20, 150, 1000, 3000])
def test_cells_lose_no_link(spark, n):
    rng = np.random.default_rng(n)
    pairs, linked = [], []
    for _ in range(40):
        base, cut_off = rng.integers(0, 1 << 62, n), int(rng.integers(0, n // 3 + 1))
        x = np.unique(base).astype(np.uint64)
        y = np.unique(np.r_[base[cut_off:], rng.integers(0, 1 << 62, int(rng.integers(0, cut_off + 2)))]).astype(np.uint64)
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        linked.append(100 * both >= 80 * (len(x) + len(y) - both))
        cells = minhash.parities(np.r_[x, y], np.repeat([0, 1], [len(x), len(y)]), 2)
        pairs.append((len(pairs), len(x), len(y), cells[0].tolist(), cells[1].tolist()))
    df = spark.createDataFrame(pairs, "i int, nx long, ny long, cx array<long>, cy array<long>")
    ok = minhash._cells_allow({"n": F.col("nx"), "cells": F.col("cx")}, {"n": F.col("ny"), "cells": F.col("cy")}, 80)
    got = {r.i for r in df.filter(ok).collect()}
    assert any(linked) and got >= {i for i, link in enumerate(linked) if link}


def test_one_document_of_each_group_stays(spark, odd):
    docs = near_table(spark)
    want = {c for _, n, c in brute_near(rows_of(docs), 5)}
    got = minhash.one_of_each(docs)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == want
    kept = minhash.one_of_each(odd).collect()
    groups = {c for _, n, c in brute_near(rows_of(odd), 5) if n}
    assert len(kept) == len(groups) + sum(not words(t) for _, t, _ in odd_rows())


def slow_superminhash(items, slots):
    """One element at a time, with an early stop by element."""
    out = [float("inf")] * slots
    for x in items:
        perm = list(range(slots))
        for j in range(slots):
            if j > max(out):
                break
            seed = np.uint64((0x51ED27 + j) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            draw = minhash.mix(np.array([np.uint64(x) ^ seed], np.uint64))
            k = j + int(minhash.mix(draw)[0] % np.uint64(slots - j))
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], j + int(draw[0] >> np.uint64(11)) / 2.0 ** 53)
    return out


@pytest.mark.parametrize("n", [1, 5, 40, 400])
def test_signatures_of_many_at_once(n):
    rng = np.random.default_rng(n)
    docs = [rng.integers(0, 1 << 62, n + k).astype(np.uint64) for k in range(3)]
    got = minhash.signatures(np.concatenate(docs), np.repeat([0, 2, 1], [n, n + 1, n + 2]), 3, 64)
    for row, items in zip((0, 2, 1), docs):
        assert got[row].tolist() == slow_superminhash(items, 64)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(50)] + [
        (rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    root = {}
    for x in {v for e in edges for v in e}:
        root[x] = x
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    assert {r.node: r.root for r in components(df).collect()} == root
    assert components(df.limit(0)).count() == 0


# ---- mixing

def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=last)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(size.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * size[s]]
        if not above:
            return size, fixed | share
        fixed |= {s: 3.0 * size[s] for s in above}


def test_mixture(spark, odd, sample, none, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    skewed = table(spark, [(k, "w " * (k % 13), "hot" if k % 3 else f"s{k % 7}") for k in range(400)])
    for docs in (skewed, odd, sample):
        rows = rows_of(docs)
        size, target = brute_targets(rows)
        source = {}
        got = mixing.mixture(docs).collect()
        assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(d), len(words(t))) for d, t, _ in rows)
        ids = Counter(d for d, *_ in rows)
        source = {d: s for d, _, s in rows if ids[d] == 1}
        taken = defaultdict(int)
        largest = defaultdict(int)
        for r in got:
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            if r.doc_id in source:
                s = source[r.doc_id]
                assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        if docs is skewed:
            for r in got:
                taken[source[r.doc_id]] += r.taken
                largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r.size)
            assert all(abs(taken[s] - target[s]) <= largest[s] + 1e-6 for s in size)
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mixture(docs.repartition(5)).collect()))
    assert mixing.mixture(none).count() == 0


def test_probabilities_stay_right_on_average():
    n = 400
    hits = sum(np.array(mixing.pivot([1, 2, 3, 4], [3.0, 5.0, 2.0, 9.0], [0.3, 0.5, 0.6, 0.2], seed)) for seed in range(n)) / n
    assert np.allclose(hits, [0.3, 0.5, 0.6, 0.2], atol=0.08)


def test_mixed_documents(spark, odd):
    copies = Counter(r.doc_id for r in mixing.mixed_documents(odd).collect())
    sizes = odd.count()
    assert mixing.mixed_documents(odd).columns == odd.columns and 0 < sum(copies.values()) <= 3 * sizes
    ids = Counter(d for d, *_ in odd_rows())
    assert all(c <= 3 * ids[d] for d, c in copies.items())


# ---- language model

def test_scores(spark, odd, sample, none):
    for docs in (sample, odd):
        rows = rows_of(docs)
        counts = Counter()
        for d, t, _ in rows:
            if crc_mod(d, 10):
                counts.update([*words(t), None])
        n, v = sum(counts.values()), len(counts)
        base = lambda t: sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])
        want = sorted((repr(d), crc_mod(d, 10) == 0, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]),
                       n, round(base(t), 4)) for d, t, _ in rows)
        got = suffix.lm_scores(docs).collect()
        assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert suffix.lm_scores(none).count() == 0
    untrained = table(spark, [(d, "a b", "s") for d in range(200) if crc_mod(d, 10) == 0])
    assert {r.n_known for r in suffix.lm_scores(untrained).collect()} == {0}


def test_the_tree_gives_chances_of_longest_suffixes(spark):
    """Against a plain walk: longest kept context at each byte; the chances of a context sum to one."""
    texts = [t or "" for _, t, _ in odd_rows()] + ["the cat sat on the mat"] * 30
    counts = suffix.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    grams = counts.filter("kind = 1").select("key", "n").cache()
    tree = suffix.suffix_tree(grams, grams.groupBy().sum("n").first()[0], depth=3, least=1e-3)
    columns = int(tree.column.max()) + 1
    chance = 10.0 ** tree.logp.reshape(-1, columns).astype(float)
    unseen = 256 - (columns - 1)
    assert np.allclose(chance[:, :-1].sum(1) + unseen * chance[:, -1], 1, atol=1e-4)
    got = tree.log10(texts, width=16)
    for t, score in zip(texts, got):
        data = suffix.byte_stream([t])[0]
        state, total = tree.step[tree.column[10]], 0.0
        for b in data[1:]:
            total += tree.logp[state * columns + tree.column[b]]
            state = tree.step[state * columns + tree.column[b]]
        assert abs(total - score) < 1e-2 + 1e-5 * abs(total)
    assert got[-1] > -0.8 * 23 * np.log10(256)  # better than even chances


def test_rare_contexts_stay_however_large_the_corpus(spark):
    """A small language keeps its contexts, longer than five bytes, beside a corpus that grows."""
    rng = random.Random(8)
    hot = vocabulary(2000, 8)
    few = [" ".join(rng.choice(["zyxwvu", "zyxwvq"]) + "k" for _ in range(4)) for _ in range(30)]
    chances = []
    for n in (200, 2000):
        texts = [prose(rng, hot, 60) for _ in range(n)] + few
        counts = suffix.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
        got = suffix.gram_chances(counts.filter("kind = 1").select("key", "n")).collect()
        key = int(suffix.gram_keys(*(suffix.byte_stream(["zyxwvuk"])[i] for i in (0, 2)))[-2])
        chances.append(10 ** {r.key: r.logp for r in got}[key])
    assert min(chances) > 0.9


def test_scores_from_tables_are_those_of_the_automaton(spark, odd, monkeypatch):
    rng = random.Random(6)
    small = table(spark, [(d, prose(rng, ["the", "cat", "sat", "on", "mats"], 30), "a") for d in range(100)])
    for docs, share in ((odd, 1e-2), (small, 2e-7)):
        monkeypatch.setattr(suffix, "FREQUENT_GRAM", share)  # joined and looked up
        rows = rows_of(docs)
        train = docs.filter(suffix.remainder(F.col("doc_id"), suffix.HELD) != 0).select("text")
        grams = suffix.corpus_counts(train).filter("kind = 1").select("key", "n").cache()
        total = grams.groupBy().sum("n").first()[0]
        tree = suffix.suffix_tree(grams, total, least=(suffix.LEAST - 0.5) / total)
        want = sorted((repr(d), round(float(s), 1)) for (d, *_), s in zip(rows, tree.log10([t for _, t, _ in rows])))
        got = sorted((repr(r.doc_id), r.score) for r in suffix.lm_scores(docs).collect())
        assert [d for d, _ in got] == [d for d, _ in want]
        assert all(abs(a - b) < 0.1 + 1e-4 * abs(b) for (_, a), (_, b) in zip(got, want))


# ---- pipeline

def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "minhash near-dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        assert after.count() > 0
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = after
    result = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, result.drop("sequence_id", "offset").collect()))[:1]
    total = sum(len(words(r.text)) for r in docs.collect())
    assert result.groupBy().sum("length").first()[0] > total / 4


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_stages_on_odd_tables(spark, odd, none, labels, tmp_path, empty):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = none if empty else odd
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert after.columns == docs.columns
        assert (after.count() == 0) or not empty
