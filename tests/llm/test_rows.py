"""Operators that treat each text by itself: token counts, licence scans, fingerprints, packing, quality."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from foliospark.llm import licenses, mil, packing, syncmers, tokens
from foliospark.llm.common import crc_mod, word_hashes

from .conftest import odd_rows, prose, table, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def key(row):
    return tuple((x is None, x) for x in row)


def test_token_counts_agree_with_the_library(odd, sample, none):
    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (odd, sample):
        rows = docs.select("doc_id", "text").collect()
        want = sorted((key((r.doc_id, len((r.text or "").encode()), n, n > 2048)) for r, n in zip(
            rows, [len(e.ids) for e in tool.encode_batch([r.text or "" for r in rows], add_special_tokens=False)])))
        got = tokens.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
        assert sorted(map(key, got)) == want
    assert tokens.token_counts(none).count() == 0


def test_merging_a_long_piece_is_fast():
    tool = tokens.merger(public_tokenizers.path("word_bpe_49k.json"))
    assert 0 < tool.symbols_left("ab" * 100_000) < 200_000


def base_places(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return len(words), places


def test_license_base_places(spark, odd, sample, none):
    extra = table(spark, [(1, "the mit license mit license", "a"), (2, "gnu general public license " * 3, "a")])
    for docs in (odd, sample, extra):
        texts = defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            n, places = base_places(r.text)
            starts = [i for i, _ in places]
            texts[r.doc_id].append((n, len(places), min(starts, default=None), max(starts, default=None),
                                    ",".join(sorted({x for _, x in places}))))
        got = defaultdict(list)
        for r in licenses.license_report(docs).collect():
            got[r.doc_id].append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
            assert r.labels == ",".join(sorted(set(filter(None, r.labels.split(",")))))
        assert {k: sorted(v, key=repr) for k, v in got.items()} == {k: sorted(v, key=repr) for k, v in texts.items()}
    assert licenses.license_report(none).count() == 0


def edit_spans(line, words, edits):
    """Start, end and edit distance of all runs of whole words within ``edits`` of ``words``."""
    starts = [i + 1 for i, c in enumerate(line[:-1]) if c == " "]
    ends = [i for i, c in enumerate(line) if c == " "][1:]
    for a in starts:
        row = list(range(len(words) + 1))
        for j, c in enumerate(line[a:a + len(words) + edits + 1], 1):
            if a + j - 1 in ends and row[-1] <= edits:
                yield a, a + j - 1, row[-1]
            new = [j]
            for i, w in enumerate(words, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (w != c)))
            row = new


def test_license_hits_against_edit_distances():
    scan = licenses.Scanner()
    rng = random.Random(21)
    lines = ["general public licence general public license", "mit licence mit license mit licence",
             "apache licence apache license apachelicense"]
    pool = ["general", "public", "licence", "license", "licens", "mit", "mitt", "apache", "apachee", "mozilla", "pubic", "a",
            "licensed", "under", "cc", "by", "creative", "commons", "comons", "attribution"]
    lines += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    for text in lines:
        line, n_words = licenses.word_line(text)
        hits = scan.scan(text)[1]
        place = [i + 1 for i, c in enumerate(line[:-1]) if c == " "]
        for n in {m.label: m for m in licenses.FUZZY}.values():
            if sum(m.label == n.label for m in licenses.FUZZY) > 1:
                continue
            want = list(edit_spans(line, n.words, n.edits))
            got = []
            for label, first, size, e, base in hits:
                if label == n.label and not base:
                    a = place[first]
                    got.append((a, a + len(" ".join(line[a:].split()[:size])), e))
            assert set(got) <= set(want), (text, n.label)  # spans and edits are right
            for a, b, e in want:  # and none is lost but beside an overlapping one with as few edits
                assert any(c < b and a < d and f <= e for c, d, f in got), (text, n.label, a, b)
    assert [h[1] for h in scan.scan("general public licence general public license")[1] if h[0] == "gpl-like"] == [0, 3]


def test_license_edits_are_found_and_verified():
    scan = licenses.Scanner()
    line = "this is Released under the MIT Licence. and x"
    assert ("mit-like", 5, 2, 1, False) in scan.scan(line)[1]
    rng = random.Random(1)
    words = vocabulary(50, 2)
    for n in licenses.FUZZY:  # no more edits than allowed, wherever they are
        for _ in range(20):
            text = list(n.words)
            for k in rng.sample([i for i, c in enumerate(text) if c != " "], n.edits):
                text[k] = "z"
            found = scan.scan(prose(rng, words, 5) + ". " + "".join(text) + "! " + prose(rng, words, 5))[1]
            assert any(label == n.label and first == 5 for label, first, *_ in found), "".join(text)
    assert scan.scan("permission was not given")[1] == []
    assert scan.scan("mit lizenzen")[1] == []


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    """Windows whose least inner substring is at an edge, by comparing hashes of substrings one by one."""
    def value(part, base=0x9E3779B97F4A7C15, m=(1 << 64) - 1):
        h = 0
        for c in part:
            h = (h * base + ord(c)) & m
        return int(syncmers.mix(np.array([h], np.uint64))[0])
    out = []
    for i in range(len(text) - k + 1):
        inner = [value(text[i + j:i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((value(text[i:i + k]), i))
    return out


def test_closed_syncmers():
    rng = random.Random(5)
    text = prose(rng, vocabulary(40, 6), 60) + " é漢😀" * 5
    h, place = syncmers.anchors(text)
    assert list(zip(h.tolist(), place.tolist())) == brute_anchors(text)
    assert [len(syncmers.anchors(t)[0]) for t in ("", "ab")] == [0, 1]
    assert syncmers.fingerprint(None) == "" and syncmers.likeness("", "") == 1.0


def test_a_large_text_keeps_the_least_anchors():
    rng = random.Random(7)
    text = prose(rng, vocabulary(3000, 8), 8000)
    least = {}
    for h, place in zip(*map(np.ndarray.tolist, syncmers.anchors(text))):
        least.setdefault(h >> 32, place)
    want = "".join(f"{h:08x}{least[h]:08x}" for h in sorted(least)[:syncmers.SIZE])
    assert syncmers.fingerprint(text) == want


@pytest.mark.parametrize("edit", ["drop", "insert", "both"])
def test_near_copies_of_another_length_are_alike(edit):
    rng = random.Random(11)
    words = vocabulary(3000, 12)
    for _ in range(5):
        text = prose(rng, words, 1800).split()
        copy = []
        for k, w in enumerate(text):
            if k % 100 != 50 or edit == "insert":
                copy.append(w)
            if k % 100 == 70 and edit != "drop":
                copy.append(rng.choice(words))
        a, b = (syncmers.fingerprint(" ".join(t)) for t in (text, copy))
        assert syncmers.likeness(a, b) > 0.7
        other = syncmers.fingerprint(prose(rng, words, 1800))
        assert syncmers.likeness(a, other) < 0.2


@pytest.mark.parametrize("ranges", [1, 7])
def test_fingerprints(spark, odd, sample, none, ranges):
    for docs in (sample, table(spark, [(5, "alone", "a")]), odd):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        got = syncmers.fingerprints(docs, ranges).collect()
        assert len(got) == len(rows)
        prints = {}
        for r in got:
            assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        if docs is odd:
            continue
        rows.sort()
        by = {r.doc_id: r for r in got}
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            k = len(text) // 4
            new = text[:len(text) - k] + after[:k]
            r = by[doc]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
            assert r.fingerprint == syncmers.fingerprint(text) == prints.setdefault(text, r.fingerprint)
            assert r.near_next == syncmers.likeness(r.fingerprint, syncmers.fingerprint(after))
    assert syncmers.fingerprints(none).count() == 0


def test_packed_pieces_are_whole(spark, odd, sample, none):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd, sample):
        texts = docs.select("doc_id", "text").collect()
        pieces = packing.pack(docs).collect()
        want = defaultdict(int)  # the (start, crc) of pieces must be slices of one of the id's texts
        ids_of = defaultdict(list)
        for r, e in zip(texts, tool.encode_batch([r.text or "" for r in texts], add_special_tokens=False)):
            ids_of[r.doc_id].append(np.array([*e.ids, 0], "<u4"))
        covered, fill = defaultdict(int), defaultdict(list)
        for p in pieces:
            assert any(len(ids) == p.doc_tokens and zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
                       for ids in ids_of[p.doc_id])
            covered[p.doc_id] += p.length
            fill[p.sequence_id].append((p.offset, p.length))
        assert covered == {d: sum(map(len, v)) for d, v in ids_of.items()}
        padding = 0
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
            padding += 0 if at & (at - 1) == 0 else 1024 - at
        assert padding < 1024 * docs.rdd.getNumPartitions()
    assert packing.pack(none).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rng = random.Random(2)
    packer = packing.SumOfSquares(64)
    for _ in range(500):
        size = rng.randint(1, 63)
        before = packer.levels[:64].copy()
        options = []
        for h in range(0, 65 - size):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                if h + size < 64:
                    after[h + size] += 1
                options.append(int((after ** 2).sum()))
        full = packer.place(size, size)
        assert int((packer.levels[:64] ** 2).sum()) == min(options)
        assert full is None or sum(full) == 64


def test_few_open_windows_lose_nothing(spark, sample):
    total = packing.pack(sample).groupBy().sum("length").first()[0]
    assert packing.pack(sample, max_open=2).groupBy().sum("length").first()[0] == total


def test_quality_on_held_out_rows(spark, sample):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = mil.quality(docs, marks).join(marks, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc_mod(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)
    good = [r for r in held if r.quality]
    assert sum(r.predicted for r in good) >= 0.95 * len(good)


def test_quality_edges(spark, odd, none, labels):
    first = sorted((key((r.doc_id, r.score)) for r in mil.quality(odd, labels).collect()))
    again = sorted((key((r.doc_id, r.score)) for r in mil.quality(odd, labels).collect()))
    assert first == again and len(first) == odd.count()
    assert {r.score for r in mil.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert mil.quality(none, labels).count() == 0
    assert mil.accepted(odd, labels).columns == odd.columns


def test_all_documents_stay_without_both_labels(spark, odd, labels):
    for marks in (labels.limit(0), labels.filter("quality = 0"), labels.filter("quality IS NULL")):
        assert sorted(map(repr, mil.accepted(odd, marks).collect())) == sorted(map(repr, odd.collect()))


def test_fitting_sees_every_passage(spark, monkeypatch):
    text = prose(random.Random(4), vocabulary(300, 5), 6000)
    docs = table(spark, [(d, text, "a") for d in (1, 2)])
    marks = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(mil, "remainder", lambda *_: mil.F.lit(0))
    monkeypatch.setattr(mil, "fit", lambda bags, labels: seen.extend(np.array(b) for b in bags))
    mil.train(docs, marks)
    want = mil.encode([text])[0].astype(np.float16)
    assert len(want) > 24 and [b.shape for b in seen] == [want.shape] * 2
    assert all((b == want).all() for b in seen)


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, owner = rng.standard_normal((7, mil.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2])
    labels = np.array([1.0, 0.0, 1.0])
    shapes = {"W": (mil.FEATURES, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "c0": (1,)}
    model = mil.Model({k: rng.standard_normal(s) * 0.3 for k, s in shapes.items()}, 0, 1)

    def loss():
        y = model.forward(x, owner, 3)["y"]
        return -np.mean(labels * np.log(y) + (1 - labels) * np.log(1 - y))

    for name, g in model.gradients(x, owner, labels).items():
        at = tuple(rng.integers(0, s) for s in model.p[name].shape)
        old = model.p[name][at]
        model.p[name][at] = old + 1e-5
        up = loss()
        model.p[name][at] = old - 1e-5
        down = loss()
        model.p[name][at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_word_hashes():
    texts = [t for _, t, _ in odd_rows()]
    hashes, owner = word_hashes(texts)
    words = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    assert owner.tolist() == [i for i, _ in words]
    assert len({(h, w) for h, (_, w) in zip(hashes.tolist(), words)}) == len({w for _, w in words}) == len(set(hashes.tolist()))
