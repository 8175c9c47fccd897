"""Fuzzy search for short licence notices.

A notice may occur with up to k edits. Cut into k + 1 pieces, at least one piece of it survives any
k edits, so every occurrence holds an exact seed (pigeonhole). One automaton finds all seeds of all
notices in a pass over the words of a text; around each seed a window of the notice's length plus k
is searched by the regex library with at most k errors, which verifies the edits and gives the
span. A base phrase is a notice with no edits: its one seed is the phrase itself.
"""

from __future__ import annotations

import bisect
import functools
from typing import NamedTuple

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F


class Notice(NamedTuple):
    words: str
    edits: int
    label: str


#: Phrases counted exactly.
BASE = (Notice("mit license", 0, "mit"), Notice("apache license", 0, "apache"),
        Notice("general public license", 0, "gpl"))
#: Notices found with edits; their labels are the method's own.
FUZZY = (
    Notice("mit license", 1, "mit-like"),
    Notice("apache license", 2, "apache-like"),
    Notice("general public license", 3, "gpl-like"),
    Notice("mozilla public license", 3, "mpl-like"),
    Notice("licensed under cc by", 2, "cc-like"),
    Notice("creative commons attribution", 3, "cc-like"),
    Notice("permission is hereby granted free of charge", 5, "mit-grant"),
    Notice("redistribution and use in source and binary forms", 5, "bsd-grant"),
)

#: Letters and digits of ASCII and every byte above it are word bytes; A-Z are lower-cased.
_KEEP = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP else 0x20 for b in range(256))


def word_line(text: str) -> tuple[str, int]:
    """The words of a text, each with a blank on both sides, and their number."""
    words = text.encode().translate(_TABLE).split()
    return f" {b' '.join(words).decode()} ", len(words)


def cut_pieces(words: str, parts: int) -> list[tuple[int, str]]:
    """``parts`` pieces of nearly the same length, with their offsets."""
    ends = [len(words) * k // parts for k in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(ends, ends[1:])]


def matches(pattern: regex.Pattern, line: str, spans: set[tuple[int, int]]) -> set[tuple[int, int, int]]:
    """Start, end and edits of the best match of each window. A window is the notice and its edits on both
    sides, too short for two matches apart from each other."""
    found = set()
    for lo, hi in spans:
        m = pattern.search(line, lo, hi)
        if m and m.group().strip():
            left = len(m.group()) - len(m.group().lstrip())
            found.add((m.start() + left, m.start() + len(m.group().rstrip()), sum(m.fuzzy_counts)))
    return found


def apart(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches that overlap, the one with the fewest edits, then the first; in order of place."""
    taken: list[tuple[int, int, int]] = []
    for a, b, errors in sorted(found, key=lambda m: (m[2], m[0], -m[1])):
        k = bisect.bisect(taken, (a,))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b, errors))
    return taken


class Scanner:
    def __init__(self, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY):
        self.notices = [*base, *fuzzy]
        self.n_base = len(base)
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(self.notices):
            pieces = [(-1, f" {n.words} ")] if k < self.n_base else cut_pieces(n.words, n.edits + 1)
            for offset, piece in pieces:
                seeds.setdefault(piece, []).append((k, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()
        self.exact = [regex.compile(rf"(?<= ){regex.escape(n.words, literal_spaces=True)}(?= )") for n in base]
        self.near = [regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.edits}}}(?= )") for n in fuzzy]

    def windows(self, line: str) -> dict[int, set[tuple[int, int]]]:
        """By notice: the part of the line around each seed that can hold it. Windows are searched one by
        one: in a joined window the best match would hide others beside it."""
        found: dict[int, set[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(line):
            for k, offset in where:
                n = self.notices[k]
                at = end + 1 - size - offset
                lo, hi = max(0, at - n.edits - 1), min(len(line), at + len(n.words) + n.edits + 1)
                found.setdefault(k, set()).add((lo, hi))
        return found

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """Number of words, and hits (label, first word, words, edits, base) in order of the text."""
        line, n_words = word_line(text or "")
        hits = set()
        for k, spans in self.windows(line).items():
            pattern, at, words_before = (self.exact + self.near)[k], 0, 0
            for a, b, errors in apart(matches(pattern, line, spans)):
                words_before += line.count(" ", at, a)
                at = a
                hits.add((words_before - 1, self.notices[k].label, line.count(" ", a, b) + 1, errors, k < self.n_base))
        return n_words, [(label, first, size, e, base) for first, label, size, e, base in sorted(hits)]


@functools.lru_cache(maxsize=4)
def scanner(base: tuple[Notice, ...], fuzzy: tuple[Notice, ...]) -> Scanner:
    return Scanner(base, fuzzy)


HITS = "n_words long, hits array<struct<label:string,first:long,words:long,edits:long,base:boolean>>"


def license_hits(docs: DataFrame, base: tuple[Notice, ...] = BASE, fuzzy: tuple[Notice, ...] = FUZZY,
                 text: str = "text") -> DataFrame:
    """All columns of ``docs`` that do not clash, then ``scan``: n_words and the hits with spans in words.

    Null and empty texts have no words and no hits. Rows are independent of each other, so repeated
    rows repeat their results and an empty table gives none.
    """
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        tool = scanner(base, fuzzy)
        rows = []
        for t in texts:
            n, hits = tool.scan(t)
            rows.append((n, [dict(zip(("label", "first", "words", "edits", "base"), h)) for h in hits]))
        return pd.DataFrame(rows, columns=["n_words", "hits"])

    other = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "scan"]
    return docs.select(*other, scan(F.coalesce(F.col(text), F.lit(""))).alias("scan"))


def license_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best share of a notice's letters that stands unedited, 0 without a hit.
    """
    size = {n.label: float(min(len(m.words) for m in FUZZY if m.label == n.label)) for n in FUZZY}
    lengths = F.create_map(*[F.lit(x) for pair in size.items() for x in pair])
    hits = license_hits(docs.select("doc_id", "text"))
    base = F.filter("scan.hits", lambda h: h["base"])
    firsts = F.transform(base, lambda h: h["first"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda h: h["label"]))), ",")
    closeness = F.transform("scan.hits", lambda h: F.when(h["base"], F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - h["edits"] / F.coalesce(F.try_element_at(lengths, h["label"]), F.lit(1.0)))))
    return hits.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"), F.array_max(firsts).alias("last_word"),
        labels(base).alias("base_labels"), labels("scan.hits").alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"))
