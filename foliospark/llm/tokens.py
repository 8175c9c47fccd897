"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary file gives normal form, pre-tokens and merge ranks. Each distinct pre-token starts
as its symbols; the adjacent pair of lowest rank is popped from a heap and merged in a linked list
until no pair has a rank. The count is the initial symbols minus the merges; no ids are made.
Merging costs n log n in the length of a pre-token, so texts without white space are no hazard.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

VOCABULARY = "word_bpe_49k.json"
CACHE = 1_000_000  # counts of short pre-tokens kept by a Python worker, about 130 MB


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is a visible Latin-1 character, else the next unused one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merger:
    """Counts the tokens of texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + suffix] for s in symbols]
        self.rank: dict[int, int] = {}
        self.product: list[int] = []
        for k, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[vocab[a] << 20 | vocab[b]] = k
            self.product.append(vocab[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache: dict[str, int] = {}

    def symbols_left(self, word: str) -> int:
        raw = word.encode()
        n = len(raw)
        if n == 1:
            return 1
        inner, rank, product = self.inner, self.rank, self.product
        sym = [inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        heap = [r * n + i for i in range(n - 1)
                if (r := rank.get(sym[i] << 20 | sym[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j >= n or sym[i] < 0 or rank.get(sym[i] << 20 | sym[j]) != r:
                continue  # the pair has gone meanwhile
            sym[i], sym[j] = product[r], -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if (q := rank.get(sym[i] << 20 | sym[k])) is not None:
                    heapq.heappush(heap, q * n + i)
            h = before[i]
            if h >= 0 and (q := rank.get(sym[h] << 20 | sym[i])) is not None:
                heapq.heappush(heap, q * n + h)
        return left

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            # lower-casing is by character: a final sigma is no special case
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def plain(self, text: str) -> int:
        cache, total = self.cache, 0
        for word in self.pieces(text):
            n = cache.get(word)
            if n is None:
                n = self.symbols_left(word)
                if len(word) <= 32:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = n
            total += n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" not in text:
            return self.plain(text)
        # special strings are cut out of the raw text, one token each
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048,
                 text: str = "text") -> DataFrame:
    """All columns of ``docs`` that do not clash, then n_bytes, n_tokens and over_limit.

    A null or empty text has no bytes and no tokens. Rows are independent: repeated rows give
    repeated results, an empty table gives none. ``vocabulary`` names a file of the public
    tokenizers on each machine.
    """
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tool = merger(public_tokenizers.path(vocabulary))
        return texts.map(tool.count).astype("int64")

    body = F.coalesce(F.col(text), F.lit(""))
    mine = {"n_bytes", "n_tokens", "over_limit"}
    other = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in mine]
    return (docs.select(*other, F.octet_length(body).cast("long").alias("n_bytes"), count(body).alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
