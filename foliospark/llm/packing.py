"""Packing tokens into windows by the sum-of-squares rule.

Whole windows of a long document are sequences of their own; what is left of each document is placed
online. ``levels[h]`` is the number of open windows filled to h. An item of size s may open a window
or go into one filled to h <= capacity - s; it goes where the sum of the squared counts comes out
lowest. At the end of a task, and whenever more than ``max_open`` windows are open, the pieces of
the open windows are cut anew into full windows, so that only the last sequence of a task is padded.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import slices

CAPACITY = 1024
MAX_OPEN = 4096
END = 0
#: The id of the end-of-text string, which the tokenizer reads as a special token inside texts.
SPECIAL = {"<|endoftext|>": 50256}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The vocabulary of byte_bpe_50k.json as ranks: the ids are the same, made several times faster."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=SPECIAL)


def token_ids(text: str | None, vocabulary: str = "byte_bpe_50k.tiktoken") -> np.ndarray:
    """The ids of a text and the end id, as unsigned 32-bit numbers."""
    tool = encoder(public_tokenizers.path(vocabulary))
    if not text:
        return np.array([END], "<u4")
    ids = (tool.encode(text, allowed_special="all") if "<|endoftext|>" in text
           else tool.encode_ordinary(text))
    ids.append(END)
    return np.array(ids, "<u4")


class SumOfSquares:
    """Open windows by fill level. An item is (size, anything)."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int, item) -> list | None:
        """Place an item; the content of the window it fills up, else None."""
        top = self.capacity - size
        # growth of the sum for each level: one window fewer at h, one more at h + size
        growth = 2 * self.levels[size:] + 1
        growth[-1] = 0  # full windows are closed and not counted
        growth[1:] -= 2 * self.levels[1:top + 1] - 1
        growth[1:][self.levels[1:top + 1] == 0] = np.iinfo(np.int64).max
        h = top - int(np.argmin(growth[::-1]))  # of equal choices the fullest window
        window = self.windows[h].pop() if h else []
        window.append(item)
        if h:
            self.levels[h] -= 1
        if h == top:
            return window
        self.levels[h + size] += 1
        self.windows[h + size].append(window)
        return None

    def open(self) -> int:
        return int(self.levels.sum())

    def drain(self) -> Iterator[list]:
        """All open windows, fullest first."""
        for h in range(self.capacity - 1, 0, -1):
            yield from self.windows[h]
            self.windows[h] = []
        self.levels[:] = 0


PIECES = ("doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every row is a document of its own: repeated rows give repeated pieces in different places. Null
    and empty texts are the end id alone. A task packs the rows it reads, so nothing is shuffled;
    its sequences are numbered from its partition number on. An empty table gives no pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 40
        packer, out = SumOfSquares(capacity), []

        def put(doc, start, ids, total, offset):
            out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

        def close(window):
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                put(doc, start, ids, total, offset)
                offset += len(ids)
            sequence += 1

        def recut():
            """Cut the pieces of the open windows into full windows and a last one."""
            nonlocal sequence
            fill = 0
            for window in packer.drain():
                for doc, start, ids, total in window:
                    while len(ids):
                        head, ids = ids[:capacity - fill], ids[capacity - fill:]
                        put(doc, start, head, total, fill)
                        start, fill = start + len(head), fill + len(head)
                        if fill == capacity:
                            sequence, fill = sequence + 1, 0
            sequence += fill > 0

        def frame():
            columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            pdf = pd.DataFrame(out, columns=columns)
            out.clear()
            return pdf

        for pdf in batches:
            for part in slices(pdf, "text"):
                for doc, text in zip(part["doc_id"].astype(object), part["text"]):
                    doc = None if pd.isna(doc) else doc
                    ids = token_ids(text)
                    total, whole = len(ids), len(ids) // capacity * capacity
                    for start in range(0, whole, capacity):
                        close([(doc, start, ids[start:start + capacity], total)])
                    if whole < total:
                        full = packer.place(total - whole, (doc, whole, ids[whole:].copy(), total))
                        if full is not None:
                            close(full)
                        if packer.open() > max_open:
                            recut()
                if out:
                    yield frame()
        recut()
        if out:
            yield frame()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(
        run, PIECES.format(kind=kind))
