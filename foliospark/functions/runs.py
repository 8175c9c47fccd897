"""Repeated characters and sequences in batches of texts: numpy finds the lines that hold some, the
patterns rewrite those lines and no others."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

CHUNK = 1 << 18
#: Units of up to this many bytes are looked for at every distance, longer ones by repeated windows.
NEAR = 64
WINDOW, STEP = 32, 4
SPARSE = 16
_CHARS = re.compile(r"(.)\1{9,}")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()


def _near(data: np.ndarray, cuts: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Places and byte lengths (1 to ``NEAR``) of repeated units that lie in one line.

    ``size`` bytes that stand five times in a row are ``4 size`` bytes that equal those ``size`` further on, hence
    ``4 size - 7`` equal words in a row (for one byte ten times, 2). Words that cross the end of a line equal nothing.
    """
    places, sizes = [], []
    for at in range(0, len(data), CHUNK):
        part = np.ascontiguousarray(data[at:at + CHUNK + 5 * NEAR])
        if len(part) < 10:
            break
        words = _words(part)
        ends = cuts[np.searchsorted(cuts, at):np.searchsorted(cuts, at + len(part))] - at
        crossing = (ends[:, None] - np.arange(1, 8)[None, :]).reshape(-1)
        crossing = np.concatenate([crossing[(crossing >= 0) & (crossing < len(words))], np.flatnonzero(part[:len(words)] == 10)])
        words[crossing] = np.uint64(0xFF) << np.uint64(56) | crossing.astype(np.uint64)  # no text has this byte
        for size in range(1, NEAR + 1):
            need = 4 * size - 7 if size > 1 else 2
            if size >= SPARSE:  # the run holds three places in a row that are multiples of SPARSE
                sample = words[size::SPARSE] == words[:max(0, len(words) - size):SPARSE]
                if not (sample[2:] & sample[1:-1] & sample[:-2]).any():
                    continue
            same = np.flatnonzero(words[size:] == words[:-size]) if len(words) > size else ()
            if len(same) >= need:
                # of hits in ascending order, the ones that stand need - 1 apart bound a whole run
                run = same[:len(same) - need + 1][same[need - 1:] - same[:len(same) - need + 1] == need - 1]
                if len(run):
                    places.append(run + at)
                    sizes.append(size)
    return places, sizes


def _far(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, int]:
    """Per line, the greatest byte length above ``NEAR`` of a unit that stands five times in a row.

    Bytes of the first copy come back ``4 size`` later, so windows at every fourth place come back at such a place:
    at least ``(size - 31) // 4`` windows of a line repeat an earlier one, and their number bounds the size.
    """
    found = {}
    long = np.flatnonzero(ends - starts >= 5 * (NEAR + 1))
    sizes = (ends - starts)[long]
    group = np.cumsum(sizes) // (4 * CHUNK)
    for k in np.unique(group):
        lines = long[group == k]
        first = starts[lines[0]]
        part = np.ascontiguousarray(data[first:ends[lines[-1]]])
        words = _words(part)
        places = np.arange(0, len(part) - WINDOW + 1, STEP)
        line = np.searchsorted(starts[lines], places + first, "right") - 1
        inside = places + (first + WINDOW) <= ends[lines][line]
        places, line = places[inside], line[inside]
        sums = line.astype(np.uint64) * _MIX[3]
        for j in range(WINDOW // 8):
            sums = (sums ^ words[places + 8 * j]) * _MIX[j]
            sums ^= sums >> np.uint64(29)
        order = np.sort(sums)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            continue
        order = np.argsort(sums, kind="stable")
        again = order[1:][sums[order[1:]] == sums[order[:-1]]]
        copies = np.bincount(line[again], minlength=len(lines))
        for i, c in zip(lines.tolist(), copies.tolist()):
            text = data[starts[i]:ends[i]]
            for size in range(min(len(text) // 5, STEP * c + 35), NEAR, -1):
                # a run of 4 size equal bytes holds three places in a row that are multiples of size
                sample = text[size::size] == text[:len(text) - size:size]
                if (sample[2:] & sample[1:-1] & sample[:-2]).any():
                    other = np.flatnonzero(np.r_[True, text[size:] != text[:-size], True])
                    if (np.diff(other) > 4 * size).any():
                        found[i] = size
                        break
    return found


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """First and last place of each line of the texts between ``offsets``; and of the lines that hold a repeat,
    an upper bound for its unit."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1, offsets[-1:]]))
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    found = _far(data, starts, ends)
    for places, size in zip(*_near(data, starts)):
        for i in np.unique(np.searchsorted(starts, places, "right") - 1).tolist():
            found[i] = max(found.get(i, 0), size)
    return starts, ends, found


def _sequences(line: str, bound: int) -> str:
    top = 1 << max(1, bound - 1).bit_length()  # few patterns
    return re.sub(rf"(.{{2,{top}}})\1{{4,}}", r"\1\1\1", line)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _replaced(texts: list[bytes], chars: bool) -> dict[int, bytes]:
    """The texts that change, by number."""
    data, offsets = _flat(texts)
    starts, ends, found = _units(data, offsets)
    lines = {i: data[starts[i]:ends[i]].tobytes().decode(errors="replace") for i in found}
    if chars:
        # fewer characters may bring new sequences
        short = {i: s for i, line in lines.items() if (s := _CHARS.sub(r"\1\1\1", line)) != line}
        if short:
            again = _replaced([s.encode() for s in short.values()], False)
            short = {i: again[k].decode() if k in again else s for k, (i, s) in enumerate(short.items())}
    else:
        short = {}
    new = {i: short[i] if i in short else _sequences(line, found[i]) for i, line in lines.items()}
    changed, pieces = {}, {}
    for i in sorted(new):
        if new[i] != lines[i]:
            pieces.setdefault(int(np.searchsorted(offsets, starts[i], "right")) - 1, []).append(i)
    for row, own in pieces.items():
        at, out = offsets[row], []
        for i in own:
            out += [data[at:starts[i]].tobytes(), new[i].encode()]
            at = ends[i]
        changed[row] = b"".join([*out, data[at:offsets[row + 1]].tobytes()])
    return changed


def collapsed(values: pa.Array, chars: bool) -> pa.Array:
    """``values`` with repeats collapsed, a few texts at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(values), 0), np.int64)
    group = np.cumsum(sizes) // (16 * CHUNK)
    changed = {}
    for k in np.unique(group).tolist():
        first, last = np.searchsorted(group, [k, k + 1]).tolist()
        part = values.slice(first, last - first).cast(pa.binary()).to_pylist()
        changed |= {first + i: t for i, t in _replaced([t or b"" for t in part], chars).items()}
    if not changed:
        return values
    mask = np.zeros(len(values), bool)
    mask[list(changed)] = True
    new = pa.array([changed[i].decode(errors="replace") for i in sorted(changed)], values.type)
    return pc.replace_with_mask(values, pa.array(mask), new)


# A kind of function of its own: Spark 4.1 merges the projections of functions of one kind that feed each other
# (see ``markup.divisions``) and then fails to evaluate the outer one.
@F.pandas_udf(T.StringType())
def sequences_collapsed(texts: pd.Series) -> pd.Series:
    return collapsed(pa.array(texts, pa.string()), False).to_pandas()


@F.pandas_udf(T.StringType())
def runs_collapsed(texts: pd.Series) -> pd.Series:
    return collapsed(pa.array(texts, pa.string()), True).to_pandas()


@F.pandas_udf(T.ArrayType(T.StringType()))
def each_runs_collapsed(texts: pd.Series) -> pd.Series:
    """Each text of a row's array; null ones stay null."""
    lists = pa.array(texts, pa.list_(pa.string()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    offsets = pa.array(np.cumsum(np.r_[0, sizes]), pa.int32())
    none = lists.is_null() if lists.null_count else None
    return pa.ListArray.from_arrays(offsets, collapsed(lists.flatten(), True), mask=none).to_pandas()
