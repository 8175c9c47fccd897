"""Pixel jobs on decoded page images. Spark partitions the pages; numpy handles one page at a time.

Pixels are the bytes of the ``image`` source: rows of blue, green, red (and alpha) values.
"""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.schemas import PICTURES


def to_array(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def png_bytes(pixels: np.ndarray) -> bytes:
    """Encode a blue-green-red image as PNG."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, 1 + width * 3), np.uint8)
    rows[:, 1:] = pixels[:, :, 2::-1].reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return (struct.pack(">I", len(body)) + kind + body
                + struct.pack(">I", zlib.crc32(kind + body)))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header)
            + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))


def on_white(pixels: np.ndarray) -> np.ndarray:
    """Blend the alpha channel over white; grey becomes three channels."""
    if pixels.shape[2] == 1:
        return np.repeat(pixels, 3, axis=2)
    if pixels.shape[2] == 3:
        return pixels
    alpha = pixels[:, :, 3:].astype(np.uint16)
    mixed = pixels[:, :, :3].astype(np.uint16) * alpha + 255 * (255 - alpha)
    return ((mixed + 127) // 255).astype(np.uint8)


def _map_pages(images: DataFrame, change: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pages = [change(to_array(r.data, r.width, r.height, r.channels), r)
                     for r in batch.itertuples()]
            yield batch.assign(
                data=[np.ascontiguousarray(p).tobytes() for p in pages],
                height=[p.shape[0] for p in pages], width=[p.shape[1] for p in pages],
                channels=[p.shape[2] for p in pages])

    return images.filter("data IS NOT NULL").mapInPandas(run, images.schema)


def flatten_alpha(images: DataFrame) -> DataFrame:
    return _map_pages(images, lambda page, _: on_white(page))


def rotate(images: DataFrame) -> DataFrame:
    """Undo the predicted ``rotation`` (degrees, clockwise) of each page. ``rotated`` tells whether that
    could be done: other angles than multiples of 90, and null, leave the page as it is."""
    straight = F.coalesce(F.col("rotation") % 90 == 0, F.lit(False))
    known = images.withColumn("rotated", straight).withColumn("quarter_turns", F.when(
        straight, F.pmod(F.col("rotation") / 90, F.lit(4)).cast("int")).otherwise(0))
    return _map_pages(known, lambda page, row: np.rot90(page, k=row.quarter_turns)).drop("quarter_turns")


def crop(pixels: np.ndarray, bbox) -> np.ndarray | None:
    """The part of a page inside a box, None when it is empty."""
    height, width, _ = pixels.shape
    x1, y1, x2, y2 = (int(v) for v in bbox)
    x, y = max(0, x1), max(0, y1)
    w, h = min(width - x, x2 - x1), min(height - y, y2 - y1)
    return pixels[y:y + h, x:x + w] if w > 0 and h > 0 else None


def crop_pictures(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Replace the text of picture blocks by an inline image of their box.

    Only pages with a picture block that can be cropped meet their image, by an equi join on the page
    key, and a page is one row on both sides, so each image is decoded once. With the images stored by
    ``foliospark.sources.sinks.write_page_images`` the keys of these pages prune the scan at run time: pixels of
    other pages are not read. Failed crops keep the old text. ``pages`` is read twice and should be a stored table.
    """
    wanted = F.size(F.filter("blocks", lambda b: b["category"].isin(*PICTURES) & (F.size(b["bbox"]) == 4))) > 0
    pixels = images.select("task_id", "page_index", "data", "width", "height", "channels")
    keys = pages.filter(wanted).select("task_id", "page_index")
    # the semi join prunes the scan (where the keys are few enough to be sent to every task) and, by sort and
    # merge where they are many, keeps other pages' pixels out of the join
    needed = pixels.join(keys, ["task_id", "page_index"], "left_semi")
    joined = pages.filter(wanted).join(needed, ["task_id", "page_index"], "left")
    rest = pages.filter(~F.coalesce(wanted, F.lit(False)))

    def block(b, page):
        box = b["bbox"]
        if page is not None and b["category"] in PICTURES and box is not None and len(box) == 4:
            part = crop(page, box)
            if part is not None:
                uri = base64.b64encode(png_bytes(on_white(part))).decode()
                return {**b, "text": f"![image](data:image/png;base64,{uri})"}
        return b

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blocks = []
            for r in batch.itertuples():
                page = None if r.data is None else to_array(r.data, int(r.width), int(r.height),
                                                            int(r.channels))
                blocks.append([block(dict(b), page) for b in r.blocks])
            yield batch.assign(blocks=blocks)[columns]

    columns = pages.columns
    return joined.mapInPandas(run, pages.schema).unionByName(rest)
