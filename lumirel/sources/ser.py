"""SER videos: a header of 178 bytes, frames, and optional time stamps of ticks.

Files are found and opened by Spark. A file is split into rows of frames, so that a video's
frames are decoded in parallel after one read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import ticks_to_timestamp

HEADER = "<14s7i40s40s40s2q"
HEADER_BYTES = struct.calcsize(HEADER)
FRAMES = "path string, frame_id int, width int, height int, ticks long, data array<float>"


def header(content: bytes) -> dict:
    """The fields of a header; files that aren't SER videos, or are cut, fail."""
    if len(content) < HEADER_BYTES or not content.startswith(b"LUCAM-RECORDER"):
        raise ValueError("not a SER file")
    names = ["file_id", "camera", "color", "endian", "width", "height", "depth", "frames", "observer", "instrument", "telescope", "local_ticks", "utc_ticks"]
    found = dict(zip(names, struct.unpack_from(HEADER, content), strict=True))
    return {k: v.rstrip(b"\0 ").decode("ascii", "replace") if isinstance(v, bytes) else v for k, v in found.items()}


def write(path: str, frames: np.ndarray, ticks: list[int] | None = None, depth: int = 16) -> None:
    """Mono frames (frame, row, column) as a SER file."""
    n, h, w = frames.shape
    head = struct.pack(HEADER, b"LUCAM-RECORDER", 0, 0, 0, w, h, depth, n, b"", b"", b"", 0, 0)
    with open(path, "wb") as f:
        f.write(head + frames.astype("<u2" if depth > 8 else "u1").tobytes())
        if ticks:
            f.write(struct.pack(f"<{n}q", *ticks))


def read_frames(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """FRAMES and ts of the mono frames from first to last of the videos in a folder."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                h = header(content)
                wide = h["depth"] > 8
                size = h["width"] * h["height"] * (2 if wide else 1)
                tail = HEADER_BYTES + size * h["frames"]
                kind = np.dtype("u1") if not wide else np.dtype("<u2") if h["endian"] == 0 else np.dtype(">u2")
                stamps = np.frombuffer(content, "<i8", h["frames"], tail) if len(content) >= tail + 8 * h["frames"] else None
                for i in range(first, min(h["frames"], h["frames"] if last is None else last + 1)):
                    data = np.frombuffer(content, kind, h["width"] * h["height"], HEADER_BYTES + i * size).astype("f4")
                    yield pd.DataFrame({"path": [name], "frame_id": [i], "width": [h["width"]], "height": [h["height"]], "ticks": [int(stamps[i]) if stamps is not None else 0], "data": [data]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ser").load(path).select("path", "content")
    return files.mapInPandas(decode, FRAMES).withColumn("ts", ticks_to_timestamp(F.col("ticks")))


def estimate_fps(frames: DataFrame) -> DataFrame:
    """Frames a second by file, from its first and last time stamps."""
    span = (F.max("ticks") - F.min("ticks")) / 1e7
    return frames.filter("ticks > 0").groupBy("path").agg(F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("fps"))
