"""SER videos as a Spark data source: byte ranges as partitions, frames pruned when they are planned, a writer that commits.

    spark.dataSource.register(SerSource)
    frames = spark.read.format("ser").load("/data/videos")                                              # a folder, or one file
    some = spark.read.format("ser").option("first", 1000).option("last", 1999).load("/data/videos")     # opens these frames' bytes only
    frames.write.format("ser").mode("append").save("/data/segments")

What is opened is said by options and not by filters: Spark 4.1 keeps what one query pushed down
to a Python data source for later queries on the same DataFrame, which would then miss rows.

Planning reads the 178 bytes of each file's header; a partition is a file's frames of about partBytes bytes, and a task
reads them by chunks of BATCH_BYTES, so a file may be larger than any task's memory. Paths may be local (shared by all executors) or of
any scheme that Arrow's file systems know (hdfs, s3, gs).
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.spectral import ticks_to_timestamp
from ..operators import compose
from . import ser
from .images import to_pixels

PART_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
#: The numbers of colour modes in headers.
COLORS = {0: "MONO", 8: "RGGB", 9: "GRBG", 10: "GBRG", 11: "BGGR", 16: "CYYM", 17: "YCMY", 18: "YMCY", 100: "RGB", 101: "BGR"}
SCHEMA = "path string, frame_id int, width int, height int, color string, depth int, ticks long, data array<float>"
ARROW = pa.schema([("path", pa.string()), ("frame_id", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("color", pa.string()), ("depth", pa.int32()), ("ticks", pa.int64()), ("data", pa.list_(pa.float32()))])


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Frames(InputPartition):
    """Frames from first to before last of one file, and what its header says."""

    path: str
    first: int
    last: int
    head: dict
    size: int


def frame_bytes(head: dict) -> int:
    planes = 3 if head["color"] >= 100 else 1
    return head["width"] * head["height"] * planes * (2 if head["depth"] > 8 else 1)


class SerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 2**31 - 2)) + 1
        self.names = options.get("files")

    def _file(self, file: tuple[str, int]) -> list[Frames]:
        name, size = file
        fs, _ = opened(self.path)
        with fs.open_input_file(name) as f:
            head = ser.header(f.read_at(ser.HEADER_BYTES, 0))
        if head["color"] not in COLORS:
            raise ValueError(f"{name}: colour mode {head['color']} is unknown")
        one = frame_bytes(head)
        # A file that was cut holds fewer frames than its header says.
        count = min(head["frames"], (size - ser.HEADER_BYTES) // max(one, 1))
        low, high = max(self.low, 0), min(self.high, count)
        step = max(1, self.part_bytes // max(one, 1))
        return [Frames(name, a, min(a + step, high), head, size) for a in range(low, high, step)]

    def partitions(self) -> list[Frames]:
        fs, where = opened(self.path)
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(".ser") and "/_temporary/" not in x.path]
        files = sorted((x.path, x.size) for x in found if self.names is None or re.fullmatch(self.names, x.path.rsplit("/", 1)[-1]))
        with ThreadPoolExecutor(32) as pool:
            parts = [p for own in pool.map(self._file, files) for p in own]
        # Spark asks for one partition at least.
        return parts or [Frames("", 0, 0, {}, 0)]

    def read(self, part: Frames) -> Iterator[pa.RecordBatch]:
        if part.first >= part.last:
            return
        fs, _ = opened(self.path)
        head, one = part.head, frame_bytes(part.head)
        kind = np.dtype("u1") if head["depth"] <= 8 else np.dtype("<u2") if head["endian"] == 0 else np.dtype(">u2")
        color = COLORS[head["color"]]
        tail = ser.HEADER_BYTES + one * head["frames"]
        with fs.open_input_file(part.path) as f:
            stamped = part.size >= tail + 8 * head["frames"]
            step = max(1, BATCH_BYTES // max(one, 1))
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                raw = np.frombuffer(f.read_at(n * one, ser.HEADER_BYTES + a * one), kind).astype(np.float32)
                ticks = np.frombuffer(f.read_at(8 * n, tail + 8 * a), "<i8") if stamped else np.zeros(n, np.int64)
                values = raw.reshape(n, -1)
                if color == "BGR":
                    values = values.reshape(len(values), -1, 3)[:, :, ::-1].reshape(len(values), -1)
                data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * values.shape[1]), pa.array(np.ascontiguousarray(values).reshape(-1)))
                same = [pa.array([v] * n, t) for v, t in ((head["width"], pa.int32()), (head["height"], pa.int32()), ("RGB" if color == "BGR" else color, pa.string()), (head["depth"], pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n, pa.string()), pa.array(np.arange(a, a + n), pa.int32()), *same, pa.array(ticks, pa.int64()), data], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class SerWriter(DataSourceWriter):
    """Frames as SER files of up to partBytes bytes each: every task writes its own, and a commit puts them all in place."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.run = uuid.uuid4().hex

    def _segment(self, fs: pafs.FileSystem, where: str, rows: list) -> tuple[str, str]:
        first = rows[0]
        number = {v: k for k, v in COLORS.items()}[first.color or "MONO"]
        n, depth = len(rows), first.depth or 16
        head = struct.pack(ser.HEADER, b"LUCAM-RECORDER", 0, number, 0, first.width, first.height, depth, n, b"", b"", b"", 0, 0)
        planes = 3 if number >= 100 else 1
        kind, top = ("<u2", 65535) if depth > 8 else ("u1", 255)
        stem = (first.path or "video").rstrip("/").rsplit("/", 1)[-1].removesuffix(".ser")
        name = f"{stem}-{first.frame_id or 0:08d}-{uuid.uuid4().hex[:8]}.ser"
        own = f"{where}/_temporary/{self.run}/{name}"
        with fs.open_output_stream(own) as f:
            f.write(head)
            for row in rows:
                data = np.asarray(row.data, np.float64)
                if len(data) != first.width * first.height * planes:
                    raise ValueError(f"frame {row.frame_id} of {row.path} has {len(data)} values, not {first.width} x {first.height} x {planes}")
                f.write(np.clip(np.rint(data), 0, top).astype(kind).tobytes())
            if all(row.ticks for row in rows):
                f.write(struct.pack(f"<{n}q", *(row.ticks for row in rows)))
        return own, f"{where}/{name}"

    def write(self, rows: Iterator) -> Written:
        fs, where = opened(self.path)
        fs.create_dir(f"{where}/_temporary/{self.run}", recursive=True)
        files, held, size = [], [], 0
        for row in rows:
            if row.data is None:
                continue
            same = held and (row.path, row.width, row.height, row.color, row.depth) == (held[0].path, held[0].width, held[0].height, held[0].color, held[0].depth)
            if held and (not same or size >= self.part_bytes):
                files.append(self._segment(fs, where, held))
                held, size = [], 0
            held.append(row)
            size += len(row.data) * (2 if (row.depth or 16) > 8 else 1)
        if held:
            files.append(self._segment(fs, where, held))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = opened(self.path)
        before = []
        if self.overwrite and fs.get_file_info(where).type == pafs.FileType.Directory:
            before = [x.path for x in fs.get_file_info(pafs.FileSelector(where)) if x.path.endswith(".ser")]
        fs.create_dir(where, recursive=True)
        for message in messages:
            for own, name in message.files if message else []:
                fs.move(own, name)
        for path in before:
            fs.delete_file(path)
        self._clear(fs, where)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, fs: pafs.FileSystem, where: str) -> None:
        own = f"{where}/_temporary"
        if fs.get_file_info(f"{own}/{self.run}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{own}/{self.run}")
        if fs.get_file_info(own).type == pafs.FileType.Directory and not fs.get_file_info(pafs.FileSelector(own)):
            fs.delete_dir(own)


class SerSource(DataSource):
    """Options: path; partBytes, the bytes of frames that a partition reads or a file holds; first and last, the frames of each file that are read; files, a pattern of the whole names of files that are."""

    @classmethod
    def name(cls) -> str:
        return "ser"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SerReader:
        return SerReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> SerWriter:
        return SerWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def frames(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, first: int = 0, last: int | None = None, files: str | None = None) -> DataFrame:
    """SCHEMA and ts of the videos at a path, planned by byte ranges: of each file the frames from first to last, of files whose whole name matches a pattern."""
    spark.dataSource.register(SerSource)
    options = {"partBytes": part_bytes, "first": first, "last": last, "files": files}
    return spark.read.format("ser").options(**{k: str(v) for k, v in options.items() if v is not None}).load(path).withColumn("ts", ticks_to_timestamp(F.col("ticks")))


def save(videos: DataFrame, path: str, part_bytes: int = PART_BYTES, overwrite: bool = False) -> None:
    """Writes frames as SER files of about part_bytes, those of a video in the order of frame_id."""
    spark = videos.sparkSession
    spark.dataSource.register(SerSource)
    kinds = {c.split(" ")[0]: c.split(" ")[1] for c in SCHEMA.split(", ")}
    defaults = {"color": F.lit("MONO"), "depth": F.lit(16), "ticks": F.lit(0)}
    own = videos.select(*((F.coalesce(F.col(c), defaults[c]) if c in videos.columns and c in defaults else defaults[c] if c in defaults else F.col(c)).cast(t).alias(c) for c, t in kinds.items()))
    dealt = own.repartitionByRange("path", "frame_id").sortWithinPartitions("path", "frame_id")
    dealt.write.format("ser").option("partBytes", str(part_bytes)).mode("overwrite" if overwrite else "append").save(path)


def rgb(videos: DataFrame) -> DataFrame:
    """(path, frame_id, y, x, r, g, b) of the frames of SCHEMA: colour frames by their planes, Bayer frames demosaiced, mono frames grey.

    Patterns of complementary colours have no red, green and blue, and raise an error.
    """
    keyed = videos.withColumn("image_id", F.xxhash64("path", "frame_id"))
    names = keyed.select("image_id", "path", "frame_id")
    bad = F.col("color").isin("CYYM", "YCMY", "YMCY")
    keyed = keyed.withColumn("color", F.when(bad, F.raise_error(F.concat(F.lit("no red, green and blue in "), F.col("color")))).otherwise(F.col("color")))
    cells = keyed.select("image_id", "color", "width", F.posexplode("data").alias("i", "v"))
    planes = cells.filter("color = 'RGB'").withColumn("p", F.expr("i div 3")).groupBy("image_id", F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"))
    parts = [planes.agg(*(F.max(F.when(F.col("i") % 3 == k, F.col("v").cast("double"))).alias(c) for k, c in enumerate("rgb")))]
    grey = to_pixels(keyed.filter("color = 'MONO'").select("image_id", "width", "height", "data")).withColumn("v", F.col("v").cast("double"))
    parts.append(grey.select("image_id", "y", "x", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b")))
    for pattern in ("RGGB", "GRBG", "GBRG", "BGGR"):
        own = to_pixels(keyed.filter(F.col("color") == pattern).select("image_id", "width", "height", "data")).withColumn("v", F.col("v").cast("double"))
        parts.append(compose.demosaic(own, pattern))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return names.join(out, "image_id").drop("image_id")


def trimmed(videos: DataFrame, fits: DataFrame, up: int, down: int) -> DataFrame:
    """Mono frames of SCHEMA around a line: up rows above it to down rows below it, between the borders that fits(path, left, right, coefficients) names.

    A row of the new frame lies as far from the line in all columns. Its pixels are means of five places between pixels, half a row apart, weighted by
    a Gaussian of one row; rows beyond the edges repeat them. Frames without a fit are left out; colour frames raise an error.
    """
    reach = np.arange(-1.0, 1.01, 0.5)
    weights = np.exp(-0.5 * reach**2)
    weights /= weights.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["color"] in ("RGB", "BGR"):
                    raise ValueError("colour frames have no line to be trimmed to")
                image = np.array(row["data"], float).reshape(row["height"], row["width"])
                left, right = row["left"] or 0, row["width"] - 1 if row["right"] is None else row["right"]
                x = np.arange(left, right + 1)
                line = np.polynomial.polynomial.polyval(x, row["coefficients"])
                y = line[None, :] - up + np.arange(up + down + 1)[:, None]
                out = np.zeros(y.shape)
                for d, w in zip(reach, weights, strict=True):
                    at = np.clip(y + d, 0, row["height"] - 1)
                    low = np.floor(at).astype(int)
                    high, part = np.minimum(low + 1, row["height"] - 1), at - low
                    out += w * ((1 - part) * image[low, x] + part * image[high, x])
                values = {"path": row["path"], "frame_id": row["frame_id"], "width": len(x), "height": up + down + 1, "color": row["color"], "depth": row["depth"], "ticks": row["ticks"], "data": out.ravel().astype(np.float32)}
                yield pa.RecordBatch.from_pylist([values], schema=ARROW)

    own = videos.join(fits.select("path", "left", "right", "coefficients").filter("coefficients is not null"), "path")
    return own.select("path", "frame_id", "width", "height", "color", "depth", "ticks", "data", "left", "right", "coefficients").filter("data is not null").mapInArrow(run, SCHEMA)
