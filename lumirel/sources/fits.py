"""FITS images: header cards of 80 characters in blocks of 2880 bytes, then big-endian pixels.

read() takes the files that Spark finds, one row each. FitsSource is a data source: partitions are files of about
partBytes together, a pattern of names decides which are opened, and a writer makes one file for each image and puts all in place when
every task is done.

    spark.dataSource.register(FitsSource)
    spark.read.format("fits").load("/data/images")
    fits.save(images, "/data/out")
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 2880
SCHEMA = "path string, width int, height int, data array<double>, meta map<string,string>"
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}


def parse(content: bytes) -> tuple[dict[str, str], np.ndarray]:
    cards: dict[str, str] = {}
    at = 0
    while "END" not in cards:
        block = content[at : at + BLOCK]
        if len(block) < BLOCK:
            raise ValueError("not a FITS file, or cut")
        at += BLOCK
        for i in range(0, BLOCK, 80):
            card = block[i : i + 80].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                cards["END"] = ""
                break
            if card[8:10] == "= ":
                cards[name] = card[10:].split("/")[0].strip().strip("'").strip()
    width, height = int(cards["NAXIS1"]), int(cards["NAXIS2"])
    raw = np.frombuffer(content, KINDS[int(cards["BITPIX"])], width * height, at).astype(float)
    return cards, (raw * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))).reshape(height, width)[::-1]


def encode(data: np.ndarray, meta: dict[str, str] | None = None) -> bytes:
    """An image as 32-bit floats, bottom row first."""
    cards = ["SIMPLE  =                    T", "BITPIX  =                  -32", "NAXIS   =                    2", f"NAXIS1  = {data.shape[1]:20d}", f"NAXIS2  = {data.shape[0]:20d}"]
    cards += [f"{k[:8]:8s}= '{v}'" for k, v in (meta or {}).items()] + ["END"]
    head = "".join(c.ljust(80) for c in cards).encode("ascii", "replace")
    body = data[::-1].astype(">f4").tobytes()
    return head.ljust(-(-len(head) // BLOCK) * BLOCK) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def read(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of the images in a folder."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch.path, batch.content, strict=True):
                cards, data = parse(content)
                yield pd.DataFrame({"path": [name], "width": [data.shape[1]], "height": [data.shape[0]], "data": [data.ravel()], "meta": [{k: v for k, v in cards.items() if k != "END"}]})

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.fits").load(path).select("path", "content").mapInPandas(decode, SCHEMA)


PART_BYTES = 64 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    paths: list[str]


class FitsReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.names = options.get("files")

    def partitions(self) -> list[Files]:
        fs, where = opened(self.path)
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if x.type == pafs.FileType.File and x.path.endswith(".fits") and "/_temporary/" not in x.path]
        parts, held, size = [], [], 0
        for x in sorted(found, key=lambda x: x.path):
            if self.names is not None and not re.fullmatch(self.names, x.path.rsplit("/", 1)[-1]):
                continue
            if held and size + x.size > self.part_bytes:
                parts.append(Files(held))
                held, size = [], 0
            held.append(x.path)
            size += x.size
        return [*parts, Files(held)]

    def read(self, part: Files) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path in part.paths:
            with fs.open_input_file(path) as f:
                cards, data = parse(f.read())
            yield path, data.shape[1], data.shape[0], data.ravel().tolist(), {k: v for k, v in cards.items() if k != "END"}


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FitsWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        fs, where = opened(self.path)
        own = f"{where}/_temporary/{self.run}"
        fs.create_dir(own, recursive=True)
        files = []
        for row in rows:
            if row.data is None:
                continue
            if len(row.data) != row.width * row.height:
                raise ValueError(f"{row.path} has {len(row.data)} pixels, not {row.width} x {row.height}")
            at = f"{own}/{uuid.uuid4().hex}.fits"
            with fs.open_output_stream(at) as f:
                f.write(encode(np.array(row.data, float).reshape(row.height, row.width), dict(row.meta or {})))
            files.append((at, f"{where}/{row.path.strip('/').removesuffix('.fits')}.fits"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self._clear(fs, where)
            raise ValueError("several images have one path")
        before = {x.path for x in fs.get_file_info(pafs.FileSelector(where, recursive=True)) if x.path.endswith(".fits") and "/_temporary/" not in x.path} if self.overwrite else set()
        for own, name in files:
            fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
            fs.move(own, name)
        for path in before - set(names):
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


class FitsSource(DataSource):
    """Options: path; partBytes, the bytes of files that a partition reads; files, a pattern of the whole names of files that are read."""

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FitsReader:
        return FitsReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> FitsWriter:
        return FitsWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def load(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, files: str | None = None) -> DataFrame:
    """SCHEMA of the images at a path by the data source, of files whose whole name matches a pattern."""
    spark.dataSource.register(FitsSource)
    options = {"partBytes": str(part_bytes)} | ({"files": files} if files is not None else {})
    return spark.read.format("fits").options(**options).load(path)


def save(images: DataFrame, path: str, name: Column | None = None, overwrite: bool = False) -> None:
    """Writes dense images (image_id, width, height, data, and meta if there is one) as 32-bit FITS files under a folder, one for each image.

    name is a file's path within the folder as a Column, image_id if it isn't given; two images of one path raise an error and nothing is put in place. Images
    without data are left out.
    """
    spark = images.sparkSession
    spark.dataSource.register(FitsSource)
    meta = F.col("meta") if "meta" in images.columns else F.lit(None)
    own = images.select((name if name is not None else F.col("image_id")).cast("string").alias("path"), "width", "height", F.col("data").cast("array<double>").alias("data"), meta.cast("map<string,string>").alias("meta"))
    own.write.format("fits").mode("overwrite" if overwrite else "append").save(path)
