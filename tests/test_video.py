"""SER videos as a data source: byte ranges, pruning, writing, colours, trimming."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirel.sources import ser, video


def put(path, frames, color=0, depth=16, ticks=None, planes=1):
    n, h, w = frames.shape[:3]
    head = struct.pack(ser.HEADER, b"LUCAM-RECORDER", 0, color, 0, w, h, depth, n, b"", b"", b"", 0, 0)
    with open(path, "wb") as f:
        f.write(head + frames.astype("<u2" if depth > 8 else "u1").tobytes())
        if ticks:
            f.write(struct.pack(f"<{n}q", *ticks))


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 65536, (50, 6, 8))
    put(tmp_path / "a.ser", data, ticks=[638000000000000000 + i * 400000 for i in range(50)])
    put(tmp_path / "b.ser", data[:7] % 256, depth=8)
    return tmp_path, data


def test_frames_come_in_ranges_of_bytes(spark, folder):
    path, data = folder
    got = video.frames(spark, str(path), part_bytes=960)
    # Ten frames a partition of a, all of b in one.
    assert got.rdd.getNumPartitions() == 6
    rows = {(os.path.basename(r.path), r.frame_id): r for r in got.collect()}
    assert len(rows) == 57
    for i in range(50):
        r = rows["a.ser", i]
        assert np.array_equal(np.array(r.data).reshape(6, 8), data[i]) and (r.width, r.height, r.color, r.depth) == (8, 6, "MONO", 16) and r.ticks == 638000000000000000 + i * 400000
    assert rows["b.ser", 3].ticks == 0 and np.array_equal(rows["b.ser", 3].data, data[3].ravel() % 256)
    assert video.frames(spark, str(path / "b.ser")).count() == 7


def test_options_open_only_their_ranges(spark, folder):
    path, _ = folder
    read = lambda **more: video.frames(spark, str(path), part_bytes=96, **more)
    some = read(first=12, last=14)
    assert some.rdd.getNumPartitions() == 3 and sorted(r.frame_id for r in some.collect()) == [12, 13, 14]
    # One query's filter says nothing of the next one's rows.
    assert some.filter("frame_id = 13").count() == 1 and some.count() == 3
    own = read(files=r"b\.ser")
    assert own.rdd.getNumPartitions() == 4 and own.count() == 7
    assert read(first=1000).count() == 0 and read(files="b").count() == 0 and read(first=48, last=10**6).count() == 2
    reader = video.SerReader({"path": str(path), "partbytes": "96", "first": "20", "last": "21"})
    assert [(p.first, p.last) for p in reader.partitions()] == [(20, 21), (21, 22)]


def test_round_trip_in_segments(spark, folder, tmp_path_factory):
    path, data = folder
    out = tmp_path_factory.mktemp("segments") / "x"
    frames = video.frames(spark, str(path), part_bytes=960)
    video.save(frames, str(out), part_bytes=480)
    names = os.listdir(out)
    assert len(names) >= 11 and all(n.endswith(".ser") for n in names)
    back = video.frames(spark, str(out)).collect()
    want = sorted((r.depth, r.ticks, tuple(r.data)) for r in frames.collect())
    assert sorted((r.depth, r.ticks, tuple(r.data)) for r in back) == want
    video.save(frames.filter("depth = 8"), str(out), overwrite=True)
    assert video.frames(spark, str(out)).count() == 7
    bad = frames.filter("depth = 8").withColumn("width", F.lit(5))
    with pytest.raises(Exception, match="has 48 values"):
        video.save(bad, str(out))
    assert video.frames(spark, str(out)).count() == 7 and not [n for n in os.listdir(out) if not n.endswith(".ser")]


def test_colours(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (2, 4, 6, 3))
    put(tmp_path / "rgb.ser", rgb, color=100, depth=8)
    put(tmp_path / "bgr.ser", rgb[..., ::-1], color=101, depth=8)
    y, x = np.indices((6, 6))
    for k, (first, last) in {8: (10, 30), 11: (30, 10)}.items():
        put(tmp_path / f"bayer{k}.ser", np.where((y % 2 == 0) & (x % 2 == 0), first, np.where((y % 2 == 1) & (x % 2 == 1), last, 20))[None], color=k)
    got = {(os.path.basename(r.path), r.frame_id, r.y, r.x): (r.r, r.g, r.b) for r in video.rgb(video.frames(spark, str(tmp_path))).collect()}
    for name in ("rgb.ser", "bgr.ser"):
        assert all(got[name, i, a, b] == tuple(rgb[i, a, b]) for i in range(2) for a in range(4) for b in range(6))
    assert all(got[f"bayer{k}.ser", 0, a, b] == (10, 20, 30) for k in (8, 11) for a in range(6) for b in range(6))
    put(tmp_path / "cyan.ser", rgb[..., 0], color=16)
    with pytest.raises(Exception, match="no red, green and blue"):
        video.rgb(video.frames(spark, str(tmp_path))).collect()


def test_trimmed_to_a_line(spark, tmp_path):
    y, x = np.indices((30, 20)).astype(float)
    line = 10 + 0.3 * x
    put(tmp_path / "a.ser", (1000 + 40 * (y - line)).round()[None])
    frames = video.frames(spark, str(tmp_path))
    fits = spark.createDataFrame([(frames.first().path, 2, 17, [10.0, 0.3])], "path string, left int, right int, coefficients array<double>")
    r = video.trimmed(frames, fits, 3, 4).first()
    got = np.array(r.data).reshape(r.height, r.width)
    assert got.shape == (8, 16) and np.abs(got - (1000 + 40 * (np.arange(8)[:, None] - 3))).max() < 1
    assert video.trimmed(frames, fits.filter("left = 0"), 3, 4).count() == 0


def test_odd_files(spark, tmp_path):
    (tmp_path / "bad.ser").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a SER file"):
        video.frames(spark, str(tmp_path)).count()
    (tmp_path / "bad.ser").unlink()
    assert video.frames(spark, str(tmp_path)).count() == 0
    data = np.arange(4 * 6).reshape(4, 2, 3)
    put(tmp_path / "cut.ser", data)
    whole = (tmp_path / "cut.ser").read_bytes()
    (tmp_path / "cut.ser").write_bytes(whole[:-5])
    assert [r.frame_id for r in video.frames(spark, str(tmp_path)).orderBy("frame_id").collect()] == [0, 1, 2]
