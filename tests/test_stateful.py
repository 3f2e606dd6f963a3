"""Stateful streams give the batch result when rows are shuffled within the watermark, and leave late rows out."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumirel.streaming import stateful

START = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, side int, ts timestamp"


def rows(n=120, keys="ab", step=20):
    rng = random.Random(4)
    return [(i, rng.choice(keys), rng.randrange(2), START + dt.timedelta(seconds=step * i + rng.randrange(step))) for i in range(n)]


def streamed(spark, tmp_path, parts, made, name):
    """The rows that a query made of a stream gives for batches of rows, one file each, and a last row that ends all waiting."""
    source = tmp_path / f"in-{name}"
    before = spark.conf.get(stateful.STORE[0], None)
    spark.conf.set(*stateful.STORE)
    try:
        source.mkdir()
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(source))
        q = made(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        for part in [*parts, [(10**6, "end", 0, START + dt.timedelta(days=9))], [(10**6 + 1, "end", 0, START + dt.timedelta(days=9))]]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
            q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(name).collect() if r[0] != "end"]
    finally:
        spark.conf.unset(stateful.STORE[0]) if before is None else spark.conf.set(stateful.STORE[0], before)


def asof(df):
    return stateful.asof(df.filter("side = 0"), df.filter("side = 1"), "k", "id", late="10 minutes")


def asof_by_force(data):
    out = []
    for i, k, side, ts in data:
        if side == 0:
            best = max(((t, j) for j, q, s, t in data if s == 1 and q == k and t <= ts), default=None)
            out.append((k, i, best[1] if best else None))
    return sorted(out)


def test_asof_on_a_table(spark):
    data = rows() + [(900, "a", 1, rows()[5][3]), (901, "a", 0, rows()[5][3])]
    df = spark.createDataFrame([*data, (902, None, 0, START), (903, "a", 0, None)], SCHEMA)
    assert sorted(tuple(r)[:3] for r in asof(df).collect()) == asof_by_force(data)


def test_asof_stream_equals_batch_under_shuffled_input(spark, tmp_path):
    data = rows()
    rng = random.Random(5)
    # Within ten minutes, which are thirty rows, any order may come.
    order = sorted(data, key=lambda r: r[0] + rng.randrange(25))
    parts = [order[i : i + 30] for i in range(0, len(order), 30)]
    got = streamed(spark, tmp_path, parts, asof, "asof_shuffled")
    assert sorted(r[:3] for r in got) == asof_by_force(data)


def test_asof_stream_leaves_late_rows_out(spark, tmp_path):
    data = rows(60)
    late = (500, data[0][1], 1, START - dt.timedelta(hours=1))
    got = streamed(spark, tmp_path, [data[:30], data[30:], [late], [(501, data[0][1], 0, START - dt.timedelta(hours=1))]], asof, "asof_late")
    assert sorted(r[:3] for r in got) == asof_by_force(data)


def first(df):
    return stateful.first_within(df, "k", "id", 100_000, late="1 minute")


def test_first_within_on_a_table_and_a_stream(spark, tmp_path):
    data = rows(80)
    want, last = [], {}
    for i, k, _, ts in sorted(data, key=lambda r: (r[3], r[0])):
        if k not in last or (ts - last[k]).total_seconds() > 100:
            last[k] = ts
            want.append((k, i))
    assert sorted(tuple(r)[:2] for r in first(spark.createDataFrame(data, SCHEMA)).collect()) == sorted(want)
    pairs = [(i, f"key{i // 2}", 0, START + dt.timedelta(seconds=20 * i)) for i in range(40)]
    got = streamed(spark, tmp_path, [pairs[i : i + 10] for i in range(0, 40, 10)], first, "first_pairs")
    assert sorted(r[:2] for r in got) == sorted((f"key{i}", 2 * i) for i in range(20))


@pytest.mark.parametrize("late", [True])
def test_windows_leave_late_rows_out(spark, tmp_path, late):
    data = rows(40)
    made = lambda df: df.withWatermark("ts", "5 minutes").groupBy(F.window("ts", "2 minutes")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("w").alias("k"), F.col("window.start").alias("s"), "n")
    got = streamed(spark, tmp_path, [data, [(600, "a", 0, START)], [(601, "a", 0, START)]], made, "late_windows")
    want = {}
    for _, _, _, ts in data:
        s = START + dt.timedelta(seconds=(ts - START).total_seconds() // 120 * 120)
        want[s] = want.get(s, 0) + 1
    assert {r[1]: r[2] for r in got if r[1] < START + dt.timedelta(days=8)} == want
