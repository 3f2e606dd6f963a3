"""Raw images, file choice, paths, user functions, and the contract of the entry module."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumirel.functions import user
from lumirel.sources import raw
from lumirel.sources.images import images, to_images, to_pixels


def test_raw_round_trip(spark, sf_dir, tmp_path):
    own = images(spark, sf_dir).limit(20)
    raw.save_raw(own, str(tmp_path / "raw"))
    back = raw.load_raw(spark, str(tmp_path / "raw"))
    assert sorted(map(str, back.collect())) == sorted(map(str, own.collect()))


def test_dense_and_long_are_inverse(spark, sf_dir):
    own = images(spark, sf_dir).select("image_id", "width", "height", "data")
    assert to_images(to_pixels(own)).exceptAll(own).count() == 0


def test_files_by_whole_name(spark, tmp_path):
    for n in ("a1.fits", "a2.fits", "b1.ser"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r.name for r in raw.choose_files(spark, str(tmp_path), r"a\d\.fits").collect()) == ["a1.fits", "a2.fits"]
    assert raw.choose_files(spark, str(tmp_path), "a").count() == 0


def test_output_path(spark):
    path = raw.output_path("{day}/{id}.fits", id=F.lit(7), day=F.lit("mon"))
    assert spark.range(1).select(path).first()[0] == "mon/7.fits"


def test_user_functions():
    @user.function
    def Twice(img, times=2):
        return img * times

    assert user.call("twice", 3) == 6 and user.call("TWICE", img=3, times=5) == 15
    assert user.call("twice", [1, 2]) == [2, 4]
    with pytest.raises(TypeError):
        user.call("twice", 3, times=2)
    with pytest.raises(KeyError):
        user.call("thrice", 3)
    with pytest.raises(ValueError):
        user.parameter("x", "CHOICE", ["a", "b"])
    assert user.parameter("2.5", "NUMBER") == 2.5


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 64
    assert set(entry.oracle_sql()) <= set(entry.queries())
