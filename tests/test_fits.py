"""FITS images as a data source: files by partition, pruning, a writer that commits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumirel.sources import fits
from lumirel.sources.images import images


def test_round_trip_by_the_data_source(spark, sf_dir, tmp_path):
    own = images(spark, sf_dir).filter("image_id < 12").withColumn("meta", F.create_map(F.lit("OBSERVER"), F.concat(F.lit("o"), "grp")))
    out = str(tmp_path / "x")
    fits.save(own, out, F.concat_ws("/", F.concat(F.lit("g"), "grp"), "image_id"))
    back = fits.load(spark, out, part_bytes=3 * 5760)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in back.collect()}
    assert len(rows) == 12 and back.rdd.getNumPartitions() == 4
    for r in own.collect():
        got = rows[f"{r.image_id}.fits"]
        assert np.array_equal(got.data, r.data) and (got.width, got.height) == (8, 8) and got.meta["OBSERVER"] == f"o{r.grp}" and f"/g{r.grp}/" in got.path
    one = rows["3.fits"].path
    assert back.filter(F.col("path") == one).count() == 1 and back.count() == 12
    some = fits.load(spark, out, 5760, r"1\d?\.fits")
    assert some.rdd.getNumPartitions() == 3 and some.count() == 3
    assert sorted(map(str, fits.read(spark, f"{out}/*").select("width", "data").collect())) == sorted(map(str, back.select("width", "data").collect()))
    assert fits.load(spark, one).count() == 1


def test_failed_writes_leave_nothing(spark, sf_dir, tmp_path):
    own, out = images(spark, sf_dir).filter("image_id < 3"), str(tmp_path / "x")
    fits.save(own, out)
    for bad, why in ((own.withColumn("width", F.lit(5)), "pixels, not 5 x 8"), (own.withColumn("image_id", F.lit(7)), "several images have one path")):
        with pytest.raises(Exception, match=why):
            fits.save(bad, out)
        assert sorted(os.listdir(out)) == ["0.fits", "1.fits", "2.fits"]
    fits.save(own.filter("image_id = 1").union(own.filter("image_id = 2").withColumn("data", F.lit(None))), out, overwrite=True)
    assert os.listdir(out) == ["1.fits"]
    fits.save(own.limit(0), str(tmp_path / "none"))
    assert fits.load(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        fits.load(spark, str(tmp_path / "nowhere")).count()
