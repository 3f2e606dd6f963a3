"""Panels of one scene put together without given places: overlaps found by correlation, places by least squares, seams blended.

Panels of a key are numbered in their order, and each is compared with the next few, as panels of a scan follow
each other: with `neighbours` of a row and a panel, those beside it and below it are among them. So links grow with the panels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.images import to_pixels
from ..sources.tables import written
from . import compose, consensus

#: The part of a panel that an overlap has at least.
LEAST_OVERLAP = 0.05
LEAST_CONFIDENCE = 0.6


def overlap(a: np.ndarray, b: np.ndarray, least: float = LEAST_OVERLAP) -> tuple[int, int, float] | None:
    """(dy, dx, confidence): where panel b's corner lies in panel a's coordinates, and Pearson's correlation of what both show then; None if nothing is like anything.

    Correlations of the overlaps at all places come from products of transforms: sums of values, squares and products over
    what overlaps. The best place is that whose correlation is furthest from chance, by its size and by how many pixels overlap.
    """
    size = tuple(1 << int(np.ceil(np.log2(p + q))) for p, q in zip(a.shape, b.shape, strict=True))
    a, b = a - a.mean(), b - b.mean()
    one_a, a1, a2 = (np.fft.rfft2(x, size) for x in (np.ones(a.shape), a, a * a))
    one_b, b1, b2 = (np.conj(np.fft.rfft2(x, size)) for x in (np.ones(b.shape), b, b * b))
    n, sa, saa, sb, sbb, sab = (np.fft.irfft2(x, size) for x in (one_a * one_b, a1 * one_b, a2 * one_b, one_a * b1, one_a * b2, a1 * b1))
    n = np.rint(n)
    enough = n >= max(9, least * min(a.size, b.size))
    count = np.maximum(n, 1)
    va, vb = saa - sa * sa / count, sbb - sb * sb / count
    # A flat overlap says nothing.
    enough &= (va > 1e-6 * a.var() * count) & (vb > 1e-6 * b.var() * count)
    if not enough.any():
        return None
    r = np.where(enough, (sab - sa * sb / count) / np.sqrt(np.where(enough, va * vb, 1.0)), -1.0)
    far = np.where(enough, np.arctanh(np.clip(r, -0.9999, 0.9999)) * np.sqrt(count), -np.inf)
    y, x = np.unravel_index(int(np.argmax(far)), size)
    score = float(np.clip(r[y, x], -1, 1))
    return int(y - size[0] if y >= a.shape[0] else y), int(x - size[1] if x >= a.shape[1] else x), score


def overlaps(panels: DataFrame, key: str = "grp", neighbours: int = 4, run: int = consensus.RUN, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(key, a, b, dy, dx, w) for panels(key, r, width, height, data): the place of panel b in the coordinates of panel a, where their overlap agrees.

    Panels without data, flat ones and those that hold nulls have none.
    """
    first = F.floor(F.col("r") / run)
    # The runs before that a panel's partners may lie in.
    runs = F.sequence(F.greatest(F.floor((F.col("r") - neighbours) / run), F.lit(0)), first)
    dealt = panels.filter("data is not null and width * height = size(data)").select(key, "r", "width", "height", "data", F.explode(runs).alias("_run"))
    kind = panels.schema[key].dataType.simpleString()

    def one(_: tuple, table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("r").to_pylist(), range(table.num_rows), strict=True))
        start = table.column("_run")[0].as_py() * run
        images = {}
        for r, i in own:
            data = table.column("data")[i].values.to_numpy(zero_copy_only=False)
            if np.isfinite(data).all() and np.ptp(data) > 0:
                images[r] = data.reshape(table.column("height")[i].as_py(), table.column("width")[i].as_py())
        rows = []
        for r in sorted(images):
            for s in sorted(images):
                if start <= r < start + run and r < s <= r + neighbours:
                    found = overlap(images[r], images[s])
                    if found and found[2] >= least_confidence:
                        rows.append((r, s, float(found[0]), float(found[1]), found[2]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        keys = table.column(key).combine_chunks().take(pa.array([0] * len(rows), pa.int64()))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([keys, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, "a", "b", "dy", "dx", "w"])

    return dealt.groupBy(key, "_run").applyInArrow(one, f"{key} {kind}, a long, b long, dy double, dx double, w double")


def places(panels: DataFrame, key: str = "grp", neighbours: int = 4, rounds: int = 6, run: int = consensus.RUN) -> DataFrame:
    """(key, image_id, top, left): where each of panels(image_id, key, width, height, data) lies on its key's canvas, whose corner is 0, 0.

    Places agree best with all overlaps by least squares, in rounds that weigh links less the more they disagree. Panels
    that overlap no other have no place.
    """
    ids = written(consensus.numbered(panels.select(key, "image_id"), key, ["image_id"]), "numbered")
    own = panels.select(F.col("image_id").alias("_id"), "width", "height", "data").join(ids, F.col("_id") == F.col("image_id"))
    found = consensus.synchronised(overlaps(own, key, neighbours, run), key, rounds, softness=0.5)
    corner = found.groupBy(key).agg(F.min("dy").alias("_y"), F.min("dx").alias("_x")).withColumnRenamed(key, "_k")
    put = found.join(corner, F.col(key).eqNullSafe(F.col("_k"))).select(key, "r", F.round(F.col("dy") - F.col("_y")).cast("int").alias("top"), F.round(F.col("dx") - F.col("_x")).cast("int").alias("left"))
    named = ids.select(F.col(key).alias("_k"), F.col("r").alias("_r"), "image_id")
    return put.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("r") == F.col("_r"))).select(key, "image_id", "top", "left")


def assembled(panels: DataFrame, key: str = "grp", neighbours: int = 4) -> DataFrame:
    """(key, y, x, v): the mosaic of each key's panels; where they overlap, the mean weighted by nearness to a panel's centre, so that no seam is seen."""
    where = written(places(panels, key, neighbours), "places")
    px = to_pixels(panels.select("image_id", "width", "height", "data"))
    return compose.mosaic(px.join(where.select("image_id", key), "image_id"), where.select("image_id", "top", "left"), key)
