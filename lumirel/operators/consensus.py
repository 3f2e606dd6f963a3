"""Where the images of a list truly lie: displacements between neighbours, brought into agreement, and references made of them.

Images of a list are numbered in their order and compared with the next few only, so links grow with the images. Runs of
consecutive images go to a task together with the few that follow them, each image once and a little more. Positions
are those that agree best with all links, by least squares: exactly within segments of bounded size, then between
segments by what the links across say.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import to_images, to_pixels
from ..sources.tables import written
from . import kernels, lists, stencil

#: Images that a task compares with each other and with those that follow.
RUN = 8
#: Images whose positions are solved for at once.
SEGMENT = 512
MODES = ("first", "average", "median", "eccentricity", "sharpness", "manual", "consensus")
#: What an image without an ellipse is taken to have.
UNKNOWN_ECCENTRICITY = 0.99


def numbered(df: DataFrame, key: str, order: list[str], name: str = "r") -> DataFrame:
    """df with a column that numbers the rows of each key from 0 in their order, without a window over a whole key.

    Rows are dealt by ranges of (key, order); a row's number is its place in its part and the key's rows in parts before.
    """
    dealt = written(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_p"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1
    own = dealt.withColumn("_place", place).join(counts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_p")))
    return own.withColumn(name, (F.col("_place") + F.col("_before")).cast("long")).drop("_part", "_place", "_key", "_p", "_before")


def links(images: DataFrame, key: str = "grp", neighbours: int = 3, run: int = RUN) -> DataFrame:
    """(key, a, b, dy, dx, w) for images(key, r, width, height, data): how far image b is moved against image a, for the neighbours next images b of each image a.

    r numbers the images of a key (see numbered); w is the height of the correlation's peak. Images of another size than their
    partner's, flat ones and those without data have no links.
    """
    first = F.floor(F.col("r") / run)
    runs = F.when((F.col("r") % run < neighbours) & (F.col("r") >= run), F.array(first - 1, first)).otherwise(F.array(first))
    dealt = images.filter("data is not null and width * height = size(data)").select(key, "r", "width", "height", "data", F.explode(runs).alias("_run"))
    kind = images.schema[key].dataType.simpleString()

    def one(_: tuple, table: pa.Table) -> pa.Table:
        own = sorted(zip(table.column("r").to_pylist(), range(table.num_rows), strict=True))
        start = table.column("_run")[0].as_py() * run
        spectra: dict[int, np.ndarray | None] = {}

        def spectrum(i: int) -> np.ndarray | None:
            if i not in spectra:
                data = table.column("data")[i].values.to_numpy(zero_copy_only=False)
                h, w = table.column("height")[i].as_py(), table.column("width")[i].as_py()
                fine = bool(np.isfinite(data).all()) and np.ptp(data) > 0
                spectra[i] = kernels.spectrum(data.reshape(h, w)) if fine else None
            return spectra[i]

        rows = []
        for r, i in own:
            if r >= start + run:
                break
            for s, j in own:
                if r < s <= r + neighbours:
                    a, b = spectrum(i), spectrum(j)
                    if a is not None and b is not None and a.shape == b.shape:
                        rows.append((r, s, *kernels.spectral_shift(b, a)))
            spectra.pop(i, None)
        cols = list(zip(*rows, strict=True)) or [()] * 5
        keys = table.column(key).combine_chunks().take(pa.array([0] * len(rows), pa.int64()))
        out = [keys, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True))]
        return pa.Table.from_arrays(out, names=[key, "a", "b", "dy", "dx", "w"])

    return dealt.groupBy(key, "_run").applyInArrow(one, f"{key} {kind}, a long, b long, dy double, dx double, w double").filter("w > 0")


def _solved(pdf: pd.DataFrame) -> np.ndarray:
    """Positions (n, 2) of nodes 0..n-1 that agree best with links (a, b, dy, dx, w); each part without links to others has mean 0."""
    a, b, w = (pdf[c].to_numpy() for c in ("a", "b", "w"))
    n = int(max(a.max(), b.max())) + 1
    m = np.zeros((n, n))
    np.add.at(m, (a, a), w)
    np.add.at(m, (b, b), w)
    np.add.at(m, (a, b), -w)
    np.add.at(m, (b, a), -w)
    right = np.zeros((n, 2))
    d = pdf[["dy", "dx"]].to_numpy() * w[:, None]
    np.add.at(right, b, d)
    np.add.at(right, a, -d)
    return np.linalg.lstsq(m, right, rcond=1e-10)[0]


def _positions(own: DataFrame, key: str, segment: int) -> DataFrame:
    kind = own.schema[key].dataType.simpleString()
    seg = own.withColumn("_sa", F.floor(F.col("a") / segment)).withColumn("_sb", F.floor(F.col("b") / segment))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        base = int(pdf._sa.iloc[0]) * segment
        at = pdf.assign(a=pdf.a - base, b=pdf.b - base)
        used = np.unique(np.r_[at.a, at.b])
        p = _solved(at)[used]
        return pd.DataFrame({key: pdf[key].iloc[0], "r": used + base, "dy": p[:, 0], "dx": p[:, 1]})

    within = written(seg.filter("_sa = _sb").groupBy(key, "_sa").applyInPandas(one, f"{key} {kind}, r long, dy double, dx double"), "positions")
    # Links across say how segments lie to each other; a node that has only such links starts at 0.
    across = seg.filter("_sa <> _sb")
    p, q = (within.select(F.col(key).alias("_k"), F.col("r").alias(c), F.col("dy").alias(f"_{c}y"), F.col("dx").alias(f"_{c}x")) for c in ("a", "b"))
    for side, other in (("a", p), ("b", q)):
        across = across.join(other, F.col(key).eqNullSafe(other["_k"]) & (across[side] == other[side]), "left").drop(other[side]).drop("_k")
    y, x = (F.sum(F.col("w") * (F.col(f"d{c}") - F.coalesce(f"_b{c}", F.lit(0.0)) + F.coalesce(f"_a{c}", F.lit(0.0)))) / F.sum("w") for c in ("y", "x"))
    steps = across.groupBy(key, "_sb").agg(y.alias("y"), x.alias("x"))
    w = Window.partitionBy(key).orderBy("_sb")
    moved = steps.select(F.col(key).alias("_k"), "_sb", F.sum("y").over(w).alias("_ty"), F.sum("x").over(w).alias("_tx"), F.lead("_sb").over(w).alias("_next"))
    nodes = own.select(key, F.col("a").alias("r")).union(own.select(key, F.col("b").alias("r"))).distinct()
    local = within.select(F.col(key).alias("_k"), F.col("r").alias("_r"), "dy", "dx")
    nodes = nodes.join(local, F.col(key).eqNullSafe(F.col("_k")) & (F.col("r") == F.col("_r")), "left").drop("_k", "_r").withColumn("_s", F.floor(F.col("r") / segment))
    # A segment that no link reaches lies as the one before it.
    last = moved.select("_k", F.explode(F.sequence("_sb", F.coalesce(F.col("_next") - 1, F.col("_sb")))).alias("_q"), "_ty", "_tx")
    nodes = nodes.join(last, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_q")), "left")
    return nodes.select(key, "r", *((F.coalesce(f"d{c}", F.lit(0.0)) + F.coalesce(f"_t{c}", F.lit(0.0))).alias(f"d{c}") for c in ("y", "x")))


def synchronised(found: DataFrame, key: str = "grp", rounds: int = 2, softness: float = 0.5, segment: int = SEGMENT) -> DataFrame:
    """(key, r, dy, dx): positions of the images that agree best with links(key, a, b, dy, dx, w), with mean 0 over each key.

    After a first round by the links' own weights, links that disagree by e pixels count 1 / (1 + (e / softness)^2) as much.
    Links whose ends are no more than a segment apart are solved by least squares within segments of bounded size; what lies
    between segments is the mean of the links across. Consistent links are met exactly.
    """
    own = written(found.select(key, "a", "b", "dy", "dx", "w"), "links")
    at = own
    for turn in range(rounds):
        where = written(_positions(at, key, segment), "positions")
        if turn + 1 == rounds:
            break
        p, q = (where.select(F.col(key).alias("_k"), F.col("r").alias("_r"), F.col("dy").alias(f"_{c}y"), F.col("dx").alias(f"_{c}x")) for c in ("a", "b"))
        near = own.join(p, F.col(key).eqNullSafe(p["_k"]) & (F.col("a") == p["_r"])).drop("_k", "_r").join(q, F.col(key).eqNullSafe(q["_k"]) & (F.col("b") == q["_r"])).drop("_k", "_r")
        off = F.hypot(F.col("dy") - F.col("_by") + F.col("_ay"), F.col("dx") - F.col("_bx") + F.col("_ax")) / softness
        at = written(near.select(key, "a", "b", "dy", "dx", (F.col("w") / (1 + off * off)).alias("w")), "links")
    means = where.groupBy(key).agg(F.avg("dy").alias("_my"), F.avg("dx").alias("_mx")).withColumnRenamed(key, "_k")
    out = where.join(means, F.col(key).eqNullSafe(F.col("_k")))
    return out.select(key, "r", (F.col("dy") - F.col("_my")).alias("dy"), (F.col("dx") - F.col("_mx")).alias("dx"))


def positions(images: DataFrame, key: str = "grp", neighbours: int = 3, rounds: int = 2, run: int = RUN, segment: int = SEGMENT) -> DataFrame:
    """(key, image_id, dy, dx): where each of images(image_id, key, width, height, data) lies against the others of its key, in the order of image_id.

    Images that no link reaches have no row.
    """
    ids = written(numbered(images.select(key, "image_id"), key, ["image_id"]), "numbered")
    own = images.select(F.col("image_id").alias("_id"), "width", "height", "data").join(ids, F.col("_id") == F.col("image_id"))
    found = synchronised(links(own, key, neighbours, run), key, rounds, segment=segment)
    named = ids.select(F.col(key).alias("_k"), F.col("r").alias("_r"), "image_id")
    return found.join(named, F.col(key).eqNullSafe(F.col("_k")) & (F.col("r") == F.col("_r"))).select(key, "image_id", "dy", "dx")


def moved(images: DataFrame, where: DataFrame) -> DataFrame:
    """Dense images moved back by their positions (image_id, dy, dx), sampled bicubically; images without one stay."""

    def kernel(stack: np.ndarray, dy: float | None, dx: float | None) -> np.ndarray:
        if dy is None or dx is None:
            return stack
        y, x = np.indices(stack.shape[1:]).astype(float)
        return np.stack([kernels.sample(image, y + dy, x + dx) for image in stack])

    return kernels.per_stack(images.join(where.select("image_id", "dy", "dx"), "image_id", "left"), kernel, ("dy", "dx"))


def consensus(images: DataFrame, key: str = "grp", neighbours: int = 3, rounds: int = 2) -> DataFrame:
    """(key, y, x, v): the mean of each key's images where they agree to lie: no image's own distortion is the reference's."""
    where = positions(images, key, neighbours, rounds)
    still = moved(images, where).join(images.select(F.col("image_id").alias("_id"), key), F.col("image_id") == F.col("_id")).drop("_id")
    return to_pixels(still).groupBy(key, "y", "x").agg(F.avg("v").alias("v"))


def references(images: DataFrame, mode: str, key: str = "grp", manual: DataFrame | None = None) -> DataFrame:
    """(key, y, x, v): a reference image for each key of images(image_id, key, width, height, data), by one of MODES.

    first: the image of the smallest id; average and median: of all, pixel by pixel; sharpness: the sharpest; eccentricity: that whose fitted
    ellipse is roundest (without one, UNKNOWN_ECCENTRICITY); manual: those of manual(image_id), the sharpest where a key has none there;
    consensus: see consensus. Ties go to the smallest id.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "consensus":
        return consensus(images, key)
    px = to_pixels(images.select("image_id", key, "width", "height", "data"))
    if mode in ("average", "median"):
        return px.groupBy(key, "y", "x").agg((F.avg if mode == "average" else F.median)("v").alias("v"))
    ids = images.select("image_id", key)
    if mode == "first":
        chosen = ids.groupBy(key).agg(F.min("image_id").alias("image_id"))
    elif mode == "eccentricity":
        round_ = F.sqrt(1 - F.pow(F.least("rx", "ry") / F.greatest("rx", "ry"), F.lit(2)))
        found = kernels.ellipse_fit(images).select("image_id", round_.alias("e"))
        scores = ids.join(found, "image_id", "left").withColumn("e", F.coalesce("e", F.lit(UNKNOWN_ECCENTRICITY)))
        chosen = lists.reference_image(scores, "e", key, most=False)
    else:
        scores = stencil.sharpness(px.select("image_id", "y", "x", "v")).join(ids, "image_id")
        chosen = lists.reference_image(scores, "sharpness", key)
        if mode == "manual" and manual is not None:
            wanted = ids.join(manual.select("image_id").distinct(), "image_id", "left_semi").groupBy(key).agg(F.min("image_id").alias("image_id"))
            chosen = wanted.unionByName(chosen.join(wanted.select(key), key, "left_anti"))
    return px.join(chosen.select("image_id"), "image_id", "left_semi").select(key, "y", "x", "v")


def reference_images(images: DataFrame, mode: str, key: str = "grp", manual: DataFrame | None = None) -> DataFrame:
    """references as dense images: (key, width, height, data)."""
    px = references(images, mode, key, manual).withColumnRenamed(key, "image_id")
    return to_images(px).withColumnRenamed("image_id", key)
