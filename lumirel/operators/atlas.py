"""Search of line profiles in a long reference spectrum, by normalised cross-correlation at all places.

The reference is an array relation (pos, v) of any length. It is cut into blocks that overlap by what a profile needs, and
profiles are dealt into packs; a task correlates one pack with one block by FFT and gives, for each profile, its best peaks there. Blocks and
packs meet by an equi-join of their numbers, so no row stands for a profile and a place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the reference that a task looks at, and profiles that it correlates.
BLOCK = 1 << 16
PACK = 256
#: Values of an FFT that are held at once.
HELD = 1 << 20
LEAST_SCORE = 0.70
LEAST_MARGIN = 0.30


def broadened(v: np.ndarray, sigma: float) -> np.ndarray:
    """Values smoothed by a Gaussian, ends repeated; sigma 0 leaves them."""
    if sigma <= 0:
        return v
    r = int(np.ceil(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(v, r, mode="edge"), k / k.sum(), "valid")


def correlations(profiles: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Pearson's correlation of each profile with each stretch of the values; -2 where a stretch is flat or has gaps, or the profile is flat."""
    m = profiles.shape[1]
    n = len(values) - m + 1
    out = np.full((len(profiles), max(n, 0)), -2.0)
    gap = ~np.isfinite(values)
    if n <= 0 or gap.all():
        return out
    # What all values share would cost digits.
    own = np.where(gap, 0.0, values - values[~gap].mean())

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.r_[0.0, np.cumsum(x)]
        return total[m:] - total[:-m]

    spread = sums(own * own) - sums(own) ** 2 / m
    flat = profiles - profiles.mean(1, keepdims=True)
    norms = np.sqrt((flat * flat).sum(1))
    scale = max(float(np.abs(own).max()), 1e-300) ** 2 * m
    good = (sums(gap.astype(float)) < 0.5) & (spread > 1e-12 * scale)
    size = 1 << int(np.ceil(np.log2(len(values) + m)))
    spectrum = np.fft.rfft(own, size)
    step = max(1, HELD // size)
    for a in range(0, len(profiles), step):
        part = np.fft.irfft(spectrum * np.conj(np.fft.rfft(flat[a : a + step], size, axis=1)), size, axis=1)[:, :n]
        known = norms[a : a + step, None] > 0
        with np.errstate(all="ignore"):
            score = part / (norms[a : a + step, None] * np.sqrt(np.where(good, spread, 1.0)))
        out[a : a + step] = np.where(known & good, np.clip(score, -1, 1), -2.0)
    return out


def peaks(scores: np.ndarray, apart: int) -> np.ndarray:
    """Whether each score is the best of those less than apart places away; of equal ones the first is."""
    width = 2 * (apart - 1) + 1
    padded = np.pad(scores, ((0, 0), (apart - 1, apart - 1)), constant_values=-3.0)
    best = np.full(scores.shape, -3.0)
    before = np.full(scores.shape, -3.0)
    for k in range(width):
        if k < apart - 1:
            np.maximum(before, padded[:, k : k + scores.shape[1]], out=before)
        np.maximum(best, padded[:, k : k + scores.shape[1]], out=best)
    return (scores >= best) & (scores > before) & (scores > -2)


def search(profiles: DataFrame, atlas: DataFrame, top: int = 3, apart: int = 8, sigmas: tuple[float, ...] = (0.0,), strides: tuple[int, ...] = (1,), key: str = "image_id", block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """(key, rank, pos, score, sigma, stride): the top places of atlas(pos, v) for each profile(key, y, v), by correlation, best first.

    pos is where the profile's first value lies. A place counts if it is the best of those less than apart places away, under its
    broadening and stride; of equal places of several broadenings or strides the best is kept. sigmas are Gaussian broadenings of the atlas in
    places, strides how many places a step of the profile covers. Positions of the atlas that are missing or null are gaps: no
    stretch over a gap is compared. Profiles with missing or null rows, of fewer than 3 rows or of one value have no places.
    """
    ends = profiles.filter("v is not null and not isnan(v)").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("first"), F.max("y").alias("last"))
    fine = ends.filter("n >= 3 and n = last - first + 1").select(key, "n")
    arrays = profiles.join(fine, key).groupBy(key, "n").agg(F.sort_array(F.collect_list(F.struct("y", "v")))["v"].cast("array<double>").alias("profile"))
    arrays = arrays.filter(F.size("profile") == F.col("n"))
    size = arrays.agg(F.count(F.lit(1)).alias("n"), F.max("n").alias("most")).first()
    span = atlas.agg(F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    kind = profiles.schema[key].dataType.simpleString()
    found = f"{key} {kind}, pos long, score double, sigma double, stride int"
    if not size.n or span.low is None:
        return profiles.sparkSession.createDataFrame([], f"{key} {kind}, rank int, pos long, score double, sigma double, stride int")
    # What a block has behind its last place, and before its first one.
    behind = size.most * max(strides) + int(np.ceil(3 * max(sigmas))) + apart * max(strides)
    before = apart * max(strides) + int(np.ceil(3 * max(sigmas)))
    blocks, packs = (span.high - span.low) // block + 1, -(-size.n // pack)
    low = span.low

    def reach(side: int) -> Column:
        return F.floor((F.col("pos") - low + side) / block)

    cells = atlas.filter("pos is not null").select("pos", F.col("v").cast("double").alias("v"), F.explode(F.sequence(F.greatest(reach(-behind), F.lit(0)), F.least(reach(before), F.lit(blocks - 1)))).alias("block"))
    pieces = cells.groupBy("block").agg(F.collect_list("pos").alias("places"), F.collect_list(F.coalesce("v", F.lit(float("nan")))).alias("values"))
    right = pieces.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(int(packs) - 1)))).withColumn("block", F.col("block").cast("int"))
    left = arrays.select(key, "profile", F.pmod(F.xxhash64(key), F.lit(packs)).cast("int").alias("pack")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks) - 1))))

    def one(own: pa.Table, piece: pa.Table) -> pa.Table:
        out = pa.schema([pa.field(key, own.schema.field(key).type), pa.field("pos", pa.int64()), pa.field("score", pa.float64()), pa.field("sigma", pa.float64()), pa.field("stride", pa.int32())])
        if not own.num_rows or not piece.num_rows:
            return out.empty_table()
        start = piece.column("block")[0].as_py() * block + low
        values = np.full(before + block + behind, np.nan)
        values[piece.column("places")[0].values.to_numpy() - (start - before)] = piece.column("values")[0].values.to_numpy(zero_copy_only=False)
        data = own.column("profile").to_pylist()
        rows, places, scores, by_sigma, by_stride = [], [], [], [], []
        for m in sorted({len(x) for x in data}):
            at = np.array([i for i, x in enumerate(data) if len(x) == m])
            matrix = np.array([data[i] for i in at])
            for sigma in sigmas:
                gaps = np.isnan(values)
                wide = np.where(gaps, np.nan, broadened(np.where(gaps, np.nanmean(values) if not gaps.all() else 0.0, values), sigma))
                for stride in strides:
                    score = np.full((len(at), len(values)), -2.0)
                    for phase in range(stride):
                        part = correlations(matrix, wide[phase::stride])
                        score[:, phase : phase + stride * part.shape[1] : stride][:, : part.shape[1]] = part
                    mask = peaks(score, apart)
                    mask[:, :before] = mask[:, before + block :] = False
                    for i, (own_scores, own_mask) in enumerate(zip(score, mask, strict=True)):
                        hits = np.flatnonzero(own_mask)
                        hits = hits[np.lexsort((hits, -own_scores[hits]))][:top]
                        rows += [int(at[i])] * len(hits)
                        places += (hits + start - before).tolist()
                        scores += own_scores[hits].tolist()
                        by_sigma += [sigma] * len(hits)
                        by_stride += [stride] * len(hits)
        return pa.Table.from_arrays([own.column(key).combine_chunks().take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()), pa.array(scores, pa.float64()), pa.array(by_sigma, pa.float64()), pa.array(by_stride, pa.int32())], schema=out)

    hits = left.groupBy("block", "pack").cogroup(right.groupBy("block", "pack")).applyInArrow(one, found)
    best = hits.groupBy(key, "pos").agg(F.max(F.struct("score", F.negative("sigma").alias("s"), F.negative("stride").alias("t"))).alias("m"))
    own = best.select(key, "pos", "m.score", F.negative("m.s").alias("sigma"), F.negative("m.t").alias("stride"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "pos", "sigma", "stride")
    return own.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(key, "rank", "pos", "score", "sigma", "stride")


def identified(candidates: DataFrame, apart: int = 8, least_score: float = LEAST_SCORE, least_margin: float = LEAST_MARGIN, key: str = "image_id") -> DataFrame:
    """(key, pos, score, margin, sigma, stride): the best candidate of each profile (see search), if it wins clearly.

    Its score is least_score or more, and there is another candidate apart places away or more, over the best of which its lead is least_margin
    or more of what was left to 1. Where nothing was found elsewhere nothing is known of the lead, and the profile has no row.
    """
    first = candidates.filter("rank = 1").select(key, F.col("pos").alias("_pos"), F.col("score").alias("_score"), F.col("sigma").alias("_sigma"), F.col("stride").alias("_stride"))
    others = candidates.join(first, key).filter(F.abs(F.col("pos") - F.col("_pos")) >= apart)
    second = others.groupBy(key, "_pos", "_score", "_sigma", "_stride").agg(F.max("score").alias("_next"))
    margin = (F.col("_score") - F.col("_next")) / F.greatest(1 - F.col("_next"), F.lit(1e-9))
    out = second.select(key, F.col("_pos").alias("pos"), F.col("_score").alias("score"), margin.alias("margin"), F.col("_sigma").alias("sigma"), F.col("_stride").alias("stride"))
    return out.filter((F.col("score") >= least_score) & (F.col("margin") >= least_margin))
