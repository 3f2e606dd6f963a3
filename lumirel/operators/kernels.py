"""Numerically heavy kernels on dense images: (image_id, width, height, data, and what a kernel asks for).

Kernels run on stacks: the images of a batch that agree in size and in the columns that a kernel goes
by are one array, and no pixel is shuffled. Sizes and disks (cx, cy, radius) are columns, so
images of different sizes and disks may be in one relation. An image must fit one task.

Images whose data or size is null give no rows, and so do pairs with such a reference; data that
don't have width times height pixels raise an error that names the image. A null pixel is NaN, and makes NaN of what it takes part in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.images import to_images, to_pixels

DENSE = "image_id long, width int, height int, data array<double>"
DISK = ("cx", "cy", "radius")
PEAK = 65535.0


def with_disk(images: DataFrame, cx: Column | float, cy: Column | float, radius: Column | float) -> DataFrame:
    """images with the columns of a disk, each a number for all images or a Column."""
    return images.withColumns({n: (c if isinstance(c, Column) else F.lit(float(c))).cast("double") for n, c in zip(DISK, (cx, cy, radius), strict=True)})


def _stacks(batch: pa.RecordBatch, by: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:
    """(row numbers, stack, values of by) for the images of a batch that have those in common; images with null data or sizes are left out, and data of another size raise an error."""
    names = ("width", "height", *by)
    keys = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
    groups: dict[tuple, list[int]] = {}
    for i, k in enumerate(keys):
        data = batch.column("data")[i]
        if data.is_valid and None not in k[:2]:
            if len(data) != k[0] * k[1]:
                raise ValueError(f"image {batch.column('image_id')[i].as_py()} has {len(data)} pixels, not {k[0]} x {k[1]}")
            groups.setdefault(k, []).append(i)
    for k, rows in groups.items():
        data = batch.column("data").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield np.array(rows), data.reshape(len(rows), k[1], k[0]), k[2:]


def _dense_batch(ids: pa.Array, stack: np.ndarray) -> pa.RecordBatch:
    n, h, w = stack.shape
    data = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(np.ascontiguousarray(stack, dtype=float).reshape(-1)))
    return pa.RecordBatch.from_arrays([ids, pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()), data], ["image_id", "width", "height", "data"])


def per_stack(images: DataFrame, kernel: Callable, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense images that kernel(stack, *by) makes of stacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stack, values in _stacks(batch, by):
                yield _dense_batch(batch.column("image_id").take(pa.array(rows)), kernel(stack, *values))

    return images.select("image_id", "width", "height", "data", *by).mapInArrow(run, DENSE)


def with_reference(images: DataFrame, reference: DataFrame) -> DataFrame:
    """images with the data of one image as column ref; the reference is limited to one row, so it is bounded.

    An image of another size than the reference raises an error when it is read; one of unknown size has no reference.
    """
    one = reference.select(F.lit(1).alias("_one"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("data").alias("_ref")).limit(1)
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    out = images.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").withColumn("ref", F.when(F.col("width").isNull() | F.col("height").isNull(), None).when(same, F.col("_ref")).otherwise(F.raise_error(F.lit("images must have the same dimensions"))))
    return out.drop("_one", "_w", "_h", "_ref")


def per_pair(images: DataFrame, kernel: Callable, schema: str, names: list[str]) -> DataFrame:
    """Rows that kernel(image, ref) makes of each image and its column ref; dense images if names is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = (batch.column(n).to_pylist() for n in ("width", "height"))
            for i in range(batch.num_rows):
                sizes = [len(batch.column(c)[i]) if batch.column(c)[i].is_valid else None for c in ("data", "ref")]
                if None in (*sizes, w[i], h[i]):
                    continue
                if set(sizes) != {w[i] * h[i]}:
                    raise ValueError(f"image {batch.column('image_id')[i].as_py()} and its reference have {sizes} pixels, not {w[i]} x {h[i]}")
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(h[i], w[i]) for c in ("data", "ref"))
                out = kernel(a, b)
                ids = batch.column("image_id").slice(i, 1)
                if not names:
                    yield _dense_batch(ids, out[None])
                elif out:
                    cols = [pa.array(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([0] * len(out))), *cols], ["image_id", *names])

    return images.select("image_id", "width", "height", "data", "ref").mapInArrow(run, schema)


def _grid(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.indices(stack.shape[1:]).astype(float)


def _basis(x: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray:
    return np.stack([x**i * y**j for i in range(degree + 1) for j in range(degree + 1 - i)], axis=-1)


def poly_fit_2d(images: DataFrame, degree: int = 3) -> DataFrame:
    """Least-squares surface of the pixels within 0.97 radii of the disk, evaluated within the disk and 0 outside.

    The fit is one linear map for all images of a size and disk.
    """

    def kernel(stack: np.ndarray, cx: float, cy: float, radius: float) -> np.ndarray:
        y, x = _grid(stack)
        x, y = (x - cx) / radius, (y - cy) / radius
        r2 = x * x + y * y
        basis = _basis(x, y, degree)
        fit = r2 <= 0.97**2
        surface = (basis @ np.linalg.pinv(basis[fit])) @ stack[:, fit].T
        return np.where(r2 <= 1, np.moveaxis(surface, -1, 0), 0.0)

    return per_stack(images, kernel, DISK)


def _background(stack: np.ndarray, cx: float, cy: float, radius: float, order: int, sigma: float, ridge: float, step: int = 1, ring: tuple[float, float] | None = None) -> np.ndarray:
    y, x = _grid(stack)
    flat = stack.reshape(len(stack), -1)
    r2 = ((x - cx) ** 2 + (y - cy) ** 2) / (radius * radius)
    where = r2 > 1 if ring is None else (r2 >= ring[0] ** 2) & (r2 <= ring[1] ** 2)
    # Below 0 is no light outside of a disk, but may be the background of what a ring was chosen for.
    use = np.broadcast_to((where & (y % step == 0) & (x % step == 0)).reshape(-1), flat.shape) & ((flat > 0) | (ring is not None))
    n = use.sum(axis=1, keepdims=True)
    mean = (flat * use).sum(axis=1, keepdims=True) / np.maximum(n, 1)
    sd = np.sqrt((((flat - mean) ** 2) * use).sum(axis=1, keepdims=True) / np.maximum(n - 1, 1))
    use = use & ((np.abs(flat - mean) <= sigma * sd + 1e-9) | (n <= 2))
    basis = _basis(x / max(x.shape), y / max(y.shape), order).reshape(flat.shape[1], -1)
    left = np.einsum("np,pk,pl->nkl", use.astype(float), basis, basis, optimize=True) + ridge * np.eye(basis.shape[1])
    right = (flat * use) @ basis
    return (np.linalg.solve(left, right[:, :, None])[:, :, 0] @ basis.T).reshape(stack.shape)


def bg_model(images: DataFrame, order: int = 2, sigma: float = 2.5, ridge: float = 1e-6, step: int = 1, ring: tuple[float, float] | None = None) -> DataFrame:
    """Polynomial surface of the background: pixels outside the disk, or in a ring around its centre between two radii of it, on a grid of a step, filtered once by sigma, with a ridge penalty."""
    return per_stack(images, lambda stack, *disk: _background(stack, *disk, order, sigma, ridge, step, ring), DISK)


def neutralize_bg(images: DataFrame, iterations: int = 1, order: int = 2) -> DataFrame:
    """Images less the background's surface, limited at 0, as often as asked for."""

    def kernel(stack: np.ndarray, *disk: float) -> np.ndarray:
        for _ in range(iterations):
            stack = np.maximum(stack - _background(stack, *disk, order, 2.5, 1e-6), 0.0)
        return stack

    return per_stack(images, kernel, DISK)


def equalized(stack: np.ndarray, rows: int, cols: int, tile: int, bins: int, clip: float) -> np.ndarray:
    """Contrast-limited adaptive equalisation of rows by cols tiles: for each pixel the clipped running shares of its value's bin in the four nearest tiles, interpolated between centres.

    One row of tiles is held at a time. Pixels below 0 and unknown ones count nowhere and are NaN.
    """
    n, h, w = stack.shape
    b = np.minimum(np.floor(stack * bins / (PEAK + 1)), bins - 1)
    own = b >= 0
    b = np.where(own, b, 0).astype(int)
    of, tx = np.arange(n)[:, None, None], np.arange(w) // tile
    width = max(cols, -(-w // tile))
    fy, fx = (np.arange(h) + 0.5) / tile - 0.5, (np.arange(w) + 0.5) / tile - 0.5
    wy, wx = fy - np.floor(fy), fx - np.floor(fx)
    out = np.zeros(stack.shape)
    for row in range(rows):
        band = slice(row * tile, (row + 1) * tile)
        place = np.broadcast_to((of * width + tx) * bins, b[:, band].shape) + b[:, band]
        counts = np.bincount(place[own[:, band]], minlength=n * width * bins).reshape(-1, bins)
        total = counts.sum(1, keepdims=True)
        kept = np.minimum(counts, clip * total / bins)
        kept += (total - kept.sum(1, keepdims=True)) / bins
        share = (np.cumsum(kept, axis=1) / np.maximum(total, 1)).reshape(-1)
        for dy in (0, 1):
            at = np.flatnonzero(np.clip(np.floor(fy) + dy, 0, rows - 1) == row)
            for dx in (0, 1):
                weight = (wy if dy else 1 - wy)[at, None] * (wx if dx else 1 - wx)
                near = np.clip(np.floor(fx) + dx, 0, cols - 1).astype(int)
                out[:, at] += weight * share[(of * width + near) * bins + b[:, at]]
    return np.where(own, PEAK * out, np.nan)


def clahe(images: DataFrame, width: int, height: int, tiles: tuple[int, ...], bins: int, clip: float) -> DataFrame:
    """The mean of contrast-limited adaptive equalisations (see equalized) with tiles of several sides."""

    def kernel(stack: np.ndarray) -> np.ndarray:
        return sum(equalized(stack, -(-height // t), -(-width // t), t, bins, clip) for t in tiles) / len(tiles)

    return per_stack(images, kernel)


def convolved(stack: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sums around each pixel, edges repeated."""
    r, q = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(stack, ((0, 0), (r, r), (q, q)), mode="edge")
    h, w = stack.shape[1:]
    return sum(k * padded[:, i : i + h, j : j + w] for i, row in enumerate(kernel.tolist()) for j, k in enumerate(row) if k)


def convolve(images: DataFrame, kernel: list[list[float]], factor: float = 1.0) -> DataFrame:
    """Images convolved with any kernel of odd sides, limited to 0..PEAK."""
    k = np.array(kernel, float) * factor
    return per_stack(images, lambda stack: np.clip(convolved(stack, k), 0, PEAK))


def rl_decon(images: DataFrame, radius: float = 2.5, sigma: float = 2.5, iterations: int = 5) -> DataFrame:
    """Richardson-Lucy deconvolution with a Gaussian point spread."""
    r = int(radius)
    d = np.arange(-r, r + 1)
    psf = np.exp(-(d[:, None] ** 2 + d[None] ** 2) / (2 * (radius / sigma) ** 2))
    psf /= psf.sum()

    def kernel(stack: np.ndarray) -> np.ndarray:
        out = stack
        for _ in range(iterations):
            out = np.clip(out * convolved(stack / (convolved(out, psf) + 1e-6), psf[::-1]), 0, PEAK)
        return out

    return per_stack(images, kernel)


def flat_correction(images: DataFrame, low: float = 0.1, high: float = 0.95, order: int = 2) -> DataFrame:
    """Divides rows by a polynomial over y that is fitted to their means of disk pixels between two percentiles; images whose disk holds no pixel stay."""

    def kernel(stack: np.ndarray, cx: float, cy: float, radius: float) -> np.ndarray:
        y, x = _grid(stack)
        disk = (x - cx) ** 2 + (y - cy) ** 2 <= radius * radius
        if not disk.any():
            return stack
        lo, hi = np.quantile(stack[:, disk], [low, high], axis=1)
        use = disk & (stack >= lo[:, None, None]) & (stack <= hi[:, None, None])
        n = use.sum(axis=2)
        means = (stack * use).sum(axis=2) / np.maximum(n, 1)
        rows = np.arange(stack.shape[1])
        out = np.empty(stack.shape)
        for i, image in enumerate(stack):
            at = np.flatnonzero(n[i])
            fit = np.polyval(np.polyfit(at, means[i][at], min(order, len(at) - 1)), rows)
            out[i] = image / np.maximum(fit / fit.max(), 1e-6)[:, None]
        return out

    return per_stack(images, kernel, DISK)


def fix_banding(pixels: DataFrame, band: int = 3, passes: int = 1) -> DataFrame:
    """Multiplies each row by the mean of the rows around it over its own mean."""
    for _ in range(passes):
        rows = pixels.groupBy("image_id", "y").agg(F.avg("v").alias("_m"))
        around = Window.partitionBy("image_id").orderBy("y").rowsBetween(-band, band)
        ratio = rows.select("image_id", "y", F.when(F.col("_m") > 0, F.avg("_m").over(around) / F.nullif(F.col("_m"), F.lit(0.0))).otherwise(F.lit(1.0)).alias("_f"))
        pixels = pixels.join(ratio, ["image_id", "y"]).withColumn("v", F.col("v") * F.col("_f")).drop("_f")
    return pixels


def column_bg_model(pixels: DataFrame, smoothing: int = 2) -> DataFrame:
    """Median of each column, smoothed over the columns around it."""
    medians = pixels.groupBy("image_id", "x").agg(F.median("v").alias("_m"))
    around = Window.partitionBy("image_id").orderBy("x").rowsBetween(-smoothing, smoothing)
    return pixels.join(medians.select("image_id", "x", F.avg("_m").over(around).alias("_bg")), ["image_id", "x"]).select("image_id", "y", "x", F.col("_bg").alias("v"))


# Ellipses


def _conic(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """The ellipse of least algebraic distance, by the constraint 4ac - b*b = 1; of centred and scaled points."""
    quad, line = np.stack([x * x, x * y, y * y], 1), np.stack([x, y, np.ones(len(x))], 1)
    s1, s2, s3 = quad.T @ quad, quad.T @ line, line.T @ line
    try:
        back = -np.linalg.solve(s3, s2.T)
    except np.linalg.LinAlgError:
        return None
    m = s1 + s2 @ back
    _, vectors = np.linalg.eig(np.stack([m[2] / 2, -m[1], m[0] / 2]))
    vectors = np.real(vectors)
    good = np.flatnonzero(4 * vectors[0] * vectors[2] - vectors[1] ** 2 > 0)
    return np.concatenate([vectors[:, good[0]], back @ vectors[:, good[0]]]) if len(good) else None


def _ellipse(conic: np.ndarray) -> tuple[float, ...] | None:
    """Centre, half axes (the longer first) and the longer one's angle."""
    a, b, c, d, e, f = conic
    centre = np.linalg.solve([[2 * a, b], [b, 2 * c]], [-d, -e])
    level = -(f + (d * centre[0] + e * centre[1]) / 2)
    values, vectors = np.linalg.eigh(np.array([[a, b / 2], [b / 2, c]]) / level)
    if not (values > 0).all():
        return None
    longer = vectors[:, 0]
    return float(centre[0]), float(centre[1]), float(values[0] ** -0.5), float(values[1] ** -0.5), float(np.arctan2(longer[1], longer[0]) % np.pi)


def _fit_ellipse(image: np.ndarray, share: float, sigma: float, rounds: int) -> tuple | None:
    gy, gx = np.gradient(image)
    g = np.hypot(gx, gy)
    y, x = (p.astype(float) for p in np.nonzero(g >= np.quantile(g, 1 - share)))
    found = None
    for _ in range(rounds):
        if len(x) < 6:
            return None
        shift, size = (x.mean(), y.mean()), max(np.ptp(x), np.ptp(y), 1.0) / 2
        conic = _conic((x - shift[0]) / size, (y - shift[1]) / size)
        own = _ellipse(conic) if conic is not None else None
        if own is None:
            return found
        cx, cy, rx, ry, angle = own[0] * size + shift[0], own[1] * size + shift[1], own[2] * size, own[3] * size, own[4]
        found = (cx, cy, rx, ry, angle, len(x))
        u = (x - cx) * np.cos(angle) + (y - cy) * np.sin(angle)
        v = (y - cy) * np.cos(angle) - (x - cx) * np.sin(angle)
        off = np.hypot(u / rx, v / ry) - 1
        keep = np.abs(off - np.median(off)) <= sigma * max(off.std(), 1e-6)
        if keep.all():
            break
        x, y = x[keep], y[keep]
    return found


def ellipse_fit(images: DataFrame, share: float = 0.2, sigma: float = 2.5, rounds: int = 10) -> DataFrame:
    """(image_id, cx, cy, rx, ry, angle, n): an ellipse through the pixels of the strongest gradients, fitted again without outliers.

    A share of the pixels takes part at first; in each round those further than sigma deviations from the
    ellipse go. n are the pixels left. An image through whose edges no ellipse goes gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, stack, _ in _stacks(batch, ()):
                found = [(i, *own) for i, image in zip(batch.column("image_id").take(pa.array(rows)).to_pylist(), stack, strict=True) if (own := _fit_ellipse(image, share, sigma, rounds))]
                cols = list(zip(*found, strict=True)) or [[]] * 7
                kinds = [pa.int64(), *[pa.float64()] * 5, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["image_id", "cx", "cy", "rx", "ry", "angle", "n"])

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id long, cx double, cy double, rx double, ry double, angle double, n long")


# Resampling


def _weights(t: np.ndarray, kind: str) -> tuple[np.ndarray, int]:
    """Weights of the taps around a fraction t, and the first tap's offset."""
    if kind == "bilinear":
        return np.stack([1 - t, t]), 0
    if kind == "bicubic":
        d = np.stack([1 + t, t, 1 - t, 2 - t])
        a = -0.5
        near, far = (a + 2) * d**3 - (a + 3) * d**2 + 1, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        return np.where(d <= 1, near, far), -1
    taps = np.arange(-2, 4)[:, None] - t.reshape(1, -1)
    w = np.sinc(taps) * np.sinc(taps / 3)
    return (w / w.sum(axis=0)).reshape(6, *t.shape), -2


class Sampler:
    """Values of images of a shape at places between pixels, whose weights are found once: bilinear, bicubic (a = -0.5) or lanczos (3 lobes); edges repeated."""

    def __init__(self, shape: tuple[int, int], y: np.ndarray, x: np.ndarray, kind: str = "bicubic"):
        y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
        self.wy, oy = _weights(y - y0, kind)
        self.wx, ox = _weights(x - x0, kind)
        self.rows = [np.clip(y0 + oy + i, 0, shape[0] - 1) for i in range(len(self.wy))]
        self.columns = [np.clip(x0 + ox + j, 0, shape[1] - 1) for j in range(len(self.wx))]

    def __call__(self, image: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows[0].shape)
        for w, row in zip(self.wy, self.rows, strict=True):
            out += w * sum(v * image[row, column] for v, column in zip(self.wx, self.columns, strict=True))
        return out


def sample(image: np.ndarray, y: np.ndarray, x: np.ndarray, kind: str = "bicubic") -> np.ndarray:
    """An image's values at places between pixels, see Sampler."""
    return Sampler(image.shape, y, x, kind)(image)


def resample(images: DataFrame, new_width: int, new_height: int, kind: str = "lanczos") -> DataFrame:
    """Images of another size, centre kept, interpolated by kind and limited to 0..PEAK."""

    def kernel(stack: np.ndarray) -> np.ndarray:
        h, w = stack.shape[1:]
        y, x = np.indices((new_height, new_width)).astype(float)
        y, x = (y - (new_height - 1) / 2) * h / new_height + (h - 1) / 2, (x - (new_width - 1) / 2) * w / new_width + (w - 1) / 2
        return np.clip(np.stack([sample(image, y, x, kind) for image in stack]), 0, PEAK)

    return per_stack(images, kernel)


def fix_geometry(images: DataFrame, ellipses: DataFrame | None = None) -> DataFrame:
    """Images whose disk is round: what the fitted ellipse's axes need to become the longer one, around its centre.

    ellipses(image_id, cx, cy, rx, ry, angle) are those of ellipse_fit where none are given; an image without one stays.
    """
    names = ("cx", "cy", "rx", "ry", "angle")
    found = (ellipse_fit(images) if ellipses is None else ellipses).select("image_id", *names)

    def kernel(stack: np.ndarray, cx: float | None, cy: float, rx: float, ry: float, angle: float) -> np.ndarray:
        if cx is None:
            return stack
        y, x = _grid(stack)
        c, s = np.cos(angle), np.sin(angle)
        u, v = (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s
        u, v = u * rx / max(rx, ry), v * ry / max(rx, ry)
        return np.stack([sample(image, u * s + v * c + cy, u * c - v * s + cx) for image in stack])

    return per_stack(images.drop(*names).join(found, "image_id", "left"), kernel, names)


# Registration


def _peak(corr: np.ndarray) -> tuple[float, float, float]:
    """The place of the largest value, between pixels by a Gaussian through its neighbours, wrapped around zero; and the value."""
    h, w = corr.shape
    y, x = np.unravel_index(int(np.argmax(corr)), corr.shape)
    logs = np.log(np.maximum(corr[np.ix_(np.arange(y - 1, y + 2) % h, np.arange(x - 1, x + 2) % w)], 1e-12))

    def part(a: float, b: float, c: float) -> float:
        bend = a - 2 * b + c
        return float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0

    dy, dx = y + part(*logs[:, 1]), x + part(*logs[1])
    return dy - h if dy > h / 2 else dy, dx - w if dx > w / 2 else dx, float(corr[y, x])


def spectrum(a: np.ndarray) -> np.ndarray:
    """The Fourier transform of an image less its mean, faded out at the edges."""
    window = np.hanning(a.shape[0] + 2)[1:-1, None] * np.hanning(a.shape[1] + 2)[None, 1:-1]
    return np.fft.fft2((a - a.mean()) * window)


def spectral_shift(fa: np.ndarray, fb: np.ndarray) -> tuple[float, float, float]:
    """phase_shift of the images whose spectra these are."""
    cross = np.conj(fb) * fa
    return _peak(np.real(np.fft.ifft2(cross / np.maximum(np.abs(cross), 1e-12))))


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """How far a is moved against b, and the height of the correlation's peak."""
    return spectral_shift(spectrum(a), spectrum(b))


def displacement(images: DataFrame, reference: DataFrame) -> DataFrame:
    """(image_id, dy, dx, confidence): shift of each whole image against one reference image, between pixels, by phase correlation."""
    return per_pair(with_reference(images, reference), lambda a, b: [phase_shift(a, b)], "image_id long, dy double, dx double, confidence double", ["dy", "dx", "confidence"])


def tile_shifts(a: np.ndarray, b: np.ndarray, tile: int, step: int) -> list[tuple[int, int, float, float, float]]:
    """(ty, tx, dy, dx, confidence) of the tiles around a grid of centres; flat tiles have confidence 0."""
    out = []
    for ty in range(tile // 2, max(a.shape[0] - tile // 2, tile // 2 + 1), step):
        for tx in range(tile // 2, max(a.shape[1] - tile // 2, tile // 2 + 1), step):
            own = np.s_[ty - tile // 2 : ty + tile // 2, tx - tile // 2 : tx + tile // 2]
            flat = np.ptp(a[own]) == 0 or np.ptp(b[own]) == 0
            out.append((ty, tx, *((0.0, 0.0, 0.0) if flat else phase_shift(a[own], b[own]))))
    return out


def tile_displacement(images: DataFrame, reference: DataFrame, tile: int = 32, step: int = 16) -> DataFrame:
    """(image_id, ty, tx, dy, dx, confidence): the displacement field of each image against one reference, as measured."""
    return per_pair(with_reference(images, reference), lambda a, b: tile_shifts(a, b, tile, step), "image_id long, ty long, tx long, dy double, dx double, confidence double", ["ty", "tx", "dy", "dx", "confidence"])


def _smooth_field(field: np.ndarray, known: np.ndarray, outlier: float = 3.0) -> np.ndarray:
    """A grid without outliers against the median of their neighbours, gaps filled by distance, then smoothed."""
    h, w = field.shape
    near = np.stack([np.roll(np.pad(np.where(known, field, np.nan), 1, constant_values=np.nan), (i, j), (0, 1))[1:-1, 1:-1] for i in (-1, 0, 1) for j in (-1, 0, 1)])
    with np.errstate(all="ignore"):
        middle = np.where(np.isfinite(near).any(axis=0), np.nanmedian(np.where(np.isfinite(near).any(axis=0), near, 0.0), axis=0), 0.0)
    off = np.abs(field - middle)
    spread = 1.4826 * np.median(off[known]) if known.any() else 0.0
    known = known & (off <= outlier * max(spread, 0.25))
    if not known.any():
        return np.zeros((h, w))
    y, x = np.nonzero(known)
    gy, gx = np.indices((h, w))
    weight = 1 / ((gy[..., None] - y) ** 2 + (gx[..., None] - x) ** 2 + 1e-3) ** 2
    filled = np.where(known, field, (weight * field[known]).sum(-1) / weight.sum(-1))
    soft = np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]) / 16
    return convolved(filled[None], soft)[0]


def dedistorted(a: np.ndarray, b: np.ndarray, tile: int, step: int, rounds: int) -> np.ndarray:
    """a moved onto b by a field of displacements, measured again on what it made while that comes nearer."""
    y, x = np.indices(a.shape).astype(float)
    sy, sx, best, error = y.copy(), x.copy(), a, np.abs(a - b).mean()
    for _ in range(rounds):
        found = tile_shifts(best, b, min(tile, *a.shape), step)
        rows, cols = sorted({t[0] for t in found}), sorted({t[1] for t in found})
        grid = np.array([t[2:] for t in found]).reshape(len(rows), len(cols), 3)
        known = grid[..., 2] > 0
        at_y = np.interp(y[:, 0], rows, np.arange(len(rows)))
        at_x = np.interp(x[0], cols, np.arange(len(cols)))
        fields = [sample(_smooth_field(grid[..., k], known), *np.meshgrid(at_y, at_x, indexing="ij"), "bilinear") for k in (0, 1)]
        ny, nx = sample(sy, y + fields[0], x + fields[1], "bilinear") + 0.0, sample(sx, y + fields[0], x + fields[1], "bilinear") + 0.0
        # At the edges, where no source is known, the field goes on.
        ny, nx = np.where((y + fields[0] < 0) | (y + fields[0] > y[-1, 0]), sy + fields[0], ny), np.where((x + fields[1] < 0) | (x + fields[1] > x[0, -1]), sx + fields[1], nx)
        now = sample(a, ny, nx)
        after = np.abs(now - b).mean()
        if after >= 0.99 * error:
            break
        sy, sx, best, error = ny, nx, now, after
    return best


def dedistort(images: DataFrame, reference: DataFrame, tile: int = 32, step: int = 16, rounds: int = 3) -> DataFrame:
    """Images moved onto one reference image, tile by tile: a measured field without outliers, filled, smoothed and sampled bicubically.

    A round that brings an image less than 1 percent nearer is not taken, so an image that nothing brings nearer stays.
    """
    return per_pair(with_reference(images, reference), lambda a, b: dedistorted(a, b, tile, step, rounds), DENSE, [])


def stack_images(images: DataFrame, reference: DataFrame, key: str = "grp", tile: int = 32, step: int = 16) -> DataFrame:
    """(key, y, x, v): the mean of each key's images after dedistort; partial means combine before their shuffle."""
    moved = dedistort(images, reference, tile, step).join(images.select("image_id", key), "image_id")
    return to_pixels(moved).groupBy(key, "y", "x").agg(F.avg("v").alias("v"))


# Blends


def _halved(stack: np.ndarray) -> np.ndarray:
    k = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16
    return convolved(stack, np.outer(k, k))[:, ::2, ::2]


def _doubled(stack: np.ndarray, h: int, w: int) -> np.ndarray:
    out = np.repeat(np.repeat(stack, 2, axis=1), 2, axis=2)[:, :h, :w]
    k = np.array([1.0, 2.0, 1.0]) / 4
    return convolved(out, np.outer(k, k))


def pyramid_blend(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    """Of two images, level by level of their Laplacian pyramids, the stronger detail; the mean of what is left."""
    a, b, details = a[None], b[None], []
    for _ in range(levels):
        if min(a.shape[1:]) < 4:
            break
        h, w = a.shape[1:]
        small_a, small_b = _halved(a), _halved(b)
        da, db = a - _doubled(small_a, h, w), b - _doubled(small_b, h, w)
        details.append(np.where(np.abs(da) >= np.abs(db), da, db))
        a, b = small_a, small_b
    out = (a + b) / 2
    for d in reversed(details):
        out = _doubled(out, *d.shape[1:]) + d
    return np.clip(out[0], 0, PEAK)


def laplacian_blend(images: DataFrame, others: DataFrame, levels: int = 3) -> DataFrame:
    """Images blended with the image of the same image_id in others, by Laplacian pyramids; sizes must agree."""
    both = images.join(others.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("data").alias("_d")), "image_id")
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h"))
    unknown = F.col("width").isNull() | F.col("height").isNull() | F.col("_w").isNull() | F.col("_h").isNull()
    both = both.withColumn("ref", F.when(unknown, None).when(same, F.col("_d")).otherwise(F.raise_error(F.lit("images must have the same dimensions"))))
    return per_pair(both, lambda a, b: pyramid_blend(a, b, levels), DENSE, [])


def angular_correlation(images: DataFrame, reference: DataFrame, degrees: int = 30, step: float = 1.0) -> DataFrame:
    """(image_id, degrees, score): the rotation at which an image agrees best with one reference within their inscribed circles."""
    angles = np.arange(-degrees, degrees + step / 2, step)

    def best(a: np.ndarray, b: np.ndarray) -> list[tuple[float, float]]:
        h, w = a.shape
        y, x = np.indices(a.shape) - np.array([(h - 1) / 2, (w - 1) / 2]).reshape(2, 1, 1)
        inside = y * y + x * x <= (min(h, w) / 2) ** 2
        want = b[inside] - b[inside].mean()
        scores = []
        for t in np.radians(angles):
            own = sample(a, y * np.cos(t) + x * np.sin(t) + (h - 1) / 2, x * np.cos(t) - y * np.sin(t) + (w - 1) / 2, "bilinear")[inside]
            own = own - own.mean()
            scores.append(float(own @ want / max(np.sqrt((own @ own) * (want @ want)), 1e-12)))
        k = int(np.argmax(scores))
        return [(float(angles[k]), scores[k])]

    return per_pair(with_reference(images, reference), best, "image_id long, degrees double, score double", ["degrees", "score"])


def from_pixels(pixels: DataFrame) -> DataFrame:
    """A pixel relation as dense images, for kernels."""
    return to_images(pixels)
