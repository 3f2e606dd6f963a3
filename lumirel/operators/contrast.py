"""The steps of automatic contrast on stacks of images with a disk: background, local contrast, prominences, brightness."""

from __future__ import annotations

import numpy as np

from ..functions.pixel import PEAK

BINS = 64
#: Sides of tiles and clips of the whole image's local contrast, and of that around the disk.
WHOLE, AROUND = (16, 1.1), (8, 0.8)
#: Sky begins at so many radii for the background, and for what is stretched around the disk.
SKY, LIMB = 1.05, 1.005
SKY_SIGMA, RIDGE = 1.5, 1e-6
#: Shares of local contrast against what is around the disk, and of the background's image against both.
LOCAL, PLAIN = 0.6, 0.8
#: The disk's median is lifted to this, above a floor; there the curve has this slope, which fades out between two depths.
MIDTONE, FLOOR, SLOPE, FADE = 0.45 * PEAK, 0.005 * PEAK, 1.25, (0.85, 1.05)


def _depth(shape: tuple[int, ...], cx: float, cy: float, radius: float) -> np.ndarray:
    """The squared distance from the disk's centre, 1 at the limb."""
    y, x = np.indices(shape[-2:]).astype(float)
    return ((x - cx) ** 2 + (y - cy) ** 2) / (radius * radius)


def _box(shape: tuple[int, ...], cx: float, cy: float, radius: float, last: int) -> np.ndarray:
    """Places of the disk's bounding box, its last row and column included or not."""
    h, w = shape[-2:]
    y, x = np.indices((h, w))
    (x0, x1), (y0, y1) = ((int(max(0, c - radius)), int(min(n - 1, c + radius))) for c, n in ((cx, w), (cy, h)))
    return (x >= x0) & (x < x1 + last) & (y >= y0) & (y < y1 + last)


def without_sky(stack: np.ndarray, cx: float, cy: float, radius: float, bg: float, iterations: int) -> np.ndarray:
    """Images less a share of the sky's surface, again and again while its level falls, on half of the level that is left.

    The surface is of second order through places outside of the disk that are near their mean; bg is the part of it that stays, 1 that nothing is done.
    """
    if bg >= 1:
        return stack
    n, h, w = stack.shape
    y, x = np.indices((h, w)).astype(float)
    step = max(1, max(w, h) // 32)
    at = np.flatnonzero(((_depth(stack.shape, cx, cy, radius * SKY) > 1) & (y % step == 0) & (x % step == 0)).reshape(-1))
    x, y = x.reshape(-1) / max(w - 1, 1), y.reshape(-1) / max(h - 1, 1)
    basis = np.stack([np.ones(h * w), x, y, x * x, x * y, y * y], axis=1)
    out = stack.reshape(n, -1).copy()
    going, found = np.full(n, len(at) > 1), np.zeros(n, bool)
    before, pedestal = np.full(n, np.inf), np.full(n, -1.0)
    for _ in range(iterations):
        own = np.flatnonzero(going)
        if not len(own):
            break
        seen = out[own][:, at]
        mean, sd = seen.mean(1, keepdims=True), seen.std(1, ddof=1, keepdims=True)
        use = (seen > 0) & (seen < mean + SKY_SIGMA * sd) & (seen > mean - SKY_SIGMA * sd)
        left = np.einsum("np,pk,pl->nkl", use.astype(float), basis[at], basis[at], optimize=True) + RIDGE * np.eye(6)
        right = (seen * use) @ basis[at]
        surface = np.clip(np.linalg.solve(left, right[:, :, None])[:, :, 0] @ basis.T, 0, PEAK)
        level = np.where(use.sum(1) >= 6, surface.mean(1), 0.0)
        goes = (level != 0) & (level <= before[own])
        going[own[~goes]] = False
        own, level = own[goes], level[goes]
        out[own] = np.clip(out[own] - (1 - bg) * surface[goes], 0, PEAK)
        before[own] = level
        lower = (pedestal[own] == -1) | (~found[own] & (level < 0.5 * pedestal[own]))
        pedestal[own] = np.where(lower, level, pedestal[own])
        found[own] |= ~lower
    return (out + np.maximum(pedestal, 0)[:, None] / 2).reshape(stack.shape)


def _between(n: int, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place of a side the two tiles whose centres it lies between, and the second one's share; its own tile next to an edge."""
    at, half = np.arange(n), tile // 2
    own, centre = at // tile, at // tile * tile + tile / 2
    first = np.where(at <= centre, own - 1, own)
    edge = (at <= half) | (at >= n - 1 - half)
    share = np.where(edge, 0.0, (at - (first * tile + tile / 2)) / tile)
    return np.where(edge, own, first), np.where(edge, own, first + 1), share


def local_contrast(stack: np.ndarray, tile: int, clip: float) -> np.ndarray:
    """Images whose peak is PEAK, then each value's share of the clipped histogram up to it, interpolated between tiles."""
    n, h, w = stack.shape
    peak = stack.max(axis=(1, 2), keepdims=True)
    b = np.clip(np.floor(stack * np.where(peak == 0, 0.0, PEAK / np.where(peak == 0, 1.0, peak)) * (BINS - 1) / PEAK + 0.5), 0, BINS - 1).astype(int)
    rows, columns = -(-h // tile), -(-w // tile)
    of = np.arange(n)[:, None, None] * rows * columns
    place = of + (np.arange(h) // tile * columns)[:, None] + np.arange(w) // tile
    counts = np.bincount((place * BINS + b).reshape(-1), minlength=n * rows * columns * BINS).reshape(-1, BINS)
    most = (clip * counts.sum(1, keepdims=True) / BINS).astype(int)
    # What is above the clip is dealt to all bins, and the rest of that to the first ones.
    excess = np.maximum(counts - most, 0).sum(1, keepdims=True)
    counts = np.minimum(counts, most) + excess // BINS + (np.arange(BINS) < excess % BINS)
    share = np.cumsum(counts, axis=1) / counts.sum(1, keepdims=True)
    out = np.zeros(stack.shape)
    (y0, y1, wy), (x0, x1, wx) = _between(h, tile), _between(w, tile)
    for ty, sy in ((y0, 1 - wy), (y1, wy)):
        for tx, sx in ((x0, 1 - wx), (x1, wx)):
            out += sy[:, None] * sx * share[of + ty[:, None] * columns + tx, b]
    return PEAK * out


def lifted(stack: np.ndarray, disk: tuple[float, float, float] | None) -> np.ndarray:
    """Images whose disk's median is lifted to MIDTONE by an inverse hyperbolic sine, with more contrast around it on the disk; brighter ones stay."""
    n, pixels = len(stack), stack[0].size
    bins = np.sort(np.clip(np.floor(stack * 65536 / PEAK + 0.5), 0, 65535).reshape(n, -1), axis=1)
    rank = int(pixels * 0.05)
    floor = np.maximum(bins[:, rank - 1] if rank else 0.0, FLOOR) * np.ones(n)
    depth = _depth(stack.shape, *disk) if disk else None
    inside = (depth <= 1) & _box(stack.shape, *disk, 1) if disk else np.ones(stack.shape[1:], bool)
    use = (inside & (stack > floor[:, None, None])).reshape(n, -1)
    seen = np.sort(np.where(use, np.clip(np.floor(stack.reshape(n, -1)), 0, 65535), np.inf), axis=1)
    half = use.sum(1) // 2
    middle = np.where(half > 0, seen[np.arange(n), np.maximum(half - 1, 0)], 0.0)
    own = np.flatnonzero((middle > floor) & (middle < MIDTONE))
    if not len(own):
        return stack
    v, low = stack[own], floor[own][:, None, None]
    room = PEAK - low
    at, to = (middle[own] - floor[own]) / (PEAK - floor[own]), (MIDTONE - floor[own]) / (PEAK - floor[own])
    a, b = np.full(len(own), 0.01), np.full(len(own), 10000.0)
    for _ in range(200):
        wide = b - a >= 1e-8
        if not wide.any():
            break
        mid = (a + b) / 2
        above = np.arcsinh(mid * at) > to * np.arcsinh(mid)
        a, b = np.where(wide & ~above, mid, a), np.where(wide & above, mid, b)
    beta = ((a + b) / 2)[:, None, None]
    raised = low + room * np.arcsinh(beta * (v - low) / room) / np.arcsinh(beta)
    cubic = (SLOPE - 1) / (MIDTONE * (MIDTONE - PEAK))
    curved = cubic * raised**3 - cubic * (PEAK + MIDTONE) * raised**2 + (1 + cubic * MIDTONE * PEAK) * raised
    if depth is not None:
        s = np.clip((depth - FADE[0]) / (FADE[1] - FADE[0]), 0, 1)
        curved = raised + (1 - s * s * (3 - 2 * s)) * (curved - raised)
    out = stack.copy()
    out[own] = np.where(v > low, np.clip(curved, 0, PEAK), v)
    return out


def auto_contrast(stack: np.ndarray, disk: tuple[float, float, float] | None, gamma: float, bg: float, prominences: float, iterations: int) -> np.ndarray:
    """All steps for images without unknown pixels; see compose.auto_contrast."""
    if disk:
        sky = without_sky(stack, *disk, bg, iterations)
        local = local_contrast(sky, *WHOLE)
        wide = (*disk[:2], disk[2] * LIMB)
        around = local_contrast(np.where((_depth(stack.shape, *wide) <= 1) & _box(stack.shape, *wide, 0), 0.0, sky), *AROUND)
        # A parabola through 0, PEAK and 16, which prominences move up.
        bend = (int(min(max(16 * (1 + prominences), 16), 255)) - 16) / (16 * 16 - 16 * PEAK)
        around = bend * around * around + (1 - bend * PEAK) * around
        plain = np.maximum(sky, 0) / np.maximum(sky.max(axis=(1, 2), keepdims=True), 1e-7)
        stack = PLAIN * PEAK * plain**gamma + (1 - PLAIN) * (LOCAL * local + (1 - LOCAL) * around)
    return np.clip(lifted(stack, disk), 0, PEAK)
