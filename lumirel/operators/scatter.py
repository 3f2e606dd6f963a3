"""Light that isn't where it comes from: reflections of the disk, the veil of scattered light, and wide kernels as sums of separable ones.

Kernels work on dense images with the columns of a disk (see kernels.with_disk); images without
a disk, that a disk leaves no sky of, or that hold nulls, stay as they are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .kernels import DISK, PEAK, Sampler, convolved, per_stack

#: Kernels of so many values are applied as they are.
DIRECT = 25

# The geometry and gates of both corrections, which results follow from.
#: Sky is sampled out to so many radii, on a grid of radii and azimuths.
SKY_REACH, RADII, AZIMUTHS = 1.6, 240, 720
#: A reflection's step at its rim is this part of the sky's level at least, and this part of its crescent shows it.
GHOST_STEP, GHOST_SHARE = 0.01, 0.7
MOST_GHOSTS = 6
#: So many azimuths of a move are tried, and so many candidates are judged at once.
MOVES, JUDGED = 120, 64
#: How far outside of the disk its own edge may reach, in radii.
LIMB = 0.08
#: Beyond so many radii a pixel is sky; beyond the second number it has no veil.
SKY_FROM, FAR_FROM = 1.06, 1.45
LIMB_DARKENING = 0.6
#: Part of the largest flux that a row must reach over so many pixels, for its veil to be measured.
LEAST_FLUX, LEAST_PIXELS = 0.25, 60
REJECTIONS, REJECTION_SIGMA = 5, 1.5
#: Smoothing of the veil along the rows, in radii.
VEIL_SMOOTHING = 0.04
BLACKS, EXPONENTS, BETTER = (0.0, 0.02, 0.05), (0.75, 1.0, 1.25, 1.5, 2.0), 1.3


def _gauss(x: np.ndarray, sigma: float, axis: int, wrap: bool = False) -> np.ndarray:
    half = max(1, int(np.ceil(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / max(sigma, 1e-6)) ** 2)
    pad = [(half, half) if i == axis else (0, 0) for i in range(x.ndim)]
    wide = np.pad(x, pad, mode="wrap" if wrap else "edge")
    out, part = np.zeros(x.shape), np.empty(x.shape)
    for i, w in enumerate(k / k.sum()):
        at = [slice(None)] * x.ndim
        at[axis] = slice(i, i + x.shape[axis])
        out += np.multiply(wide[tuple(at)], w, out=part)
    return out


def _wrapped_gauss(x: np.ndarray, sigma: float) -> np.ndarray:
    """_gauss along wrapping rows, as products of blocks of columns with a band of weights; columns are a multiple of 60."""
    half, block = max(1, int(np.ceil(3 * sigma))), 60
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / max(sigma, 1e-6)) ** 2)
    band = np.zeros((block + 2 * half, block))
    for i in range(block):
        band[i : i + len(k), i] = k / k.sum()
    wide = np.pad(x, ((0, 0), (half, half)), mode="wrap")
    return np.concatenate([wide[:, i : i + len(band)] @ band for i in range(0, x.shape[1], block)], axis=1)


def _rim(shift: float, turn: np.ndarray) -> np.ndarray:
    """How far from the disk's centre a disk of radius 1 ends that is moved by shift, at azimuths against that of its move."""
    return shift * np.cos(turn) + np.sqrt(np.maximum(0.0, 1 - (shift * np.sin(turn)) ** 2))


class _Sky:
    """What all images of a size and disk have in common: rings and azimuths around the disk, where they lie in an image, and the candidates for moved disks."""

    def __init__(self, shape: tuple[int, int], cx: float, cy: float, radius: float):
        h, w = shape
        self.turns = np.arange(AZIMUTHS) * 2 * np.pi / AZIMUTHS
        radii = radius * np.linspace(1, SKY_REACH, RADII)[:, None]
        py, px = cy + radii * np.sin(self.turns), cx + radii * np.cos(self.turns)
        self.known = (py >= 0) & (py <= h - 1) & (px >= 0) & (px <= w - 1)
        self.enough = bool(self.known.sum() >= 0.2 * self.known.size)
        self.places = Sampler(shape, np.clip(py, 0, h - 1), np.clip(px, 0, w - 1), "bilinear")
        self.flat = [[row * w + column for column in self.places.columns] for row in self.places.rows]
        self.around = np.linspace(1, SKY_REACH, RADII)[:, None]
        y, x = np.indices(shape).astype(float)
        r = np.hypot(y - cy, x - cx) / radius
        at_r, at_t = (r - 1) / (SKY_REACH - 1) * (RADII - 1), (np.arctan2(y - cy, x - cx) % (2 * np.pi)) / (2 * np.pi) * AZIMUTHS
        self.back = Sampler((RADII, AZIMUTHS + 1), np.clip(at_r, 0, RADII - 1), np.clip(at_t, 0, AZIMUTHS), "bilinear")
        self.shown = (r > 1) & (r <= SKY_REACH)
        # The places of the grid that shown pixels are read from.
        taps = np.stack([row[self.shown] * AZIMUTHS + column[self.shown] % AZIMUTHS for row in self.back.rows for column in self.back.columns])
        self.read = np.unique(taps)
        # How many known places a ring has.
        self.n = self.known.sum(1)
        self.candidates()

    def polar(self, image: np.ndarray) -> np.ndarray:
        """The image's values on the grid; the same sums as Sampler's, by flat places."""
        flat, out = image.reshape(-1), np.zeros(self.known.shape)
        # A few rings at a time, whose numbers stay near the processor.
        for i in range(0, RADII, 12):
            at = slice(i, i + 12)
            x0, x1 = (v[at] for v in self.places.wx)
            for w, (a, b) in zip(self.places.wy, self.flat, strict=True):
                out[at] += w[at] * (x0 * flat.take(a[at]) + x1 * flat.take(b[at]))
        return out

    def spread(self, total: np.ndarray) -> np.ndarray:
        """The image of what lies on the grid, smoothed; of a small image only the places that are read are."""
        taps = [(g, s, max(1, int(np.ceil(3 * s)))) for g, s in ((1, 3), (0, 2))]
        if len(self.read) * (2 * taps[1][2] + 1) > total.size:
            smooth = _gauss(_gauss(total, 3, 1, wrap=True), 2, 0)
        else:
            (kt, ht), (kr, hr) = ((np.exp(-0.5 * (np.arange(-h, h + 1) / s) ** 2), h) for _, s, h in taps)
            r, t = self.read // AZIMUTHS, self.read % AZIMUTHS
            rows = np.clip(r[:, None] + np.arange(-hr, hr + 1), 0, RADII - 1)
            along = np.zeros(rows.shape)
            for i, w in enumerate(kt / kt.sum()):
                along += total[rows, ((t + i - ht) % AZIMUTHS)[:, None]] * w
            own = np.zeros(len(r))
            for i, w in enumerate(kr / kr.sum()):
                own += along[:, i] * w
            smooth = np.zeros(total.shape)
            smooth.reshape(-1)[self.read] = own
        return np.where(self.shown, self.back(np.concatenate([smooth, smooth[:, :1]], axis=1)), 0.0)

    def candidates(self) -> None:
        """For each shift and azimuth that has places enough: those inside and outside of its rim, as rows of equal length whose rest is beyond the end."""
        span = SKY_REACH - 1
        gap, off = max(2, round(0.03 / span * RADII)), int(np.ceil(LIMB / span * RADII))
        inner = np.abs((self.turns + np.pi) % (2 * np.pi) - np.pi) <= np.pi / 3
        rows, every = np.flatnonzero(inner), AZIMUTHS // MOVES
        column = (rows[None] + np.arange(0, AZIMUTHS, every)[:, None]) % AZIMUTHS
        shifts, turns, lows, highs, sizes, chosen, whole, starts = [], [], [], [], [], [], [], []
        # Where what all moves of a shift see in one direction begins, when azimuths are dealt to every rows that go around twice.
        start = rows % every * 2 * MOVES + rows // every
        for shift in np.arange(0.1, 0.5, 0.02):
            at = np.round((_rim(shift, self.turns[inner]) - 1) / span * (RADII - 1)).astype(int)
            low, high = np.clip(at - gap, 0, RADII - 1)[None], np.clip(at + gap, 0, RADII - 1)[None]
            both = self.known[low, column] & self.known[high, column] & (at - gap >= off)
            many = both.sum(1) >= 20
            starts.append(np.stack([low[0], high[0]]) * every * 2 * MOVES + start)
            whole.append(both.T)
            chosen.append(many)
            both, own = both[many], column[many]
            # The places that count come first.
            order = np.argsort(~both, axis=1, kind="stable")
            past = RADII * AZIMUTHS
            for side, out in ((low, lows), (high, highs)):
                out.append(np.take_along_axis(np.where(both, side * AZIMUTHS + own, past), order, 1))
            sizes.append(both.sum(1))
            shifts.append(np.full(many.sum(), shift))
            turns.append(self.turns[::every][many])
        self.shift, self.azimuth, self.size = np.concatenate(shifts), np.concatenate(turns), np.concatenate(sizes)
        most = int(self.size.max(initial=0))
        self.low, self.high = (np.ascontiguousarray(np.concatenate(x)[:, :most]) for x in (lows, highs))
        self.starts, self.chosen = np.stack(starts, 1), np.concatenate(chosen)
        self.whole = np.stack(whole)
        # Held, as getting so much memory for each image takes longer than filling it.
        self.fall, self.many, self.ended = np.empty(self.whole.shape, np.float32), np.empty(self.whole.shape, bool), np.empty(RADII * AZIMUTHS + 1)

    def levels(self, polar: np.ndarray) -> np.ndarray:
        """Of each ring, the level below which a tenth of its sky lies; NaN of a ring that has none."""
        out = np.full(len(polar), np.nan)
        own = np.flatnonzero(self.n > 0)
        ordered = np.sort(np.where(self.known, polar, np.inf)[own], axis=1)
        at = 0.1 * (self.n[own] - 1)
        below, share = np.floor(at).astype(int), at - np.floor(at)
        a, b = (np.take_along_axis(ordered, np.minimum(below + i, self.n[own] - 1)[:, None], 1)[:, 0] for i in (0, 1))
        out[own] = np.where(share >= 0.5, b - (b - a) * (1 - share), a + (b - a) * share)
        return out

    def falls(self, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the excess falls at each direction of each shift, for all moves side by side, and its sums by candidates; of single precision and only for bounds."""
        every = AZIMUTHS // MOVES
        own = excess.astype(np.float32).reshape(RADII, MOVES, every).transpose(0, 2, 1)
        flat = np.concatenate([own, own], axis=2)
        moves = np.lib.stride_tricks.sliding_window_view(flat.reshape(-1), MOVES)
        sums = np.empty(self.fall.shape[::2], np.float32)
        for out, low, high, total in zip(self.fall, *self.starts, sums, strict=True):
            np.subtract(moves[low], moves[high], out=out).sum(axis=0, out=total)
        return self.fall, sums.reshape(-1)[self.chosen]

    def judged(self, excess: np.ndarray, own: np.ndarray, least: float) -> np.ndarray:
        """The median falls of some candidates; minus infinity of those that don't count."""
        # What is no place of a candidate is infinite, and after all that are.
        self.ended[:-1], self.ended[-1] = excess.reshape(-1), np.inf
        fall = self.ended.take(self.low[own])
        self.ended[-1] = 0
        fall -= self.ended.take(self.high[own])
        fall.sort(axis=1)
        n, at = self.size[own], np.arange(len(own))
        upper = fall[at, n // 2]
        step = np.where(n % 2 == 1, upper, (fall[at, n // 2 - 1] + upper) / 2)
        falling = ((fall > 0.5 * step[:, None]).sum(1) - (fall.shape[1] - n)) / n
        return np.where((step > least) & (falling >= GHOST_SHARE), step, -np.inf)

    def ghost(self, excess: np.ndarray, least: float, found: list[tuple[float, float]]) -> tuple[float, float] | None:
        """(shift, azimuth) of the moved disk at whose rim the excess falls most, in radii; None if no fall counts.

        excess[r, t] is the light above the sky's level from radius 1 to SKY_REACH. Each candidate is judged by the median fall from inside its rim to
        outside, over the half of its crescent that is widest, weighted by how much of it falls.
        """
        if not len(self.shift):
            return None
        rest = np.ones(len(self.shift), bool)
        for s, a in found:
            rest &= ~((np.abs(self.shift - s) < 0.06) & (np.abs((self.azimuth - a + np.pi) % (2 * np.pi) - np.pi) < 0.5))
        peak = float(np.abs(excess).max())
        if not peak > 0:
            return None
        fall, sums = self.falls(excess / peak)

        def above(level: float) -> np.ndarray:
            """How many places of each candidate may fall by level or more: the slack is above what single precision loses."""
            many = np.greater_equal(fall, np.float32(level / peak - 1e-6), out=self.many)
            many &= self.whole
            return np.add.reduce(many.view(np.uint8), axis=1, dtype=np.uint8 if fall.shape[1] < 256 else int).reshape(-1)[self.chosen].astype(int)

        # A median above a level has half of the places there, and a fall that counts has its share above half of the level.
        rest &= (2 * above(least) >= self.size) & (above(0.5 * least) >= GHOST_SHARE * self.size - 1e-6)
        if not rest.any():
            return None
        # The steepest on the whole come first, so that what they reach leaves out most others.
        order = np.flatnonzero(rest)
        order = order[np.argsort(-(sums / self.size)[order], kind="stable")]
        best, at = -np.inf, -1
        while len(order):
            own, order = order[:JUDGED], order[JUDGED:]
            step = self.judged(excess, own, least)
            top = float(step.max())
            if top == -np.inf or top < best:
                continue
            # Of equal ones the first candidate.
            first = int(own[step == top].min())
            at = first if top > best else min(at, first)
            if top > best and len(order):
                order = order[2 * above(top)[order] >= self.size[order]]
            best = top
        return (float(self.shift[at]), float(self.azimuth[at])) if at >= 0 else None


def _medians(group: np.ndarray, value: np.ndarray, groups: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The medians of the values of some groups; n is the size of every group."""
    first, own = np.cumsum(n) - n, np.argsort(group.astype(np.int16) if len(n) < 1 << 15 else group, kind="stable")
    rows = np.full((len(n), int(n.max(initial=0))), np.inf)
    rows[group[own], np.arange(len(own)) - first[group[own]]] = value[own]
    rows = np.sort(rows[groups], axis=1)
    at, size = np.arange(len(groups)), n[groups]
    upper = rows[at, size // 2]
    return np.where(size % 2 == 1, upper, (rows[at, size // 2 - 1] + upper) / 2)


def _reflections(image: np.ndarray, sky: _Sky) -> np.ndarray | None:
    """The light of all reflections of the disk, outside of it; None if there is none."""
    if not sky.enough:
        return None
    polar, known, around = sky.polar(image), sky.known, sky.around
    level = sky.levels(polar)
    base = float(np.nanmean(level))
    level = np.where(np.isnan(level), base, level)
    # The disk's own edge isn't sharp: what is next to it is taken to be as what is a little further.
    off = int(np.ceil(LIMB / (SKY_REACH - 1) * RADII))
    excess = np.where(known, np.maximum(polar - level[:, None], 0.0), 0.0)
    excess[:off] = excess[off]
    smooth = _wrapped_gauss(excess, 10)
    taken, total = [], np.zeros(polar.shape)
    for _ in range(MOST_GHOSTS):
        found = sky.ghost(smooth, GHOST_STEP * abs(base), taken)
        if found is None:
            break
        shift, azimuth = found
        taken.append(found)
        rim = _rim(shift, sky.turns - azimuth)
        # Nothing happens further out than the rim.
        beside, reach = np.flatnonzero(around[0] <= rim + 0.02), int((around <= rim.max() + 0.02).sum())
        rim, own_around = rim[None, beside], around[:reach]
        parts = [slice(p[0], p[-1] + 1) for p in np.split(beside, np.flatnonzero(np.diff(beside) > 1) + 1)]
        inside = (own_around <= rim - 0.02) & np.concatenate([known[:reach, p] for p in parts], axis=1)
        if inside.sum() < 50:
            continue
        seen_light = np.concatenate([smooth[:reach, p] for p in parts], axis=1)
        # The reflection's light by distance from its rim, the same all around; never more than what is there.
        away = np.minimum(((rim - own_around) / (SKY_REACH - 1) * RADII).astype(int), RADII - 1)
        own = away[inside]
        order = np.bincount(own, minlength=RADII)
        seen = np.flatnonzero(order >= 10)
        if not len(seen):
            continue
        profile = np.interp(np.arange(RADII), seen, _medians(own, seen_light[inside], seen, order))
        # It fades out over the width of the rim.
        fade = np.clip((rim - own_around) / 0.04 + 0.5, 0, 1)
        light = np.minimum(profile[np.maximum(away, 0)] * fade, seen_light) * (own_around <= rim + 0.02)
        for p, part in zip(parts, np.split(light, np.cumsum([p.stop - p.start for p in parts])[:-1], axis=1), strict=True):
            total[:reach, p] += part
            smooth[:reach, p] = np.maximum(smooth[:reach, p] - part, 0.0)
    if not total.any():
        return None
    return sky.spread(total)


def _usable(stack: np.ndarray, radius: float | None) -> bool:
    return radius is not None and radius > 0 and bool(np.isfinite(stack).all())


def deghost(images: DataFrame, strength: float = 1.0, iterations: int = 1, show: bool = False) -> DataFrame:
    """Images without the reflections of their disk: crescents beside it whose outer edge is that of a moved disk of the same size.

    Up to MOST_GHOSTS are looked for in each pass. A crescent counts if light falls at its rim by GHOST_STEP of the sky's level
    or more along most of it. Pixels of the disk stay, others lose no more than strength times what was found and never go below 0; details that are
    finer than a crescent stay. show gives what would be taken away instead.
    """

    def kernel(stack: np.ndarray, cx: float, cy: float, radius: float) -> np.ndarray:
        out, sky = [], None
        for image in stack:
            own, first = image, np.zeros(image.shape)
            for turn in range(iterations if _usable(image, radius) and strength > 0 else 0):
                sky = sky or _Sky(image.shape, cx, cy, radius)
                found = _reflections(own, sky)
                if found is None:
                    break
                first = strength * found if turn == 0 else first
                own = np.where(found > 0, np.maximum(own - strength * found, 0.0), own)
            out.append(first if show else own)
        return np.stack(out)

    # The kernel outweighs its input by far: a table of a few row groups is dealt to all cores.
    return per_stack(images.repartition(4 * images.sparkSession.sparkContext.defaultParallelism, "image_id"), kernel, DISK)


def chord_flux(width: int, cx: float, radius: float) -> np.ndarray:
    """The light that enters a slit along each column: the limb-darkened chord of the disk there, 1 at most, 0 beside the disk."""
    u = np.clip(np.abs(np.arange(width) - cx) / radius, 0, 1)
    half = np.sqrt(1 - u * u)
    # Of 1 - d + d * mu over the chord, mu being the height of the sphere above it.
    flux = 2 * half * (1 - LIMB_DARKENING) + LIMB_DARKENING * np.pi / 2 * half * half
    return flux / max(flux.max(), 1e-12)


def _amplitudes(v: np.ndarray, sky: np.ndarray, r: np.ndarray, flux: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much veil of the flux's shape each row of values has, beside a constant and a curve of the radius, and what the fit leaves of a row; NaN where it can't be told.

    Pixels well above a row's fit are left out, again and again, so what stands on the veil doesn't raise it.
    """
    basis = np.stack([np.ones(v.shape), r, r * r, np.broadcast_to(flux, v.shape)], axis=2)
    keep = sky.copy()
    out, rest = np.full(len(v), np.nan), np.full(len(v), np.nan)
    for _ in range(REJECTIONS):
        n = keep.sum(1)
        enough = (n >= LEAST_PIXELS) & ((keep & (flux[None] >= LEAST_FLUX)).sum(1) >= LEAST_PIXELS // 2)
        if not enough.any():
            break
        weight = keep[enough].astype(float)
        left = np.einsum("yx,yxi,yxj->yij", weight, basis[enough], basis[enough], optimize=True) + 1e-9 * np.eye(4)
        right = np.einsum("yx,yxi->yi", weight * v[enough], basis[enough], optimize=True)
        fit = np.linalg.solve(left, right[..., None])[..., 0]
        out[:], rest[:] = np.nan, np.nan
        out[enough] = fit[:, 3]
        off = v[enough] - np.einsum("yxi,yi->yx", basis[enough], fit)
        spread = np.sqrt((weight * off * off).sum(1) / np.maximum(weight.sum(1), 1))
        rest[enough] = spread
        now = keep.copy()
        now[enough] &= off <= REJECTION_SIGMA * spread[:, None]
        if (now == keep).all():
            break
        keep = now
    return out, rest


def _linear(v: np.ndarray, black: float, exponent: float) -> np.ndarray:
    return np.maximum((v - black) / (1 - black), 0.0) ** exponent


def _unveiled(image: np.ndarray, cx: float, cy: float, radius: float, strength: float) -> np.ndarray:
    h, w = image.shape
    y, x = np.indices(image.shape).astype(float)
    r = np.hypot(y - cy, x - cx) / radius
    # Rows of one value at the top and at the bottom are a canvas's fill.
    level = np.ptp(image, axis=1) == 0
    rows = np.flatnonzero(~level)
    if not len(rows):
        return image
    valid = (np.arange(h) >= rows[0]) & (np.arange(h) <= rows[-1])
    sky = (r > SKY_FROM) & valid[:, None]
    flux = chord_flux(w, cx, radius)
    scaled = np.clip(image / PEAK, 0, 1)

    def misfit(black: float, exponent: float) -> tuple[float, np.ndarray]:
        found, rest = _amplitudes(_linear(scaled, black, exponent), sky, r, flux)
        own = np.isfinite(found)
        level = float(np.median(found[own])) if own.sum() >= 30 else 0.0
        return (float(np.median(rest[own])) / level if level > 1e-6 else np.inf), found

    # The transfer under which the veil is most like the flux, if it is clearly more so than under none.
    score, amplitude = misfit(0.0, 1.0)
    black, exponent, best = 0.0, 1.0, score
    for b in BLACKS:
        for e in EXPONENTS:
            own, found = misfit(b, e)
            if own * BETTER < score and own < best:
                black, exponent, best, amplitude = b, e, own, found
    known = np.flatnonzero(np.isfinite(amplitude))
    if not len(known):
        return image
    full = np.interp(np.arange(h), known, amplitude[known])
    full = np.maximum(_gauss(full, max(VEIL_SMOOTHING * radius, 1e-6), 0), 0.0) * valid
    linear = _linear(scaled, black, exponent)
    veil = strength * full[:, None] * flux[None]
    far = linear[(r > FAR_FROM) & valid[:, None] & (np.broadcast_to(flux, r.shape) == 0)]
    floor = float(np.median(far)) if len(far) else 0.0
    less = np.maximum(linear - veil, np.minimum(linear, floor))
    back = PEAK * (black + (1 - black) * np.maximum(less, 0.0) ** (1 / exponent))
    return np.where((r > 1) & (veil > 0), back, image)


def descatter(images: DataFrame, strength: float = 1.0, iterations: int = 1) -> DataFrame:
    """Images without the veil that light scattered in the instrument lays over the columns in which the disk was scanned.

    A column's veil has the shape of the light that entered the slit, which is the disk's chord there; its height is fitted for each row and smoothed. Beside the
    disk's columns nothing is taken away, the disk stays, and no pixel falls below the level of the sky that has no veil. Images that were
    stretched are made linear first, if that makes the veil clearly more like the flux.
    """

    def kernel(stack: np.ndarray, cx: float, cy: float, radius: float) -> np.ndarray:
        out = []
        for image in stack:
            for _ in range(iterations if _usable(image, radius) and strength > 0 else 0):
                image = _unveiled(image, cx, cy, radius, strength)
            out.append(image)
        return np.stack(out)

    return per_stack(images, kernel, DISK)


def low_rank(kernel: np.ndarray, most: int = 2, tolerance: float = 1e-4) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(column, row) pairs, most at most, whose outer products add up to the kernel but for tolerance times its largest value; None if more are needed.

    These are the leading singular vectors, so no other sum of so many products comes nearer by squares.
    """
    kernel = np.asarray(kernel, float)
    if not kernel.any() or not np.isfinite(kernel).all():
        return None
    u, s, v = np.linalg.svd(kernel)
    limit = tolerance * np.abs(kernel).max()
    for k in range(1, min(most, len(s)) + 1):
        if np.abs((u[:, :k] * s[:k]) @ v[:k] - kernel).max() <= limit:
            return [(u[:, i] * s[i], v[i]) for i in range(k)]
    return None


def convolve_wide(images: DataFrame, kernel: list[list[float]], most: int = 2, tolerance: float = 1e-4) -> DataFrame:
    """Images under a kernel of odd sides, edges repeated: by passes along columns and rows where few of them make up the kernel, directly if it is small, by FFT otherwise.

    By FFT, a null pixel makes NaN of its whole image.
    """
    k = np.asarray(kernel, float)
    if k.ndim != 2 or k.shape[0] % 2 == 0 or k.shape[1] % 2 == 0:
        raise ValueError("a kernel has odd sides")
    terms = low_rank(k, most, tolerance)
    ry, rx = k.shape[0] // 2, k.shape[1] // 2
    cheap = terms is not None and len(terms) * sum(k.shape) < k.size

    def run(stack: np.ndarray) -> np.ndarray:
        wide = np.pad(stack, ((0, 0), (ry, ry), (rx, rx)), mode="edge")
        h, w = stack.shape[1:]
        if cheap:
            out = np.zeros(stack.shape)
            for column, row in terms:
                part = sum(row[::-1][j] * wide[:, :, 2 * rx - j : 2 * rx - j + w] for j in range(len(row)))
                out += sum(column[::-1][i] * part[:, 2 * ry - i : 2 * ry - i + h] for i in range(len(column)))
            return out
        if k.size <= DIRECT:
            return convolved(stack, k)
        size = wide.shape[1:]
        # Correlation, as kernels.convolve has it.
        spectrum = np.fft.rfft2(wide, size) * np.conj(np.fft.rfft2(k, size))
        return np.fft.irfft2(spectrum, size)[:, :h, :w]

    return per_stack(images, run)
