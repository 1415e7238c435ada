"""Numpy kernels on one scene or patch: what window frames and joins would do too slowly at full size."""

from __future__ import annotations

import numpy as np

from orbitframe.functions import constants as K


def quality(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The mask predicates of ``functions.pixel`` on whole bands."""
    r, g, b = (x.astype(np.int32) for x in (r, g, b))
    total = r + g + b
    cloud = total > 3 * K.CLOUD_BRIGHTNESS
    shadow = (total < 3 * K.SHADOW_DARK) & (30 * b > 11 * total) & ~cloud
    veg = 10 * (g - r) > g + r
    return {"cloud": cloud, "shadow": shadow, "veg": veg, "combined": cloud | shadow | veg}


def edge_pad(band: np.ndarray, least: int = K.BASE_SIZE) -> np.ndarray:
    """At least ``least`` rows and columns, the last ones repeated; nothing is cropped."""
    rows, cols = (max(0, least - n) for n in band.shape)
    return np.pad(band, ((0, rows), (0, cols)), mode="edge")


def cubic_weights(source: int, target: int) -> np.ndarray:
    """``(target, source)`` rows of the cubic kernel (a = -0.5), half-pixel centres, edges repeated."""
    at = (np.arange(target) + 0.5) * source / target - 0.5
    base = np.floor(at).astype(int)
    out = np.zeros((target, source))
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0.0))
        np.add.at(out, (np.arange(target), np.clip(base + k, 0, source - 1)), w)
    return out


def resize_cubic(band: np.ndarray, height: int, width: int) -> np.ndarray:
    moved = cubic_weights(band.shape[0], height) @ band.astype(float) @ cubic_weights(band.shape[1], width).T
    return np.clip(np.rint(moved), 0, 255).astype(np.uint8)


def nearest_index(source: int, target: int) -> np.ndarray:
    return ((2 * np.arange(target) + 1) * source // (2 * target)).astype(int)


def resize_nearest(band: np.ndarray, height: int, width: int) -> np.ndarray:
    return band[np.ix_(nearest_index(band.shape[0], height), nearest_index(band.shape[1], width))]


def phase_shift(reference: np.ndarray, moving: np.ndarray) -> tuple[int, int]:
    """Whole-pixel (row, column) shift that registers ``moving`` to ``reference``."""
    cross = np.fft.fft2(reference.astype(float)) * np.conj(np.fft.fft2(moving.astype(float)))
    cross /= np.maximum(np.abs(cross), 100 * np.finfo(float).eps)
    peak = np.unravel_index(np.abs(np.fft.ifft2(cross)).argmax(), cross.shape)
    return tuple(int(p - n) if p > n // 2 else int(p) for p, n in zip(peak, cross.shape, strict=True))


def _spread(mask: np.ndarray, radius: int, pick, fill: int) -> np.ndarray:
    out = mask.astype(np.uint8)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        wide = np.pad(out, pad, constant_values=fill)
        out = pick(np.lib.stride_tricks.sliding_window_view(wide, 2 * radius + 1, axis=axis), axis=-1)
    return out.astype(bool)


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Square erosion; what lies outside the image does not erode."""
    return _spread(mask, radius, np.min, 1)


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return _spread(mask, radius, np.max, 0)


def boundary(mask: np.ndarray, radius: int = K.BOUNDARY_PX) -> np.ndarray:
    return mask.astype(bool) & ~erode(mask, radius)


def components(mask: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """Labels by the smallest flat index of each component; -1 is background."""
    mask = mask.astype(bool)
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    while True:
        before = label.copy()
        for dy, dx in steps:
            a = (slice(0, label.shape[0] - dy), slice(max(0, -dx), label.shape[1] - max(0, dx)))
            b = (slice(dy, label.shape[0]), slice(max(0, dx), label.shape[1] - max(0, -dx)))
            both = mask[a] & mask[b]
            low = np.minimum(label[a], label[b])
            label[a] = np.where(both, low, label[a])
            label[b] = np.where(both, np.minimum(low, label[b]), label[b])
        flat = np.append(label.ravel(), mask.size)
        label = np.where(mask, flat[label], mask.size)  # one jump along the label
        if (label == before).all():
            return np.where(mask, label, -1)


def _boxes(label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the components, their boxes ``(4, n)`` as first and last row, first and last column, and each pixel's place among the names."""
    at = np.flatnonzero(label.ravel() >= 0)
    names, place = np.unique(label.ravel()[at], return_inverse=True)
    ys, xs = np.divmod(at, label.shape[1])
    box = np.full((4, len(names)), max(label.shape))
    box[1::2] = -1
    for row, pick, values in ((0, np.minimum, ys), (1, np.maximum, ys), (2, np.minimum, xs), (3, np.maximum, xs)):
        pick.at(box[row], place, values)
    where = np.full(label.shape, -1)
    where.ravel()[at] = place
    return names, box, where


def contact(mask: np.ndarray, radius: int = K.CONTACT_PX) -> np.ndarray:
    """Background pixels within ``radius`` of two components, inside the rows the two share, or else the columns.

    Each background pixel lists the components around it; only components that
    meet in such a list are a pair, so the work grows with the rims and not with
    the pairs of buildings.
    """
    height, width = mask.shape
    names, box, where = _boxes(components(mask))
    out = np.zeros(mask.size, bool)
    if len(names) < 2:
        return out.reshape(mask.shape)
    padded = np.pad(where, radius, constant_values=-1)
    free = np.flatnonzero(~mask.astype(bool).ravel())
    ys, xs = np.divmod(free, width)
    seen = []
    for dy in range(2 * radius + 1):
        for dx in range(2 * radius + 1):
            found = padded[ys + dy, xs + dx]
            hit = found >= 0
            seen.append(free[hit] * len(names) + found[hit])
    pixel, name = np.divmod(np.unique(np.concatenate(seen)), len(names))
    apart = 1
    while len(at := np.flatnonzero(pixel[apart:] == pixel[:-apart])):
        p, q, y, x = box[:, name[at]], box[:, name[at + apart]], *np.divmod(pixel[at], width)
        inner = np.where([[True], [False], [True], [False]], np.maximum(p, q), np.minimum(p, q))
        outer = np.where([[True], [False], [True], [False]], np.minimum(p, q), np.maximum(p, q))
        rows_shared, cols_shared = inner[0] <= inner[1], inner[2] <= inner[3]
        within = lambda v, b: (b[0] <= v) & (v <= b[1])
        beside = rows_shared & within(y, inner[:2]) & within(x, outer[2:])
        above = ~rows_shared & cols_shared & within(x, inner[2:]) & within(y, outer[:2])
        out[pixel[at][beside | above]] = True
        apart += 1
    return out.reshape(height, width)


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Exact squared distance of every pixel to the nearest background pixel; huge if there is none.

    Columns first, by the last background pixel above and below; then rows, by
    steps aside as far as they can still come nearer.
    """
    far = 4 * (mask.shape[0] + mask.shape[1]) ** 2
    foot = mask.astype(bool)
    rows = np.arange(mask.shape[0])[:, None]
    gone = 4 * mask.shape[0] + 4 * mask.shape[1]
    above = rows - np.maximum.accumulate(np.where(foot, -gone, rows), axis=0)
    below = np.minimum.accumulate(np.where(foot, gone, rows)[::-1], axis=0)[::-1] - rows
    down = np.minimum(np.minimum(above, below).astype(np.int64) ** 2, far)
    out = down.copy()
    for step in range(1, mask.shape[1]):
        if step * step >= out.max(initial=0):
            break
        np.minimum(out[:, step:], down[:, :-step] + step * step, out=out[:, step:])
        np.minimum(out[:, :-step], down[:, step:] + step * step, out=out[:, :-step])
    return out


def peaks(distance: np.ndarray, apart: int = K.PEAK_DISTANCE) -> np.ndarray:
    """Positive pixels that no neighbour within ``apart`` exceeds, off a border of that width."""
    wide = np.pad(distance, apart, constant_values=-1)
    view = np.lib.stride_tricks.sliding_window_view(wide, (2 * apart + 1, 2 * apart + 1))
    out = (distance > 0) & (distance == view.max(axis=(2, 3)))
    out[:apart] = out[-apart:] = False
    out[:, :apart] = out[:, -apart:] = False
    return out


def watershed_keep(mask: np.ndarray, apart: int = K.PEAK_DISTANCE) -> np.ndarray:
    """What a watershed without divide lines leaves of a mask: 4-connected components that hold a peak."""
    label = components(mask, diagonal=False)
    seeds = np.unique(label[peaks(squared_distance(mask), apart)])
    return np.isin(label, seeds[seeds >= 0])


def watershed_split(mask: np.ndarray, apart: int = K.PEAK_DISTANCE) -> np.ndarray:
    """Labels of touching buildings: flooding from the peaks down the distance, level by level; 0 is background."""
    distance = squared_distance(mask)
    seeds = components(peaks(distance, apart))
    label = np.where(seeds >= 0, seeds + 1, 0)
    inside = watershed_keep(mask, apart)
    for level in sorted(np.unique(distance[inside]), reverse=True):
        open_ = inside & (distance >= level)
        while True:
            near = np.zeros((4, *label.shape), label.dtype)
            near[0, 1:], near[1, :-1], near[2, :, 1:], near[3, :, :-1] = label[:-1], label[1:], label[:, :-1], label[:, 1:]
            grown = open_ & (label == 0) & (near.max(axis=0) > 0)
            if not grown.any():
                break
            label[grown] = near.max(axis=0)[grown]
    return label


def rasterize(rings: list[np.ndarray], height: int, width: int) -> np.ndarray:
    """Pixels whose centre an odd number of a polygon's edges lies right of; holes are further rings."""
    py, px = np.arange(height)[:, None] + 0.5, np.arange(width)[None, :] + 0.5
    inside = np.zeros((height, width), bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:], strict=True):
            if y1 != y2:
                inside ^= ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
    return inside


def clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A ring cut to ``(left, top, right, bottom)``, side by side; open in, open out."""
    left, top, right, bottom = box
    sides = ((0, left, 1), (0, right, -1), (1, top, 1), (1, bottom, -1))
    for axis, limit, sign in sides:
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            ina, inb = sign * (a[axis] - limit) >= 0, sign * (b[axis] - limit) >= 0
            if ina:
                out.append(a)
            if ina != inb:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                cut = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
                cut[axis] = limit
                out.append(tuple(cut))
        ring = out
        if not ring:
            break
    return ring


def mercator(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees to spherical Mercator metres."""
    radius = 6378137.0
    return radius * np.radians(lon), radius * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))


def unmercator(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius = 6378137.0
    return np.degrees(x / radius), np.degrees(2 * np.arctan(np.exp(y / radius)) - np.pi / 2)
