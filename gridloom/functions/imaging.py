"""Raster kernels on numpy: binarisation, rules, skew, ink, quality.

These are own implementations of textbook operations, meant for Arrow batches of
pages. They agree with common imaging libraries in effect, not pixel for pixel.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import lru_cache

import numpy as np

#: Places that one product of matrices blurs; a fixed value, without effect on results.
BAND = 32


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luma of a colour image; a gray one is copied."""
    if image.ndim == 2:
        return image.copy()
    return np.rint(image[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _convolve(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    reach = len(kernel) // 2
    padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)], mode="edge")
    n = image.shape[axis]
    return sum(k * np.take(padded, np.arange(i, i + n), axis=axis) for i, k in enumerate(kernel))


def _gaussian(block: int, sigma: float | None = None) -> np.ndarray:
    sigma = sigma or 0.3 * ((block - 1) * 0.5 - 1) + 0.8
    at = np.arange(block) - block // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    return kernel / kernel.sum()


def gaussian_blur(image: np.ndarray, block: int, sigma: float | None = None) -> np.ndarray:
    kernel = _gaussian(block, sigma)
    return _convolve(_convolve(image.astype(np.float64), kernel, 0), kernel, 1)


@lru_cache(maxsize=8)
def _bands(block: int) -> np.ndarray:
    """The kernel of ``gaussian_blur`` as a matrix that takes neighbours to some means."""
    bands = np.zeros((BAND + block - 1, BAND))
    for i in range(BAND):
        bands[i : i + block, i] = _gaussian(block)
    return bands


def _means(image: np.ndarray, block: int) -> np.ndarray:
    """``gaussian_blur`` but for the last digits, as products of matrices."""
    h, w = image.shape
    reach, bands, n = block // 2, _bands(block), BAND + block - 1
    tall = np.empty((h + block + BAND, w))
    tall[reach : reach + h] = image
    tall[:reach], tall[reach + h :] = image[0], image[-1]
    wide = np.empty((h + BAND, w + block + BAND))
    for y in range(0, h, BAND):
        np.matmul(bands.T, tall[y : y + n], out=wide[y : y + BAND, reach : reach + w])
    wide = wide[:h]
    wide[:, :reach], wide[:, reach + w :] = wide[:, reach, None], wide[:, reach + w - 1, None]
    out = np.empty((h, w + BAND))
    for x in range(0, w, BAND):
        np.matmul(wide[:, x : x + n], bands, out=out[:, x : x + BAND])
    return out[:, :w]


def binarize(image: np.ndarray, block: int = 35, offset: float = 15.0, inverted: bool = False) -> np.ndarray:
    """Adaptive threshold against the Gaussian mean of the neighbourhood."""
    gray = to_gray(image)
    above = _means(gray, block)
    above -= offset
    np.subtract(gray, above, out=above)
    light = above > 0
    if np.abs(above, out=above).min(initial=1.0) < 1e-6:  # so near that the order of summation decides
        light = gray > gaussian_blur(gray, block) - offset
    return (light != inverted).astype(np.uint8) * np.uint8(255)


def equalize_tiles(image: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Contrast-limited equalisation in tiles, blended between tile centres."""
    gray = to_gray(image)
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = gray[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(part.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * part.size / 256)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + extra / 256
            maps[i, j] = np.cumsum(hist) * 255 / max(1, part.size)
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = fy.astype(int), fx.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    at = lambda i, j: maps[i[:, None], j[None, :], gray]
    blended = (at(y0, x0) * (1 - wx) + at(y0, x1) * wx) * (1 - wy) + (at(y1, x0) * (1 - wx) + at(y1, x1) * wx) * wy
    return np.clip(np.rint(blended), 0, 255).astype(np.uint8)


def denoise(image: np.ndarray, strength: float = 7.0, reach: int = 3) -> np.ndarray:
    """Neighbours averaged by how alike their patches are (non-local means in a small window)."""
    gray = to_gray(image).astype(np.float64)
    total, weights = np.zeros_like(gray), np.zeros_like(gray)
    box = np.ones(3) / 3
    padded = np.pad(gray, reach, mode="edge")
    h, w = gray.shape
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            moved = padded[reach + dy : reach + dy + h, reach + dx : reach + dx + w]
            apart = _convolve(_convolve((gray - moved) ** 2, box, 0), box, 1)
            weight = np.exp(-apart / (strength * strength))
            total += weight * moved
            weights += weight
    return np.clip(np.rint(total / weights), 0, 255).astype(np.uint8)


#: Steps of each kind of page.
PROFILES = {
    "clean_scan": (binarize,),
    "low_contrast": (equalize_tiles, binarize),
    "photo": (equalize_tiles, lambda i: denoise(i, 10.0), binarize),
    "auto": (denoise, binarize),
}


def preprocess(image: np.ndarray, profile: str = "auto") -> np.ndarray:
    out = to_gray(image)
    for step in PROFILES[profile]:
        out = step(out)
    return out


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, stop`` of every unbroken run in the rows of a mask, ends exclusive."""
    h, w = mask.shape
    flat = np.zeros(h * (w + 1) + 1, bool)
    flat[1:].reshape(h, w + 1)[:, :w] = mask
    at = np.flatnonzero(flat[1:] != flat[:-1])
    start, stop = at[::2], at[1::2]
    row = start // (w + 1)
    return row, start - row * (w + 1), stop - row * (w + 1)


def _painted(shape: tuple[int, int], row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The mask that has these runs."""
    h, w = shape
    ends = np.zeros(2 * len(row) + 2, np.int64)
    ends[1:-1:2], ends[2:-1:2], ends[-1] = row * w + start, row * w + stop, h * w
    return np.repeat(np.arange(len(ends) - 1) % 2 > 0, ends[1:] - ends[:-1]).reshape(h, w)


def _long_runs(mask: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, start, stop = runs_of(mask)
    long = stop - start >= length
    return row[long], start[long], stop[long]


def _united(width: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For every run the first run of its 8-connected component."""
    # Runs come row by row, so one number tells row and place; those above that touch a run stand in a row.
    step = width + 2
    first = np.searchsorted(row * step + stop, (row - 1) * step + start, "left")
    touching = np.searchsorted(row * step + start, (row - 1) * step + stop, "right") - first
    parent = np.where(touching > 0, first, np.arange(len(row)))
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    more = np.flatnonzero(touching > 1)
    if not len(more):
        return parent
    root = parent.tolist()

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for run, i, n in zip(more.tolist(), first[more].tolist(), touching[more].tolist(), strict=True):
        for above in range(i + 1, i + n):
            a, b = find(run), find(above)
            if a != b:
                root[max(a, b)] = min(a, b)
    parent = np.array(root)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return parent


def components_of(width: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the component of every run, from 0 in the order of their first runs, and how many there are."""
    united = _united(width, row, start, stop)
    heads = united == np.arange(len(row))
    return (np.cumsum(heads) - 1)[united], int(heads.sum())


def label_components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components by labelling runs and uniting those that touch."""
    runs = runs_of(mask)
    number, count = components_of(mask.shape[1], *runs)
    labels = np.zeros(mask.shape, np.int32)
    labels[_painted(mask.shape, *runs)] = np.repeat(number + 1, runs[2] - runs[1])
    return labels, count


def run_boxes(width: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``x0, y0, x1, y1, area`` of every component of these runs, ends exclusive."""
    number, count = components_of(width, row, start, stop)
    if not count:
        return np.zeros((0, 5), np.int64)
    order = np.argsort(number, kind="stable")
    at = np.flatnonzero(np.diff(number[order], prepend=-1))
    return np.column_stack([
        np.minimum.reduceat(start[order], at), np.minimum.reduceat(row[order], at), np.maximum.reduceat(stop[order], at),
        np.maximum.reduceat(row[order], at) + 1, np.add.reduceat((stop - start)[order], at),
    ])


def component_boxes(labels: np.ndarray, count: int) -> np.ndarray:
    """``x0, y0, x1, y1, area`` of every component, ends exclusive."""
    ys, xs = np.nonzero(labels)
    of = labels[ys, xs] - 1
    out = np.zeros((count, 5), np.int64)
    out[:, 0], out[:, 1] = labels.shape[1], labels.shape[0]
    np.minimum.at(out[:, 0], of, xs)
    np.minimum.at(out[:, 1], of, ys)
    np.maximum.at(out[:, 2], of, xs + 1)
    np.maximum.at(out[:, 3], of, ys + 1)
    out[:, 4] = np.bincount(of, minlength=count)
    return out


def run_boxes(width: int, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``component_boxes`` from the runs of a mask, without laying out labels."""
    number, count = components_of(width, row, start, stop)
    if not count:
        return np.zeros((0, 5), np.int64)
    order = np.argsort(number, kind="stable")
    row, start, stop = row[order], start[order], stop[order]
    at = np.flatnonzero(np.diff(number[order], prepend=-1))
    least, most = np.minimum.reduceat, np.maximum.reduceat
    return np.column_stack([least(start, at), least(row, at), most(stop, at), most(row, at) + 1, np.add.reduceat(stop - start, at)])


def mask_boxes(mask: np.ndarray) -> np.ndarray:
    return run_boxes(mask.shape[1], *runs_of(mask))


Line = tuple[float, float, float, float, float]


def box_lines(boxes: np.ndarray, horizontal: bool, minimum: float) -> list[Line]:
    """Boxes of components as lines through their middle: start, end and thickness."""
    out: list[Line] = []
    for x0, y0, x1, y1, _ in boxes.tolist():
        w, h = x1 - x0, y1 - y0
        if (w if horizontal else h) < minimum:
            continue
        mid = y0 + h / 2 if horizontal else x0 + w / 2
        out.append((x0, mid, x1, mid, h) if horizontal else (mid, y0, mid, y1, w))
    return out


def ruled_lines(image: np.ndarray, share: float = 0.08) -> tuple[list[Line], list[Line], np.ndarray, np.ndarray]:
    """Horizontal and vertical rules of at least a share of the page, and their masks."""
    ink = binarize(image, 31, 13.0, inverted=True) > 0
    h, w = ink.shape
    level = _long_runs(ink, max(10, w // 30))
    tall = _painted((w, h), *_long_runs(ink.T, max(10, h // 30))).T
    return box_lines(run_boxes(w, *level), True, share * w), box_lines(mask_boxes(tall), False, share * h), _painted((h, w), *level), tall


def erase_lines(image: np.ndarray, flat: np.ndarray, tall: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Rules filled from their surroundings, ring by ring."""
    gray = to_gray(image).astype(np.float64)
    hole = flat | tall
    for _ in range(rounds):
        if not hole.any():
            break
        known = np.pad(~hole, 1).astype(np.float64)
        value = np.pad(np.where(hole, 0.0, gray), 1)
        total, count = np.zeros_like(gray), np.zeros_like(gray)
        for dy in range(3):
            for dx in range(3):
                total += value[dy : dy + gray.shape[0], dx : dx + gray.shape[1]]
                count += known[dy : dy + gray.shape[0], dx : dx + gray.shape[1]]
        ring = hole & (count > 0)
        gray[ring] = total[ring] / count[ring]
        hole = hole & ~ring
    gray[hole] = 255
    return np.clip(np.rint(gray), 0, 255).astype(np.uint8)


def skew_angle(image: np.ndarray, limit: float = 5.0) -> float:
    """Median slope in degrees of long, nearly level dark edges; 0 if there are none."""
    ink = binarize(image, 31, 13.0, inverted=True) > 0
    h, w = ink.shape
    edge = ink & ~np.pad(ink, ((1, 0), (0, 0)))[:-1]
    ys, xs = np.nonzero(edge)
    if not len(ys):
        return 0.0
    best: tuple[float, float] = (0.0, 0.0)
    for angle in np.arange(-limit, limit + 1e-9, 0.1):
        offset = np.rint(ys - xs * np.tan(np.radians(angle))).astype(int)
        votes = np.bincount(offset - offset.min())
        strength = float((votes[votes >= max(20, w / 8)].astype(float) ** 2).sum())
        if strength > best[0]:
            best = (strength, float(angle))
    return best[1] if best[0] > 0 else 0.0


def rotate(image: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """About the middle, bilinear, size kept, uncovered parts filled."""
    h, w = image.shape[:2]
    t = np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx
    sy = np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    inside = (x0 >= 0) & (y0 >= 0) & (x0 < w - 1) & (y0 < h - 1)
    x0c, y0c = np.clip(x0, 0, max(0, w - 2)), np.clip(y0, 0, max(0, h - 2))
    if image.ndim == 3:
        fx, fy, keep = fx[..., None], fy[..., None], inside[..., None]
    else:
        keep = inside
    a, b = image[y0c, x0c], image[y0c, np.minimum(x0c + 1, w - 1)]
    c, d = image[np.minimum(y0c + 1, h - 1), x0c], image[np.minimum(y0c + 1, h - 1), np.minimum(x0c + 1, w - 1)]
    value = (a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy
    return np.where(keep, np.clip(np.rint(value), 0, 255), fill).astype(np.uint8)


def deskew(image: np.ndarray, limit: float = 5.0, least: float = 0.1) -> np.ndarray:
    angle = skew_angle(image, limit)
    return rotate(image, angle) if abs(angle) >= least else image


def orient(image: np.ndarray, report: str | None) -> np.ndarray:
    """Turned as an orientation report says ("Rotate: n"); unchanged without one."""
    import re

    m = re.search(r"Rotate:\s*(\d+)", report or "")
    turns = {90: -1, 180: 2, 270: 1}.get(int(m.group(1)) if m else 0, 0)
    return np.ascontiguousarray(np.rot90(image, turns)) if turns else image


def invert(image: np.ndarray) -> np.ndarray:
    return (255 - image).astype(np.uint8)


def otsu_threshold(gray: np.ndarray) -> int:
    hist = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    spread[~np.isfinite(spread)] = -1
    return int(np.argmax(spread))


def has_ink(image: np.ndarray, x0: float, y0: float, x1: float, y1: float, least: float = 0.015) -> bool:
    """Whether a region holds marks other than specks and whole edges."""
    h, w = image.shape[:2]
    a, b = max(0, int(np.floor(x0))), min(w, int(np.ceil(x1)))
    c, d = max(0, int(np.floor(y0))), min(h, int(np.ceil(y1)))
    if b <= a or d <= c:
        return False
    part = to_gray(image[c:d, a:b])
    if part.min() == part.max():
        return False
    boxes = mask_boxes(part <= otsu_threshold(part))
    wide, tall = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    marks = (boxes[:, 4] >= 2) & (wide < 0.9 * (b - a)) & (tall < 0.9 * (d - c))
    return bool(boxes[marks, 4].sum() / image[c:d, a:b].size >= least)


#: Codes of suspicious pictures, in their order, and the limits behind them.
SUSPICIONS = ("NEAR_BLACK", "NEAR_WHITE", "LOW_VARIANCE", "NO_EDGES", "EMBEDDED_IMAGE_CONTENT_MISSING", "ICC_PROFILE_FAILURE")
MOST_BLACK, MOST_WHITE, LEAST_SPREAD, LEAST_EDGES, LEAST_FOREGROUND, LEAST_FOREGROUND_BOX = 0.98, 0.99, 0.75, 0.0001, 0.005, 0.05


@dataclass(frozen=True)
class RenderMetrics:
    """What shows whether a page was rendered."""

    minimum: float
    maximum: float
    mean: float
    std: float
    near_black: float
    near_white: float
    foreground: float
    edge_density: float
    components: int
    foreground_box: float

    @classmethod
    def of(cls, image: np.ndarray) -> RenderMetrics:
        g = to_gray(image)
        dark = g < 240
        boxes = mask_boxes(dark)
        box = (boxes[:, 2].max() - boxes[:, 0].min()) * (boxes[:, 3].max() - boxes[:, 1].min()) / g.size if len(boxes) else 0.0
        return cls(
            float(g.min()), float(g.max()), float(g.mean()), float(g.std()), float((g <= 8).mean()), float((g >= 247).mean()), float(dark.mean()),
            edge_density(g), int((boxes[:, 4] >= 4).sum()), float(box),
        )

    def reasons(self, expects_image: bool = False, icc_failure: bool = False) -> list[str]:
        """Codes of what makes the picture suspicious."""
        empty = expects_image and (self.foreground < LEAST_FOREGROUND or self.foreground_box < LEAST_FOREGROUND_BOX)
        hits = (self.near_black > MOST_BLACK, self.near_white > MOST_WHITE, self.std < LEAST_SPREAD, self.edge_density < LEAST_EDGES, empty, icc_failure)
        return [code for code, hit in zip(SUSPICIONS, hits, strict=True) if hit]

    def as_dict(self) -> dict:
        return asdict(self)


METRICS_SCHEMA = ", ".join(f"{f.name} {'bigint' if f.name == 'components' else 'double'}" for f in fields(RenderMetrics))


def edge_density(gray: np.ndarray, low: float = 60.0, high: float = 180.0) -> float:
    """Share of edge pixels: strong gradients, and weaker ones joined to them."""
    if min(gray.shape) < 3:
        return 0.0
    g = np.pad(gray.astype(np.int16), 1, mode="edge")
    down, across = g[:-2] + 2 * g[1:-1] + g[2:], g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    size = np.abs(down[:, 2:] - down[:, :-2]) + np.abs(across[2:] - across[:-2])
    weak = size > low
    row, start, stop = runs_of(weak)
    if not len(row):
        return 0.0
    number, count = components_of(weak.shape[1], row, start, stop)
    passed = np.append(0, np.cumsum(size > high))
    first = row * weak.shape[1]
    strong = np.zeros(count, bool)
    strong[number[passed[first + stop] > passed[first + start]]] = True
    return float((stop - start)[strong[number]].sum() / weak.size)


def dominant_image(areas: list[tuple[float, int]], page_area: float, least: float = 0.5) -> int | None:
    """Reference of the image that covers most of the page, if it covers half of it."""
    best = max(((a / page_area, ref) for a, ref in areas if page_area > 0), default=None)
    return best[1] if best and best[0] >= least else None


def place_image(image: np.ndarray, page_width: float, page_height: float, rect: tuple[float, float, float, float], dpi: int) -> np.ndarray:
    """A decoded image on a white page at the given resolution."""
    k = dpi / 72
    h, w = max(1, round(page_height * k)), max(1, round(page_width * k))
    page = np.full((h, w, *image.shape[2:]), 255, np.uint8)
    x0, y0, x1, y1 = (max(0, round(v * k)) for v in rect)
    x1, y1 = min(w, x1), min(h, y1)
    if x1 > x0 and y1 > y0:
        ys = np.minimum(((np.arange(y1 - y0) + 0.5) * image.shape[0] / (y1 - y0)).astype(int), image.shape[0] - 1)
        xs = np.minimum(((np.arange(x1 - x0) + 0.5) * image.shape[1] / (x1 - x0)).astype(int), image.shape[1] - 1)
        page[y0:y1, x0:x1] = image[ys][:, xs]
    return page


def render_with_fallbacks(first, fallbacks, expects_image: bool) -> tuple[np.ndarray, RenderMetrics, str]:
    """The first rendering that passes the checks; a black one may pass inverted. Raises if none does."""
    image = first()
    metrics = RenderMetrics.of(image)
    if not metrics.reasons(expects_image):
        return image, metrics, ""
    for name, attempt in fallbacks:
        try:
            other = attempt()
        except (OSError, ValueError, KeyError):
            continue
        if other is None:
            continue
        seen = RenderMetrics.of(other)
        if seen.near_black > MOST_BLACK:
            flipped = invert(other)
            turned = RenderMetrics.of(flipped)
            if not turned.reasons(expects_image) and turned.edge_density > seen.edge_density:
                return flipped, turned, name
        if not seen.reasons(expects_image):
            return other, seen, name
    raise ValueError("page could not be rendered: " + ", ".join(metrics.reasons(expects_image)))
