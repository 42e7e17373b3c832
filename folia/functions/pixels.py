"""What an image's pixels tell: light, colour, edges, parts and balance, in numpy within an Arrow batch."""

from __future__ import annotations

import numpy as np

#: What is bright and grey enough for background, the least area of a part, the two thresholds of edges.
BACKGROUND_GREY, BACKGROUND_SATURATION, LEAST_PART, EDGE_LOW, EDGE_HIGH = 245, 25, 30, 100, 200

FEATURES = (
    "brightness_mean", "brightness_std", "saturation_mean", "saturation_std", "grayscale_entropy", "quantized_color_count", "color_entropy", "dominant_color_ratio", "edge_density", "gradient_mean", "gradient_std",
    "laplacian_variance", "whitespace_ratio", "non_background_ratio", "connected_component_count", "mean_component_area_ratio", "contour_count", "edge_grid_entropy_3x3", "non_background_grid_entropy_3x3",
    "edge_grid_std_3x3", "non_background_grid_std_3x3", "visual_center_x_norm", "visual_center_y_norm", "horizontal_balance_difference", "vertical_balance_difference",
)


def entropy(counts: np.ndarray) -> float:
    """Bits of a distribution given by counts; 0 for none."""
    p = counts[counts > 0] / max(1.0, float(counts.sum()))
    return float(-(p * np.log2(p)).sum()) + 0.0


def connected(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """``(labels, n)``: the connected parts of a mask, numbered from 1 by first row, then column. Runs of a row are joined to those they touch in the row above by union-find."""
    parent: list[int] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    reach, above, rows = int(diagonal), [], []
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for y in range(mask.shape[0]):
        runs, k = [], 0
        for a, z in zip(np.flatnonzero(edge[y] == 1).tolist(), np.flatnonzero(edge[y] == -1).tolist(), strict=True):
            me = len(parent)
            parent.append(me)
            while k < len(above) and above[k][1] + reach <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < z + reach:
                p, q = root(me), root(above[j][2])
                parent[max(p, q)] = min(p, q)
                j += 1
            runs.append((a, z, me))
        rows.append(runs)
        above = runs
    names: dict[int, int] = {}
    out = np.zeros(mask.shape, np.int32)
    for y, runs in enumerate(rows):
        for a, z, me in runs:
            out[y, a:z] = names.setdefault(root(me), len(names) + 1)
    return out, len(names)


def gradients(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Horizontal and vertical derivative by the 3 by 3 operator with weights 1, 2, 1; borders mirrored."""
    g = np.pad(grey.astype(float), 1, mode="reflect" if min(grey.shape) > 1 else "edge")
    smooth_y = g[:-2] + 2 * g[1:-1] + g[2:]
    smooth_x = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return smooth_y[:, 2:] - smooth_y[:, :-2], smooth_x[2:] - smooth_x[:-2]


def edges(gx: np.ndarray, gy: np.ndarray, low: float = EDGE_LOW, high: float = EDGE_HIGH) -> np.ndarray:
    """Thin edges: places where the gradient is greatest along its direction, above ``low`` and connected to one above ``high``."""
    size = np.abs(gx) + np.abs(gy)
    big = np.pad(size, 1)
    h, w = size.shape
    at = lambda dy, dx: big[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    angle = np.mod(np.rad2deg(np.arctan2(gy, gx)), 180.0)
    keep = np.zeros(size.shape, bool)
    for lo, hi, (dy, dx) in ((0, 22.5, (0, 1)), (157.5, 180.1, (0, 1)), (22.5, 67.5, (1, 1)), (67.5, 112.5, (1, 0)), (112.5, 157.5, (1, -1))):
        keep |= (angle >= lo) & (angle < hi) & (size > at(-dy, -dx)) & (size >= at(dy, dx))
    weak = keep & (size > low)
    labels, n = connected(weak)
    strong = np.zeros(n + 1, bool)
    strong[labels[weak & (size > high)]] = True
    strong[0] = False
    return strong[labels]


def outer_parts(mask: np.ndarray) -> int:
    """How many connected parts of a mask lie outside all others: those that touch the background that reaches the border."""
    labels, n = connected(mask)
    if not n:
        return 0
    back, _ = connected(np.pad(~mask, 1, constant_values=True), diagonal=False)
    outside = back == back[0, 0]
    h, w = mask.shape
    near = outside[:-2, 1:-1] | outside[2:, 1:-1] | outside[1:-1, :-2] | outside[1:-1, 2:] | outside[:-2, :-2] | outside[2:, 2:] | outside[:-2, 2:] | outside[2:, :-2]
    return len(np.unique(labels[near[:h, :w] & mask]))


def grid_sums(mask: np.ndarray, n: int = 3) -> np.ndarray:
    """Set pixels in each of ``n`` by ``n`` cells, by rows, cell bounds rounded."""
    ys, xs = ([int(round(k * side / n)) for k in range(n + 1)] for side in mask.shape)
    return np.array([mask[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].sum() for i in range(n) for j in range(n)], float)


def pixel_features(rgb: np.ndarray) -> dict[str, float]:
    """The 25 features of an image given as rows of red, green, blue bytes."""
    a = rgb.astype(float)
    h, w = a.shape[:2]
    grey = np.floor(a @ np.array([0.299, 0.587, 0.114]) + 0.5)
    most, least = a.max(2), a.min(2)
    sat = np.floor(255.0 * np.divide(most - least, most, out=np.zeros_like(most), where=most > 0) + 0.5)
    colours = np.bincount((rgb.astype(int) // 16 @ np.array([256, 16, 1])).ravel(), minlength=4096)
    gx, gy = gradients(grey)
    steep = np.hypot(gx, gy)
    p = np.pad(grey, 1, mode="reflect" if min(h, w) > 1 else "edge")
    bend = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    edge = edges(gx, gy)
    ink = ~((grey > BACKGROUND_GREY) & (sat < BACKGROUND_SATURATION))
    labels, n = connected(ink)
    areas = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    areas = areas[areas >= LEAST_PART]
    eg, ig = grid_sums(edge), grid_sums(ink)
    total = float(ink.sum())
    ys, xs = np.nonzero(ink)
    uneven = lambda first, rest: abs(float(first.sum()) - float(rest.sum())) / total if total else 0.0
    values = (
        grey.mean() / 255, grey.std() / 255, sat.mean() / 255, sat.std() / 255, entropy(np.bincount(grey.astype(int).ravel(), minlength=256)), np.count_nonzero(colours), entropy(colours), colours.max() / (h * w),
        edge.mean(), steep.mean() / 255, steep.std() / 255, bend.var(), 1 - ink.mean(), ink.mean(), len(areas), areas.mean() / (h * w) if len(areas) else 0.0, outer_parts(edge),
        entropy(eg) / np.log2(9), entropy(ig) / np.log2(9), eg.std(), ig.std(), xs.mean() / w if total else 0.5, ys.mean() / h if total else 0.5,
        uneven(ink[:, : w // 2], ink[:, w // 2 :]), uneven(ink[: h // 2], ink[h // 2 :]),
    )
    return {k: round(float(v), 8 if k == "mean_component_area_ratio" else 6) for k, v in zip(FEATURES, values, strict=True)}


def shrink(rgb: np.ndarray, longest: int) -> np.ndarray:
    """An image at most ``longest`` pixels a side: means over blocks of pixels."""
    h, w = rgb.shape[:2]
    step = -(-max(h, w) // longest)
    if step <= 1:
        return rgb
    part = np.pad(rgb.astype(float), ((0, -h % step), (0, -w % step), (0, 0)), mode="edge")
    return np.floor(part.reshape(part.shape[0] // step, step, part.shape[1] // step, step, 3).mean((1, 3)) + 0.5).astype(np.uint8)


def difference_hash(rgb: np.ndarray, n: int = 8) -> str:
    """64 bits, each whether a block is darker than the one to its right, on a grid of 9 by 8 block means."""
    grey = rgb.astype(float) @ np.array([0.299, 0.587, 0.114])
    cut = lambda side, k: np.linspace(0, side, k + 1).astype(int)
    ys, xs = cut(grey.shape[0], n), cut(grey.shape[1], n + 1)
    cell = lambda i, j: grey[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean()
    bits = "".join("1" if cell(i, j + 1) > cell(i, j) else "0" for i in range(n) for j in range(n))
    return f"{int(bits, 2):016x}"
