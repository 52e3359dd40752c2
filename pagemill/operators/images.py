"""Kernels on page images, in numpy: coloured ink, thresholds, boxes of connected marks.

An image is an array of height x width x 3 bytes (red, green, blue). `apply` runs a kernel over a table of encoded images.
Telea's inpainting, local histogram equalisation and sharpening are left to functions that a caller passes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import geometry

#: Half degrees of hue that count as red on both sides of zero, least saturation and value, darkness of text.
HUE, SATURATION, VALUE, DARK = 15, 70, 35, 150
#: Weights of short smoothing kernels.
SMOOTH = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625], 7: [0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125]}


def read_ppm(content: bytes) -> np.ndarray:
    """A binary portable pixmap (P6, 8 bits). Other formats need a decoder of the caller's."""
    head = re.match(rb"P6\s+(\d+)\s+(\d+)\s+255\s", content or b"")
    if not head:
        raise ValueError("not an 8-bit P6 pixmap")
    width, height = int(head[1]), int(head[2])
    return np.frombuffer(content, np.uint8, width * height * 3, head.end()).reshape(height, width, 3)


def write_ppm(image: np.ndarray) -> bytes:
    """The pixmap of an image, or of a grey plane."""
    full = np.stack([image] * 3, axis=-1) if image.ndim == 2 else image
    return b"P6 %d %d 255\n" % (full.shape[1], full.shape[0]) + np.ascontiguousarray(full, np.uint8).tobytes()


def red_ink(image: np.ndarray, saturation: int = SATURATION, value: int = VALUE) -> np.ndarray:
    """Where red ink is. Integers alone: hue is rounded to half degrees, saturation to 255ths, without dividing."""
    r, g, b = (image[..., i].astype(np.int64) for i in range(3))
    v, low = image.max(axis=-1).astype(np.int64), image.min(axis=-1).astype(np.int64)
    spread = v - low
    hue = (r == v) & ((60 * np.abs(g - b) < (2 * HUE + 1) * spread) | (spread == 0))
    return hue & (510 * spread >= (2 * max(0, saturation) - 1) * np.maximum(v, 1)) & (v >= max(0, value))


def _window(mask: np.ndarray, k: int, outside: bool) -> np.ndarray:
    padded = np.pad(mask, (k // 2, k - 1 - k // 2), constant_values=outside)
    return sliding_window_view(padded, (k, k))


def opened(mask: np.ndarray, k: int) -> np.ndarray:
    """Without specks smaller than k x k; what is left is widened once more."""
    if k <= 1:
        return mask
    eroded = _window(mask, k, True).all(axis=(2, 3))
    dilated = _window(eroded, k, False).any(axis=(2, 3))
    return _window(dilated, k, False).any(axis=(2, 3))


def without_ink(image: np.ndarray, mask: np.ndarray, strategy: str = "preserve_text", dark: int = DARK, fill: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """The image, white under the mask. preserve_text keeps what is dark in green or blue, as grey; inpaint calls `fill`."""
    if strategy == "inpaint" and fill is not None:
        return fill(image, mask)
    out = image.copy()
    out[mask] = 255
    if strategy == "preserve_text":
        grey = image[..., 1:].min(axis=-1)
        text = mask & (grey < dark)
        out[text] = grey[text][:, None]
    return out


def ink_layer(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The ink alone on white."""
    return np.where(mask[..., None], image, np.uint8(255))


def clean_crop(crop: np.ndarray, box: tuple, markers: list[tuple], k: int = 1, strategy: str = "preserve_text", **options) -> np.ndarray:
    """The crop of a box without the red ink of markers that overlap it; ink elsewhere stays.

    Markers are in page coordinates; corners are cut to whole pixels and both edges of a marker belong to it.
    """
    x, y, x2, y2 = box
    width, height = max(1, int(x2 - x)), max(1, int(y2 - y))
    near = np.zeros(crop.shape[:2], dtype=bool)
    for a, b, c, d in markers:
        if a < x2 and c > x and b < y2 and d > y:
            left, top, right, bottom = max(0, int(a - x)), max(0, int(b - y)), min(width, int(c - x)), min(height, int(d - y))
            if right > left and bottom > top:
                near[top : bottom + 1, left : right + 1] = True
    mask = opened(red_ink(crop) & near, k)
    return without_ink(crop, mask, strategy, **options) if mask.any() else crop


def grey(image: np.ndarray) -> np.ndarray:
    return np.floor(image @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def smoothed(plane: np.ndarray, k: int, border: str = "reflect") -> np.ndarray:
    """Gaussian mean over k x k (an even k counts as k + 1)."""
    k = max(1, k) | 1
    if k == 1 and plane.dtype == np.uint8:
        return plane
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    weights = np.array(SMOOTH[k]) if k in SMOOTH else np.exp(-((np.arange(k) - k // 2) ** 2) / (2 * sigma * sigma))
    weights = weights / weights.sum()
    out = plane.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k // 2)
        out = sliding_window_view(np.pad(out, pad, mode=border if out.shape[axis] > 1 else "edge"), k, axis=axis) @ weights
    return np.floor(out + 0.5).astype(np.uint8)


def otsu(plane: np.ndarray) -> int:
    """The grey value, darker side included, that splits the histogram with the most variance between both sides."""
    p = np.bincount(plane.ravel(), minlength=256) / plane.size
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean[-1] * weight - mean) ** 2 / (weight * (1 - weight))
    return int(np.argmax(np.where((weight > 1e-9) & (weight < 1 - 1e-9), between, -1.0)))


def marks(plane: np.ndarray, mode: str = "adaptive", blur: int = 3, block: int = 31, c: int = 11) -> np.ndarray:
    """Where a grey page is dark: against one threshold (otsu) or the surroundings' mean less c (adaptive)."""
    plane = smoothed(plane, blur)
    if mode == "otsu":
        return plane <= otsu(plane)
    return plane.astype(np.int64) <= smoothed(plane, block, "edge").astype(np.int64) - c


def _runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """First and last-but-one places of all rows' runs, the number from 1 of each run's region, and how many regions there are.

    Places count along rows that are one wider on either side, so runs of different rows don't touch. All runs are found at
    once, then each is joined with those it meets in the row above.
    """
    step, reach = mask.shape[1] + 2, int(diagonal)
    wide = np.zeros((mask.shape[0], step), dtype=bool)
    wide[:, 1:-1] = mask
    flat = wide.ravel()
    edges = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    first, last = np.searchsorted(stops, starts - step - reach, "right"), np.searchsorted(starts, stops - step + reach, "left")
    above = list(range(len(starts)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for run, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for other in range(a, b):
            one, two = top(run), top(other)
            above[max(one, two)] = min(one, two)
    numbers, n = np.zeros(len(above), dtype=np.int64), 0
    for run, other in enumerate(above):
        if run == other:  # a region's first run is its own top
            n += 1
        numbers[run] = n if run == other else numbers[top(run)]
    return starts, stops, numbers, n


def _painted(mask: np.ndarray, starts: np.ndarray, stops: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    out = np.zeros(mask.shape, dtype=np.int64)
    out[mask] = np.repeat(numbers, stops - starts)
    return out


def regions(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, int]:
    """Numbers from 1 of connected regions, 0 elsewhere, and how many there are."""
    *runs, n = _runs(mask, diagonal)
    return _painted(mask, *runs), n


def _free(mask: np.ndarray, numbered: np.ndarray, n: int, paper: np.ndarray) -> np.ndarray:
    """Which regions touch the paper around the page."""
    outer = paper == paper[0, 0]
    beside = outer[:-2, 1:-1] | outer[2:, 1:-1] | outer[1:-1, :-2] | outer[1:-1, 2:]
    free = np.zeros(n + 1, dtype=bool)
    free[numbered[mask & beside]] = True
    return free


def mark_boxes(mask: np.ndarray, min_area: float = 16, max_ratio: float = 0.03, min_width: int = 2, min_height: int = 6, most: int = 5000) -> list[tuple[float, float, float, float]]:
    """Boxes of connected marks by vertical centre, then left edge. Marks inside the holes of others don't count."""
    if not mask.any():
        return []
    starts, stops, numbers, n = _runs(mask, True)
    around = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), dtype=bool)
    around[1:-1, 1:-1] = ~mask
    *paper, papers = _runs(around, False)
    # paper without holes touches every mark
    free = np.ones(n + 1, dtype=bool) if papers == 1 else _free(mask, _painted(mask, starts, stops, numbers), n, _painted(around, *paper))
    ys, xs = np.divmod(starts, mask.shape[1] + 2)
    low, high = np.full((2, n + 1), np.iinfo(np.int64).max), np.full((2, n + 1), -1)
    for i, first, behind in ((0, xs - 1, xs - 1 + stops - starts), (1, ys, ys + 1)):
        np.minimum.at(low[i], numbers, first)
        np.maximum.at(high[i], numbers, behind)
    limit = max(1.0, max_ratio * mask.size)
    found = []
    for keep, left, upper, right, lower in list(zip(free.tolist(), *low.tolist(), *high.tolist(), strict=True))[1:]:
        width, height = right - left, lower - upper
        if keep and min_area <= width * height <= limit and width >= min_width and height >= min_height:
            found.append((float(left), float(upper), float(right), float(lower)))
    return sorted(found, key=lambda b: ((b[1] + b[3]) / 2, b[0]))[:most]


def variants(crop: np.ndarray, most: int = 5, more: dict[str, Callable[[np.ndarray], np.ndarray]] | None = None) -> list[tuple[str, np.ndarray]]:
    """The crop and other renderings of it to recognise, `most` in all: those of the caller, then both thresholds."""
    plane = grey(crop)
    made = {"base": lambda _: crop, **(more or {}), "adaptive": lambda _: np.where(marks(plane, blur=1), 0, 255).astype(np.uint8), "otsu": lambda _: np.where(marks(plane, "otsu", blur=1), 0, 255).astype(np.uint8)}
    return [(name, f(crop)) for name, f in list(made.items())[: max(1, most)]]


def _stretched(image: np.ndarray, size: int, axis: int) -> np.ndarray:
    """An axis brought to a larger size: a cubic through four neighbours, fewer at the edges."""
    old = image.shape[axis]
    centre = (np.arange(size) + 0.5) * old / size
    first = np.floor(centre - 0.5).astype(np.int64) - 1
    shape = [-1 if a == axis else 1 for a in range(image.ndim)]
    out, total = 0.0, np.zeros(size)
    for at in (first + k for k in range(4)):
        d = np.abs(at + 0.5 - centre)
        weight = np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, ((2.5 - 0.5 * d) * d - 4) * d + 2) * ((at >= 0) & (at < old))
        out, total = out + np.take(image, np.clip(at, 0, old - 1), axis) * weight.reshape(shape), total + weight
    return np.clip(np.floor(out / total.reshape(shape) + 0.5), 0, 255)


def enlarged(image: np.ndarray, scale: float) -> np.ndarray:
    """The image with both sides multiplied and cut to whole pixels; as it is for scales up to 1."""
    if scale <= 1.0 or not image.size:
        return image
    wide = _stretched(image.astype(np.float64), int(image.shape[1] * scale), 1)
    return _stretched(wide, int(image.shape[0] * scale), 0).astype(np.uint8)


#: Width of the surroundings and distance to their mean, by which a crop becomes black and white.
CROP_BLOCK, CROP_C = 35, 11


def prepared(crop: np.ndarray, mode: str = "none", scale: float = 1.0) -> np.ndarray:
    """A crop to recognise: as it is, in grey (`gray`) or black and white (`adaptive`), then enlarged."""
    if mode == "gray":
        crop = np.stack([grey(crop)] * 3, axis=-1)
    elif mode == "adaptive":
        crop = np.stack([np.where(marks(grey(crop), blur=1, block=CROP_BLOCK, c=CROP_C), 0, 255).astype(np.uint8)] * 3, axis=-1)
    return enlarged(crop, scale)


def crops(images: DataFrame, boxes: DataFrame, pad: int = 0, kernel: Callable[[np.ndarray], np.ndarray] = lambda crop: crop, decode: Callable[[bytes], np.ndarray] = read_ppm, encode: Callable[[np.ndarray], bytes] = write_ppm) -> DataFrame:
    """page_id, box_id, crop and errors of each box (page_id, box_id, x1, y1, x2, y2): what the kernel makes of its part of the page's image (page_id, content).

    Boxes are cut to whole numbers, padded and kept on the page. A page's image is moved and decoded once, with all its
    boxes. A box of a missing or unreadable image, one outside the page and one with a null edge are rows with errors.
    """
    of = boxes.groupBy("page_id").agg(F.collect_list(F.struct(F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in geometry.BOX])).alias("boxes"))
    pages = of.join(images.select("page_id", "content"), "page_id", "left").select(F.col("page_id").cast("long").alias("page_id"), "content", "boxes")

    def cut(image: np.ndarray, box: dict) -> bytes:
        x1, y1, x2, y2 = (int(box[c]) for c in geometry.BOX)
        part = image[max(0, y1 - pad) : max(0, y2 + pad), max(0, x1 - pad) : max(0, x2 + pad)]
        if not part.size:
            raise ValueError("nothing of the box is on the page")
        return encode(kernel(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("box_id", pa.int64()), ("crop", pa.binary()), ("errors", pa.list_(pa.string()))])
        for batch in batches:
            for page, content, some in zip(*(batch.column(c) for c in ("page_id", "content", "boxes")), strict=True):
                rows, image, failed = [], None, None
                try:
                    image = decode(content.as_py())
                except Exception as e:  # noqa: BLE001  an unreadable image is an error of each of its boxes
                    failed = f"{type(e).__name__}: {e}"
                for box in some.as_py():
                    crop, error = None, failed
                    if image is not None:
                        try:
                            crop = cut(image, box)
                        except Exception as e:  # noqa: BLE001  one box's failure is that box's row
                            error = f"{type(e).__name__}: {e}"
                    rows.append({"page_id": page.as_py(), "box_id": box["box_id"], "crop": crop, "errors": [error] if error else None})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.mapInArrow(run, "page_id long, box_id long, crop binary, errors array<string>")


#: Settings of `characters` where the caller's have none (fixed values).
CHARACTERS = {"blur_kernel": 3, "threshold_mode": "adaptive", "adaptive_block_size": 31, "adaptive_c": 11, "min_area": 16, "max_area_ratio": 0.03, "min_w": 2, "min_h": 6, "max_boxes": 5000, "line_thresh": 0.6, "label_limit": 120, "gallery_limit": 120, "gallery_columns": 12}


def characters(images: DataFrame, config: dict | None = None, decode: Callable[[bytes], np.ndarray] = read_ppm) -> DataFrame:
    """The marks of each image (page_id, content): box, det_seq by vertical centre, line_no and reading_rank, labels, place in a gallery.

    label and reading_label number the first marks of either order and are empty for the rest; row and column place the
    first marks of the reading order, and are null for the rest. An image without marks, or unreadable, has no rows.
    """
    c = {**CHARACTERS, **(config or {})}

    def kernel(image: np.ndarray) -> list[dict]:
        mask = marks(grey(image), str(c["threshold_mode"]), int(c["blur_kernel"]), int(c["adaptive_block_size"]), int(c["adaptive_c"]))
        found = mark_boxes(mask, int(c["min_area"]), float(c["max_area_ratio"]), int(c["min_w"]), int(c["min_h"]), int(c["max_boxes"]))
        return [{"det_seq": n, **dict(zip(geometry.BOX, box, strict=True))} for n, box in enumerate(found, 1)]

    found = apply(images, kernel, "det_seq int, x1 double, y1 double, x2 double, y2 double", decode).where("errors is null")
    placed = geometry.lines(found, float(c["line_thresh"]), by_centre=True, carry=geometry.BOX)
    at = F.col("reading_rank") - 1
    shown, wide = at < max(1, int(c["gallery_limit"])), max(1, int(c["gallery_columns"]))
    label = [F.when(F.col(n) <= int(c["label_limit"]), F.col(n).cast("string")).otherwise("") for n in ("det_seq", "reading_rank")]
    return placed.withColumns({"label": label[0], "reading_label": label[1], "row": F.when(shown, F.floor(at / wide).cast("int")), "column": F.when(shown, (at % wide).cast("int"))})


def apply(images: DataFrame, kernel: Callable[[np.ndarray], list[dict]], schema: str, decode: Callable[[bytes], np.ndarray] = read_ppm) -> DataFrame:
    """Rows that the kernel makes of each image (page_id, content), with page_id and errors; a null image is an error too.

    schema names the kernel's columns. An image that can't be read is a row with errors and nulls.
    """
    from pyspark.sql.types import StructType

    own = StructType.fromDDL(schema)
    full = StructType.fromDDL(f"page_id long, errors array<string>, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        for batch in batches:
            rows = []
            for page, content in zip(batch.column("page_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [{"page_id": page, "errors": None, **r} for r in kernel(decode(content))]
                except Exception as e:  # noqa: BLE001  one image's failure is that image's row
                    rows.append({"page_id": page, "errors": [f"{type(e).__name__}: {e}"], **dict.fromkeys(own.names)})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return images.select("page_id", "content").mapInArrow(run, full)
