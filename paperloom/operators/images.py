"""Image clean-up: numpy kernels per image, and relational forms over pixel rows (img_id, y, x, v)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from paperloom.session import ship_package

#: The side below which images are enlarged and by how much at most, and the reach and offset of the local threshold.
LONG_SIDE_AT_LEAST, UPSCALE_MOST, REACH, OFFSET = 2500, 3.0, 35, 12


# --- relational forms -------------------------------------------------------------------------


def line(by: str, order: str) -> WindowSpec:
    """The pixels of one row or column of an image.

    A number of image and place comes first, as sorting looks at the first key alone where it can.
    """
    number = F.coalesce(F.shiftleft(F.col("img_id").try_cast("long"), 32), F.lit(0)) + F.col(by)
    return Window.partitionBy(number, "img_id", by).orderBy(order)


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b).cast("int")


def brightness(pixels: DataFrame) -> DataFrame:
    """(img_id, brightness): mean over every fourth pixel each way; 128 without any."""
    sampled = pixels.groupBy("img_id").agg(F.avg(F.when((F.col("x") % 4 == 0) & (F.col("y") % 4 == 0), F.col("v"))).alias("m"))
    return sampled.select("img_id", F.coalesce("m", F.lit(128.0)).alias("brightness"))


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))


def clip_points(pixels: DataFrame) -> DataFrame:
    """(img_id, low, high): the grey values at the brightness-dependent percentiles."""
    image = Window.partitionBy("img_id")
    sampled = F.when((F.col("x") % 4 == 0) & (F.col("y") % 4 == 0), F.col("v"))
    # The bins tell the brightness too, so pixels are read once.
    h = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"), F.count(sampled).alias("m"))
    light = F.sum(F.col("v") * F.col("m")).over(image) / F.nullif(F.sum("m").over(image), F.lit(0))
    h = h.withColumns({"c": F.sum("n").over(image.orderBy("v")), "total": F.sum("n").over(image), "brightness": F.coalesce(light, F.lit(128.0))})
    low = F.floor(F.col("total") * F.when(F.col("brightness") < 80, 0.02).otherwise(0.01))
    high = F.floor(F.col("total") * F.when(F.col("brightness") > 200, 0.98).otherwise(0.99))
    # Value 0 can't be the low point unless nothing follows: the search goes on from 1, and bins of no pixels count.
    first = F.min(F.when((F.col("c") >= low) & (F.col("v") > 0), F.col("v")))
    reached0 = F.max(F.when((F.col("v") == 0) & (F.col("c") >= low), 1).otherwise(0))
    none_needed = F.max(F.when(low == 0, 1).otherwise(0))
    out = h.groupBy("img_id").agg(first.alias("f"), reached0.alias("z"), none_needed.alias("k"), F.min(F.when(F.col("c") >= high, F.col("v"))).alias("high"))
    return out.select("img_id", F.when((F.col("z") == 1) | (F.col("k") == 1), F.least(F.lit(1), "high")).otherwise(F.coalesce("f", F.lit(0))).cast("int").alias("low"), F.col("high").cast("int"))


def with_each(pixels: DataFrame, images: DataFrame, how: str = "inner") -> DataFrame:
    """Pixels with what is known of their image: a task holds the rows of its own images.

    Spark takes exploded pixels for as few as the rows they come from and would send them all to the driver, so the join is named.
    """
    return pixels.join(images.hint("shuffle_hash"), "img_id", how)


def stretch(pixels: DataFrame) -> DataFrame:
    """Grey values spread over 0-255 between the clip points; images without a range stay."""
    p = with_each(pixels, clip_points(pixels))
    v = F.least("high", F.greatest("low", "v"))
    out = F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * 255 + 0.5).cast("int")
    return p.select("img_id", "y", "x", F.when(F.col("high") > F.col("low"), out).otherwise(F.col("v")).cast("int").alias("v"))


def moving_sums(df: DataFrame, along: WindowSpec, reach: int, *columns: str) -> DataFrame:
    """Replaces columns by their sums over the rows within ``reach`` each way: differences of running sums, whose cost does not follow the reach."""
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return differences(df.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(upto) for c in columns}), along, reach, *columns)


def differences(df: DataFrame, along: WindowSpec, reach: int, *columns: str) -> DataFrame:
    """Running sums to sums of the rows within ``reach`` each way, cut off at both ends."""
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upper = lambda c: F.coalesce(F.lead(c, reach).over(along), F.last(c).over(whole))
    return df.withColumns({c: upper(c) - F.coalesce(F.lag(c, reach + 1).over(along), F.lit(0)) for c in columns})


def local_threshold(pixels: DataFrame, reach: int = REACH, offset: int = OFFSET) -> DataFrame:
    """0 where a pixel is darker than the mean of its clipped square by more than the offset, else 255; two window passes."""
    across, down = line("y", "x"), line("x", "y")
    p = moving_sums(pixels.withColumns({"s": F.col("v"), "k": F.lit(1)}), across, reach, "s", "k")
    p = moving_sums(p, down, reach, "s", "k")
    return p.select("img_id", "y", "x", F.when(F.col("v") < F.col("s") / F.col("k") - offset, 0).otherwise(255).alias("v"))


def close_gaps(pixels: DataFrame) -> DataFrame:
    """Dark parts grown by a cross of five cells, then shrunk; columns, which the first ends with, are what the second begins with."""
    across, down = line("y", "x"), line("x", "y")

    def crossed(p: DataFrame, pick, first: WindowSpec, second: WindowSpec) -> DataFrame:
        near = lambda over: pick("v", F.lag("v").over(over), F.lead("v").over(over))
        return p.withColumn("half", near(first)).select("img_id", "y", "x", pick("half", near(second)).alias("v"))

    return crossed(crossed(pixels, F.least, across, down), F.greatest, down, across)


def convolve(pixels: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """A 3x3 convolution, rounded and clamped; the border stays."""
    across, down = line("y", "x"), line("x", "y")
    p = pixels.withColumns({"l": F.lag("v").over(across), "r": F.lead("v").over(across)})
    p = p.withColumns({f"{c}{d}": f(c).over(down) for c in ("l", "v", "r") for d, f in (("u", F.lag), ("d", F.lead))})
    cells = [["lu", "vu", "ru"], ["l", "v", "r"], ["ld", "vd", "rd"]]
    total = sum(F.col(c) * k for row, ks in zip(cells, kernel) for c, k in zip(row, ks))
    out = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(total + 0.5))).cast("int")
    edge = F.greatest(*[F.col(c).isNull() for row in cells for c in row])
    return p.select("img_id", "y", "x", F.when(edge, F.col("v")).otherwise(out).cast("int").alias("v"))


#: The kernels.
BLUR = [[1 / 16, 2 / 16, 1 / 16], [2 / 16, 4 / 16, 2 / 16], [1 / 16, 2 / 16, 1 / 16]]
SHARPEN = [[0, -0.2, 0], [-0.2, 1.8, -0.2], [0, -0.2, 0]]


def row_profile(pixels: DataFrame) -> DataFrame:
    """(img_id, variance): population variance of the rows' counts of dark pixels."""
    rows = pixels.groupBy("img_id", "y").agg(F.count_if(F.col("v") < 128).alias("n"))
    return rows.groupBy("img_id").agg(F.var_pop("n").alias("variance"))


# --- numpy kernels ----------------------------------------------------------------------------


def _cubic(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bicubic enlargement in whole numbers: places in 1 / 256, weights in 1 / 2 ** 25, one axis after the other."""

    def axis(n, m):
        place = ((2 * np.arange(m) + 1) * n - m) * 256 // (2 * m)
        i, t = place >> 8, place & 255
        k = np.stack([-(t**3) + 512 * t**2 - 65536 * t, 3 * t**3 - 1280 * t**2 + (1 << 25), -3 * t**3 + 1024 * t**2 + 65536 * t, t**3 - 256 * t**2])
        return np.clip(i + np.arange(-1, 3)[:, None], 0, n - 1), k

    (iy, ky), (ix, kx) = axis(a.shape[0], h), axis(a.shape[1], w)
    a = a.astype(np.int64)
    a = sum(a[i] * k[:, None] for i, k in zip(iy, ky))
    return np.clip((sum(a[:, i] * k for i, k in zip(ix, kx)) + (1 << 49)) >> 50, 0, 255)


def shrink(a: np.ndarray, k: int) -> np.ndarray:
    """Means of cells of k pixels each way, ragged where that does not divide."""
    h, w = max(1, a.shape[0] // k), max(1, a.shape[1] // k)
    y, x = np.arange(a.shape[0]) * h // a.shape[0], np.arange(a.shape[1]) * w // a.shape[1]
    total, n = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64)
    np.add.at(total, (y[:, None], x[None, :]), a.astype(np.int64))
    np.add.at(n, (y[:, None], x[None, :]), 1)
    return (2 * total + n) // (2 * n)


def _turn(tenths: int) -> tuple[int, int]:
    """Sine and cosine of tenths of a degree, in 1 / 65536."""
    r = math.radians(tenths / 10)
    return round(65536 * math.sin(r)), round(65536 * math.cos(r))


def rotate(a: np.ndarray, tenths: int) -> np.ndarray:
    """Bilinear rotation by tenths of a degree on a canvas that holds all of it, white outside."""
    if tenths == 0:
        return a
    s, c = _turn(tenths)
    h, w = a.shape
    nw, nh = (w * c + h * abs(s)) >> 16, (h * c + w * abs(s)) >> 16
    y, x = np.mgrid[0:nh, 0:nw]
    x2, y2 = 2 * x + 1 - nw, 2 * y + 1 - nh
    sx, sy = (c * x2 + s * y2 + ((w - 1) << 16)) >> 9, (-s * x2 + c * y2 + ((h - 1) << 16)) >> 9
    ink = np.pad(255 - a.astype(np.int64), 2)
    x0, y0 = np.clip(sx >> 8, -2, w) + 2, np.clip(sy >> 8, -2, h) + 2
    fx, fy = sx & 255, sy & 255
    total = ink[y0, x0] * (256 - fx) * (256 - fy) + ink[y0, x0 + 1] * fx * (256 - fy) + ink[y0 + 1, x0] * (256 - fx) * fy + ink[y0 + 1, x0 + 1] * fx * fy
    return ((255 << 16) - total + (1 << 15)) >> 16


def skew(a: np.ndarray) -> int:
    """The angle, in tenths of a degree, whose correction gives the rows of dark pixels the greatest variance: coarse steps, then fine ones; first best wins."""
    a = shrink(a, k) if (k := a.shape[1] // 600) > 1 else a
    h, w = a.shape
    y, x = np.nonzero(a < 128)
    # A row is a sum of a part by y and a part by x: pixels look both up, in 32 bits where these hold all sums.
    kind = np.int32 if 2 * h + w < 1 << 15 else np.int64
    x2, y2 = 2 * np.arange(w) + 1 - w, 2 * np.arange(h) + 1 - h
    best, top, tried = 0, -1.0, set()
    for angles in (range(-50, 51, 5), None):
        for d in range(best - 10, best + 11) if angles is None else angles:
            if d in tried:
                continue
            tried.add(d)
            s, c = _turn(d)
            high = (h * c + w * abs(s)) >> 16
            by_y, by_x = c * y2 + (high << 16), s * x2
            least = min(0, (int(by_y.min()) - int(by_x.max())) >> 17)  # rows off the canvas count from here
            row = (by_y - (least << 17)).astype(kind)[y]
            row -= by_x.astype(kind)[x]
            row >>= 17
            n = np.bincount(row, minlength=1)
            v = float(high * int((n * n).sum()) - int(n.sum()) ** 2) / (high * high)
            if v > top:
                best, top = d, v
    return best


def _convolved(a: np.ndarray, kernel: list[list[int]], unit: int) -> np.ndarray:
    """A 3x3 convolution by multiples of 1 / unit, rounded (halves up) and clamped; the border stays."""
    near = a.astype(np.int16)
    total = sum(k * near[1 + i : a.shape[0] - 1 + i, 1 + j : a.shape[1] - 1 + j] for i, row in zip((-1, 0, 1), kernel) for j, k in zip((-1, 0, 1), row) if k)
    out = a.copy()
    out[1:-1, 1:-1] = np.clip((2 * total + unit) // (2 * unit), 0, 255)
    return out


def _thresholded(a: np.ndarray) -> np.ndarray:
    """0 where a pixel is darker than the mean of its clipped square by more than the offset, else 255; sums are differences of the integral image."""
    y, x = np.arange(a.shape[0]), np.arange(a.shape[1])
    y0, y1 = np.maximum(y - REACH, 0), np.minimum(y + REACH + 1, a.shape[0])
    x0, x1 = np.maximum(x - REACH, 0), np.minimum(x + REACH + 1, a.shape[1])
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.int32 if a.size < 1 << 23 else np.int64)
    a.cumsum(0, dtype=total.dtype).cumsum(1, dtype=total.dtype, out=total[1:, 1:])
    total = total.take(y1, 0) - total.take(y0, 0)
    total = total.take(x1, 1) - total.take(x0, 1)
    n = np.outer(y1 - y0, x1 - x0).astype(np.int32)
    return np.where((a + np.int32(OFFSET)) * n < total, 0, 255).astype(np.uint8)


def enhance(rgb: np.ndarray) -> tuple[np.ndarray, dict]:
    """The eight steps for one image (h, w, bands): the cleaned raster and what was measured."""
    h, w = rgb.shape[:2]
    bands = rgb.reshape(h, w, -1).astype(float)
    some = bands[::4, ::4, :3].astype(int)
    light = float((some.sum(axis=2) // some.shape[2]).mean()) if some.size else 128.0
    if min(h, w) < LONG_SIDE_AT_LEAST:
        k = min(LONG_SIDE_AT_LEAST / min(h, w), UPSCALE_MOST)
        bands = np.stack([_cubic(bands[..., c], int(h * k), int(w * k)) for c in range(bands.shape[2])], axis=2)
    a = np.floor(bands[..., :3] @ [0.299, 0.587, 0.114]) if bands.shape[2] >= 3 else bands[..., 0]
    a = a.astype(np.uint8)
    cum = np.cumsum(np.bincount(a.ravel(), minlength=256))
    low_at, high_at = int(a.size * (0.02 if light < 80 else 0.01)), int(a.size * (0.98 if light > 200 else 0.99))
    high = int(np.argmax(cum >= high_at))
    low = min(max(1, int(np.argmax(cum >= low_at))), high)
    if high > low:
        a = np.clip(np.floor((np.clip(np.arange(256), low, high) - low) / (high - low) * 255 + 0.5), 0, 255).astype(np.uint8)[a]
    tenths = skew(a)
    if 8 < abs(tenths) <= 50:
        a = rotate(a, -tenths).astype(np.uint8)
    elif abs(tenths) > 50:
        tenths = 0
    angle = tenths / 10
    for kernel, unit in ((BLUR, 16), (SHARPEN, 5)):
        a = _convolved(a, [[round(k * unit) for k in row] for row in kernel], unit)
    a = _thresholded(a)
    for f in (np.minimum, np.maximum):
        out = a.copy()
        out[1:], out[:-1] = f(out[1:], a[:-1]), f(out[:-1], a[1:])
        out[:, 1:], out[:, :-1] = f(out[:, 1:], a[:, :-1]), f(out[:, :-1], a[:, 1:])
        a = out
    return a, {"low_resolution": w < LOW or h < LOW, "brightness": light, "skew": angle}


def preprocess(images: DataFrame) -> DataFrame:
    """(origin, height, width, data, low_resolution, brightness, skew, error) of rows of Spark's image source (``image.*``)."""
    ship_package(images.sparkSession)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                try:
                    if r.height <= 0:
                        raise ValueError("cannot read image")
                    raw = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                    a, seen = enhance(raw[..., 2::-1] if r.nChannels >= 3 else raw)
                    out.append((r.origin, a.shape[0], a.shape[1], a.tobytes(), seen["low_resolution"], seen["brightness"], seen["skew"], None))
                except Exception as e:  # one bad image is one error row
                    out.append((r.origin, 0, 0, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["origin", "height", "width", "data", "low_resolution", "brightness", "skew", "error"])

    few = images.select("origin", "height", "width", "nChannels", "data")
    return few.mapInPandas(run, "origin string, height int, width int, data binary, low_resolution boolean, brightness double, skew double, error string")


#: The measurements that count as low resolution, dark, overexposed and skewed, and the warnings.
LOW, DARK, LIGHT, SKEWED = 800, 60, 220, 1.0
WARNINGS = {
    "low_resolution": "LOW_RESOLUTION: Image resolution below recommended 800px. Image was upscaled for better OCR.",
    "dark": "DARK_IMAGE: Very dark image detected. Enhanced contrast applied.",
    "overexposed": "OVEREXPOSED: Washed-out image detected. Processing applied.",
    "skewed": "DESKEWED: Document was rotated %.1f°. Auto-corrected for better OCR.",
}


def flags(low_resolution: Column, light: Column, angle: Column) -> dict[str, Column]:
    """What is wrong with an image, in the order of its warnings."""
    return {"low_resolution": low_resolution, "dark": light < DARK, "overexposed": light > LIGHT, "skewed": F.abs(angle) > SKEWED}


def warnings(low_resolution: Column, light: Column, angle: Column) -> Column:
    """The warnings of an image, in order."""
    seen = flags(low_resolution, light, angle)
    return F.array_compact(F.array(*[F.when(seen[k], F.format_string(w, angle) if "%" in w else F.lit(w)) for k, w in WARNINGS.items()]))
