"""Frame operators: one row per frame with its pixels as an array in row-major order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def apply_mask(pixels: Column, mask: Column) -> Column:
    """Pixels under a 0/1 mask; without a mask they stay."""
    return F.when(mask.isNull(), pixels).otherwise(F.zip_with(pixels, mask, lambda p, m: p * m))


def top_redaction(pixels: Column, row_values: Column, height: Column) -> Column:
    """Zero the top ``height`` rows of ``row_values`` values each."""
    return F.transform(pixels, lambda p, i: F.when(i < height * row_values, 0).otherwise(p))


def threshold(pixels: Column, level: int, invert: bool = False) -> Column:
    return F.transform(pixels, lambda p: F.when((p > level) if invert else (p < level), 0).otherwise(p))


def frame_diff(a: Column, b: Column) -> Column:
    """Absolute differences over the common length."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.abs(x - y))


def skip_frames(frames: DataFrame, skip: int) -> DataFrame:
    return frames.where(F.col("frame_no") % (skip + 1) == 0)


#: What the pixels of one channel, and of three, are called.
GREY, COLOUR = "MONOCHROME2", "YBR_FULL_422"


def image_attributes(frames: DataFrame) -> DataFrame:
    """(clip_id, frames, height, width, samples, photometric) of each clip."""
    sizes = frames.groupBy("clip_id").agg(F.count("*").alias("frames"), F.max("height").alias("height"), F.max("width").alias("width"), F.max("channels").alias("samples"))
    return sizes.withColumn("photometric", F.when(F.col("samples") == 1, GREY).otherwise(COLOUR))


def percentile_bounds(frames: DataFrame, low: float, high: float) -> DataFrame:
    """Interpolated percentiles of each frame's own values."""
    v = F.array_sort(F.transform("pixels", lambda p: p.cast("double")))

    def at(q: float) -> Column:
        where = (F.size("pixels") - 1) * q
        lo = F.floor(where).cast("int")
        a, b = F.get(v, lo), F.get(v, F.least(lo + 1, F.size("pixels") - 1))
        return a + (b - a) * (where - lo)

    return frames.withColumns({"low": at(low), "high": at(high)})


def bilinear(pixels: Column, width: Column | int, height: Column | int, x: Column, y: Column, channels: Column | int = 1, channel: Column | int = 0) -> Column:
    """Value of one of the interleaved channels at a fractional position, edges repeated."""
    width, height = (F.lit(n) if isinstance(n, int) else n for n in (width, height))
    x, y = F.least(F.greatest(x, F.lit(0.0)), width - 1.0), F.least(F.greatest(y, F.lit(0.0)), height - 1.0)
    x0, y0 = F.floor(x).cast("int"), F.floor(y).cast("int")
    x1, y1 = F.least(x0 + 1, width - 1), F.least(y0 + 1, height - 1)
    at = lambda i, j: F.get(pixels, ((j * width + i) * channels + channel).cast("int"))
    fx, fy = x - x0, y - y0
    return (1 - fx) * (1 - fy) * at(x0, y0) + fx * (1 - fy) * at(x1, y0) + (1 - fx) * fy * at(x0, y1) + fx * fy * at(x1, y1)


def sample_line(frames: DataFrame, x1: float, y1: float, x2: float, y2: float, points: int) -> DataFrame:
    """(clip_id, frame_no, depth, v): values along a segment, from the end point with the larger y; of colour the channels' mean."""
    each = sample_channels(frames, x1, y1, x2, y2, points)
    return each.select("clip_id", "frame_no", "depth", (F.aggregate("values", F.lit(0.0), lambda a, v: a + v) / F.size("values")).alias("v"))


def sample_channels(frames: DataFrame, x1: float, y1: float, x2: float, y2: float, points: int) -> DataFrame:
    """(clip_id, frame_no, depth, values): like ``sample_line``, the value of each channel."""
    if y1 < y2:
        x1, y1, x2, y2 = x2, y2, x1, y1
    each = frames.select("clip_id", "frame_no", "pixels", "width", "height", "channels", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("depth"))
    t = F.col("depth") / max(1, points - 1)
    value = lambda c: bilinear(F.col("pixels"), F.col("width"), F.col("height"), F.lit(x1) + t * (x2 - x1), F.lit(y1) + t * (y2 - y1), F.col("channels"), c)
    return each.select("clip_id", "frame_no", "depth", F.transform(F.sequence(F.lit(0), F.col("channels") - 1), value).alias("values"))


def mmode_image(samples: DataFrame) -> DataFrame:
    """One row of the motion image per clip and depth: the samples in frame order."""
    return samples.groupBy("clip_id", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "v"))), lambda s: s["v"]).alias("row"))


#: Frames a second that the paper speed is for.
CINE_RATE = 20.0


def time_zoom(speed: Column, spacing: Column, depth: Column, frames: Column) -> Column:
    """Columns of the motion image for a frame: by paper speed and pixel spacing, but at least as many as make it square."""
    return F.greatest(speed / CINE_RATE / spacing, depth / frames)


def zoom_in_time(samples: DataFrame, zoom: Column) -> DataFrame:
    """(clip_id, depth, column, v): each depth's samples on a grid of ``zoom`` times as many columns, the newest first.

    ``zoom`` is constant in a clip and may lie above or below 1; the first and last columns are the last and first frames, those
    between lie on lines between two neighbours. Frames count by their order. A grid of no column has no rows.
    """
    order, whole = W.partitionBy("clip_id", "depth").orderBy("frame_no"), W.partitionBy("clip_id", "depth")
    at = samples.select("clip_id", "depth", "v", F.lead("v").over(order).alias("after"), (F.row_number().over(order) - 1).cast("long").alias("a"), F.count("*").over(whole).alias("n"), zoom.alias("zoom"))
    sized = at.withColumn("m", F.rint(F.col("n") * F.col("zoom")).cast("long"))
    gaps, steps = F.greatest(F.col("n") - 1, F.lit(1)), F.col("m") - 1
    raised = lambda x: ((x + gaps - 1 - F.pmod(x + gaps - 1, gaps)) / gaps).cast("long")
    begin = raised(F.col("a") * steps)
    upto = F.when(F.col("after").isNull(), steps).otherwise(raised((F.col("a") + 1) * steps) - 1)
    cells = sized.where((F.col("m") > 0) & (begin <= upto)).select("*", F.explode(F.sequence(begin, upto)).alias("i"))
    part = F.when(F.col("after").isNull() | (steps == 0), F.lit(0.0)).otherwise((F.col("i") * gaps - F.col("a") * steps) / steps)
    return cells.select("clip_id", "depth", (steps - F.col("i")).alias("column"), (F.col("v") + F.coalesce(F.col("after") - F.col("v"), F.lit(0.0)) * part).alias("v"))


def dense_segmentation(frames: DataFrame, captured: DataFrame) -> DataFrame:
    """Every frame with its label map, zeros where none was captured."""
    return frames.select("clip_id", "frame_no", "height", "width").join(captured, ["clip_id", "frame_no"], "left").withColumn("labelmap", F.coalesce("labelmap", F.array_repeat(F.lit(0), F.col("height") * F.col("width"))))


def with_transform(frames: DataFrame, transforms: DataFrame) -> DataFrame:
    """``frames`` with ``m``, the 4x4 matrix of each, row by row; the identity where none is given."""
    identity = F.array(*(F.lit(float(i % 5 == 0)) for i in range(16)))
    return frames.join(transforms.select("clip_id", "frame_no", "m"), ["clip_id", "frame_no"], "left").withColumn("m", F.coalesce("m", identity))


def trilinear(x: Column, y: Column, z: Column) -> Column:
    """array of the eight neighbour voxels of a point and their weights."""
    low = {a: F.floor(c).cast("int") for a, c in zip("xyz", (x, y, z))}
    part = {a: c - low[a] for a, c in zip("xyz", (x, y, z))}
    corner = lambda i, j, k: F.struct(*((low[a] + d).alias(a) for a, d in zip("xyz", (i, j, k))), ((part["x"] if i else 1 - part["x"]) * (part["y"] if j else 1 - part["y"]) * (part["z"] if k else 1 - part["z"])).alias("w"))
    return F.array(*(corner(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)))


def reslice(points: DataFrame, voxels: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Trilinear samples of ``voxels`` (x, y, z, v) at ``points`` (key, px, py, pz), each in the volume named by the columns ``by`` of both; outside is 0."""
    near = points.select("key", *by, F.inline(trilinear(F.col("px"), F.col("py"), F.col("pz")))).where("w > 0")
    return near.join(voxels, [*by, "x", "y", "z"], "left").groupBy("key").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("v"))


def reconstruct(points: DataFrame) -> DataFrame:
    """Label volume: each pixel (clip_id, px, py, pz, v) goes to its neighbour voxels by weight; the largest share stays."""
    near = points.select("clip_id", "v", F.inline(trilinear(F.col("px"), F.col("py"), F.col("pz")))).where("w > 0")
    return near.groupBy("clip_id", "x", "y", "z").agg(F.max(F.col("w") * F.col("v")).alias("v"))
