"""Arrow kernels for frames of any size: pixels interleaved by channel, row by row, one batch of rows at a time.

Frames are rows (clip_id, frame_no, height, width, channels, pixels). A frame whose values are not height x width x channels,
or whose channels are not 1, 3 or 4, is an error; a frame with null pixels gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Channels that a frame may have, luma weights in 65536ths, the model's input (rows, columns), and the least span of a stretch.
CHANNELS, LUMA, MODEL_INPUT, LEAST_SPAN = (1, 3, 4), (19595, 38470, 7471), (240, 320), 1e-6
#: Bytes of pooled frames that a task holds before it gives them on.
POOL_BYTES = 1 << 26
_SHAPE = ("height", "width", "channels")


def frame_at(batch: pa.RecordBatch, i: int) -> np.ndarray | None:
    """Frame ``i`` of a batch as (height, width, channels)."""
    pixels = batch.column("pixels")
    if not pixels.is_valid()[i].as_py():
        return None
    shape = tuple(batch.column(c)[i].as_py() for c in _SHAPE)
    values = pixels.values[pixels.offsets[i].as_py() : pixels.offsets[i + 1].as_py()].to_numpy(zero_copy_only=False)
    if shape[2] not in CHANNELS or len(values) != shape[0] * shape[1] * shape[2]:
        raise ValueError(f"{len(values)} pixel values are no frame of height, width, channels {shape}")
    return values.reshape(shape)


def _mapped(frames: DataFrame, out: str, ddl: str, kind: pa.DataType, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``frames`` with a column ``out`` that the kernel makes of each frame."""
    kept = [c for c in frames.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if (f := frame_at(b, i)) is None else kernel(f).ravel() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, kind)], [*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in kept)
    return frames.mapInArrow(run, f"{fields}, `{out}` {ddl}")


def stretched(frame: np.ndarray, low: float = 1.0, high: float = 99.0) -> np.ndarray:
    """0..1: one channel between two percentiles (smallest and largest where they agree), colour between each channel's smallest and largest."""
    f = frame.astype(np.float64)
    if f.shape[2] == 1:
        lo, hi = np.percentile(f, [low, high])
        if hi <= lo:
            lo, hi = f.min(), f.max()
    else:
        lo, hi = f.min(axis=(0, 1), keepdims=True), f.max(axis=(0, 1), keepdims=True)
    return np.clip((f - lo) / np.maximum(hi - lo, LEAST_SPAN), 0, 1)


def normalise(frames: DataFrame) -> DataFrame:
    """``frames`` with ``scaled``, see ``stretched``."""
    return _mapped(frames, "scaled", "array<double>", pa.list_(pa.float64()), stretched)


def grey(frame: np.ndarray) -> np.ndarray:
    """(height, width) luma in whole values, rounded to the nearest; a fourth channel plays no part."""
    f = frame.astype(np.int64)
    if f.shape[2] == 1:
        return f[:, :, 0]
    return (f[:, :, 0] * LUMA[0] + f[:, :, 1] * LUMA[1] + f[:, :, 2] * LUMA[2] + (1 << 15)) >> 16


def _taps(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two neighbours and the second one's weight, in 2 ``to``-ths, for each of ``to`` centres on an axis of ``n``, edges repeated."""
    at = np.clip((2 * np.arange(to, dtype=np.int64) + 1) * n - to, 0, (n - 1) * 2 * to)
    low = at // (2 * to)
    return low, np.minimum(low + 1, n - 1), at - low * 2 * to


def resized(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bilinear resize on pixel centres, rounded to whole values as for an image of bytes, halves up; in whole numbers, so that a half is one."""
    y0, y1, fy = _taps(image.shape[0], rows)
    x0, x1, fx = _taps(image.shape[1], columns)
    image, one = image.astype(np.int64), 4 * rows * columns
    across = image[:, x0] * (2 * columns - fx) + image[:, x1] * fx
    total = across[y0] * (2 * rows - fy)[:, None] + across[y1] * fy[:, None]
    return ((2 * total + one) // (2 * one)).astype(np.float64)


def max_pool(frames: DataFrame) -> DataFrame:
    """(clip_id, height, width, channels, pixels): the largest value of each place over a clip's frames.

    A task first pools the frames that it holds, so at most one frame of a clip and task is shuffled; the rest is pooled batch by batch, so a
    clip of any length needs two frames of memory. Frames of a clip that differ in shape are an error; null frames play no part.
    """
    schema = pa.schema([("clip_id", _arrow(frames)), *((c, pa.int32()) for c in _SHAPE), ("pixels", pa.list_(pa.int32()))])

    def rows(pooled: dict) -> pa.RecordBatch:
        columns = [list(pooled), *([f.shape[i] for f in pooled.values()] for i in range(3)), [f.ravel() for f in pooled.values()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(columns, schema)], schema=schema)

    def add(pooled: dict, batch: pa.RecordBatch) -> None:
        for i, clip in enumerate(batch.column("clip_id").to_pylist()):
            if (f := frame_at(batch, i)) is None:
                continue
            if clip in pooled and pooled[clip].shape != f.shape:
                raise ValueError(f"frames of clip {clip} differ in shape: {pooled[clip].shape}, {f.shape}")
            pooled[clip] = np.maximum(pooled[clip], f) if clip in pooled else f.copy()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled: dict = {}
        for b in batches:
            add(pooled, b)
            if sum(f.nbytes for f in pooled.values()) > POOL_BYTES:
                yield rows(pooled)
                pooled = {}
        yield rows(pooled)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooled: dict = {}
        for b in batches:
            add(pooled, b)
        yield rows(pooled)

    ddl = f"clip_id {frames.schema['clip_id'].dataType.simpleString()}, height int, width int, channels int, pixels array<int>"
    given = frames.select("clip_id", *(F.col(c).cast("int").alias(c) for c in _SHAPE), "pixels")
    return given.mapInArrow(partial, ddl).groupBy("clip_id").applyInArrow(final, ddl)


def _arrow(frames: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frames.schema["clip_id"].dataType)


def model_input(frames: DataFrame, rows: int = MODEL_INPUT[0], columns: int = MODEL_INPUT[1]) -> DataFrame:
    """(clip_id, pixels): each clip pooled, turned grey, resized to ``rows`` x ``columns``, as floats."""
    pooled = max_pool(frames)
    return _mapped(pooled, "input", "array<double>", pa.list_(pa.float64()), lambda f: resized(grey(f), rows, columns)).select("clip_id", F.col("input").alias("pixels"))
