"""Mask evaluation: rasterised runs, overlap, errors, sector percentages.

A mask is a set of runs (row, a, b) of columns, ends inclusive. Distinct configurations, and distinct pairs of them, are
rasterised and compared once, and what comes out is joined to the rows that have them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sonoloom.functions import masks as M, points as P

CORNERS = ("ul", "ur", "ll", "lr")
CONFIG = ("mask_type", "angle1", "angle2", "cx", "cy", "radius1", "radius2", "x_min", "x_max", "y_min", "y_max")


def corner_columns(prefix: str, dx: Column | float = 0.0, dy: Column | float = 0.0) -> dict[str, Column]:
    return {f"{c}_{a}": F.col(f"{prefix}{c}_{a}") + (dx if a == "x" else dy) for c in CORNERS for a in "xy"}


def with_configs(masks: DataFrame) -> DataFrame:
    """Truth and prediction as configurations, and the prediction's corners."""
    pred = corner_columns("gt_", F.col("pred_dx"), F.col("pred_dy"))
    return masks.withColumns({
        "gt": M.corners_to_config(corner_columns("gt_"), F.col("image_rows")), "pred": M.corners_to_config(pred, F.col("image_rows")), **{f"pred_{k}": v for k, v in pred.items()},
    })


def of_each(configs: DataFrame, key: str, masks: tuple[str, ...], measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, what ``measure`` gives): ``measure`` is taken once for each distinct choice of ``masks`` and image size, and joined to every row that has it.

    It gets ``mask``, their text, and their fields, and gives rows by ``mask``; what has none there is left out. The text is a key of
    one value: structs of doubles as keys are built anew, field by field, for each comparison.
    """
    whole = configs.select(key, F.struct(*masks, "image_rows", "image_cols").alias("m"))
    of = whole.select(key, F.to_json("m").alias("mask"))
    kinds = of.select("mask").distinct().select("mask", F.from_json("mask", whole.schema["m"].dataType).alias("m")).select("mask", "m.*")
    return of.join(measure(kinds), "mask").drop("mask")


def runs(kinds: DataFrame, key: str, config: str) -> DataFrame:
    """(key, row, a, b) of each configuration."""
    of = kinds.select(key, F.col(f"{config}.*"), "image_rows", "image_cols")
    return M.rasterise(of, F.col("image_rows"), F.col("image_cols")).select(key, "row", "a", "b")


def row_sizes(configs: DataFrame, key: str, config: str) -> DataFrame:
    """(key, row, pixels, first, last) of each row of a mask that has pixels; a mask's rows, at most the image's, are joined as one list."""

    def listed(kinds: DataFrame) -> DataFrame:
        each = runs(kinds, "mask", config).groupBy("mask", "row").agg(F.sum(F.col("b") - F.col("a") + 1).alias("pixels"), F.min("a").alias("first"), F.max("b").alias("last"))
        return each.groupBy("mask").agg(F.collect_list(F.struct("row", "pixels", "first", "last")).alias("rows"))

    return of_each(configs, key, (config,), listed).select(key, F.inline("rows"))


def area(r: DataFrame, key: str, name: str) -> DataFrame:
    return r.groupBy(key).agg(F.sum(F.col("b") - F.col("a") + 1).alias(name))


def overlap(configs: DataFrame, key: str) -> DataFrame:
    """(key, truth, predicted, common): areas of two masks and of their intersection."""
    size = lambda a, b: F.greatest(F.lit(0), b - a + 1)
    masks, row = ("gt", "pred"), F.col("row")
    field = lambda mask: lambda name: F.col(f"{mask}.{name}")
    span = {m: M.row_span(field(m), F.col("image_rows")) for m in masks}
    first, last = F.least(*(span[m][0] for m in masks)), F.greatest(*(span[m][1] for m in masks))

    def shared(kinds: DataFrame) -> DataFrame:
        each = kinds.withColumn("row", F.explode_outer(F.when(first <= last, F.sequence(first, last))))
        inside = {m: row.between(*span[m]) for m in masks}
        cut = each.withColumns({f"{m}{i}{e}": F.when(inside[m], x).otherwise(-1 if e == "b" else 0) for m in masks for i, run in enumerate(M.row_runs(field(m), row, F.col("image_cols"))) for e, x in zip("ab", run)})
        run = {m: [(F.col(f"{m}{i}a"), F.col(f"{m}{i}b")) for i in (0, 1)] for m in masks}
        met = sum((size(F.greatest(a, a2), F.least(b, b2)) for a, b in run["gt"] for a2, b2 in run["pred"]), F.lit(0))
        sums = {"truth": sum((size(*r) for r in run["gt"]), F.lit(0)), "predicted": sum((size(*r) for r in run["pred"]), F.lit(0)), "common": met}
        return cut.groupBy("mask").agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items()))

    return of_each(configs, key, masks, shared)


def dice_iou(o: DataFrame) -> DataFrame:
    total = F.col("truth") + F.col("predicted")
    return o.withColumns({"dice": F.when(total > 0, 2 * F.col("common") / total), "iou": F.when(total > 0, F.col("common") / (total - F.col("common")))})


def corner_errors(configs: DataFrame) -> DataFrame:
    """Distance of each predicted corner from the true one, and the mean of the four; null where a corner is."""
    errors = {c: F.hypot(F.col(f"pred_{c}_x") - F.col(f"gt_{c}_x"), F.col(f"pred_{c}_y") - F.col(f"gt_{c}_y")) for c in CORNERS}
    mean = (errors["ul"] + errors["ur"] + errors["ll"] + errors["lr"]) / 4
    return configs.withColumns({f"{c}_error": e for c, e in errors.items()} | {"mean_error": mean})


CORNER_NAMES = {"ul": "upper_left", "ur": "upper_right", "ll": "lower_left", "lr": "lower_right"}
#: Names of a configuration's fields in documents and tables.
FIELD_NAMES = {
    "mask_type": "mask_type", "angle1": "angle1", "angle2": "angle2", "cy": "center_rows_px", "cx": "center_cols_px", "radius1": "radius1", "radius2": "radius2",
    "x_min": "rectangle_left", "x_max": "rectangle_right", "y_min": "rectangle_top", "y_max": "rectangle_bottom",
}


def config_fields(config: str, prefix: str) -> list[Column]:
    """A configuration as columns of their documents' names, floats to two decimals; fields of the other kind of mask are null."""
    return [(P.round_exact(F.col(f"{config}.{c}")) if c.startswith("angle") else F.col(f"{config}.{c}")).alias(prefix + name) for c, name in FIELD_NAMES.items()]


def eval_row(configs: DataFrame) -> DataFrame:
    """The whole evaluation row of each clip: names, both documents, corners, angles of the four errors, metrics to two decimals.

    ``configs`` comes from :func:`with_configs` and has filename, input_path, ground_truth_path, uid and labels besides.
    """
    measured = corner_errors(configs).join(dice_iou(overlap(configs, "clip_id")), "clip_id")
    labels = F.array_join("labels", ", ")
    document = lambda config, prefix: [F.col("uid").alias(f"{prefix}sopinstance_uid"), F.lit(0).alias(f"{prefix}grayscale_conversion"), *config_fields(config, prefix), F.col("image_rows").alias(f"{prefix}image_size_rows"), F.col("image_cols").alias(f"{prefix}image_size_cols")]
    corners = [P.round_exact(F.col(f"{kind}_{c}_{a}")).alias(f"{kind}_corners_{name}_{a}") for kind in ("gt", "pred") for c, name in CORNER_NAMES.items() for a in "xy"]
    angles = [P.angle_degrees(F.col(f"pred_{c}_x") - F.col(f"gt_{c}_x"), F.col(f"pred_{c}_y") - F.col(f"gt_{c}_y")).alias(f"angle_{name}") for c, name in CORNER_NAMES.items()]
    metrics = {"dice": "dice_mean", "iou": "iou_mean", "mean_error": "mean_distance_error", **{f"{c}_error": f"{name}_error" for c, name in CORNER_NAMES.items()}}
    return measured.select(
        "filename", F.element_at(F.split("ground_truth_path", "/"), -1).alias("ground_truth_filename"), F.col("input_path").alias("dicom_input_path"), "ground_truth_path",
        *document("gt", "gt_"), labels.alias("gt_annotation_labels"), *document("pred", "pred_"), labels.alias("pred_annotation_labels"), *corners, *angles, *(P.round_exact(F.col(m)).alias(n) for m, n in metrics.items()),
    )


def sequence_info(configs: DataFrame, config: str, key: str = "clip_id") -> DataFrame:
    """(key, json): the sequence document: instance UID or "None", no grey conversion, the whole configuration, labels where there are any."""
    raw = [F.col(f"{config}.{c}").alias(name) for c, name in FIELD_NAMES.items()]
    uid = F.coalesce(F.nullif("uid", F.lit("")), F.lit("None")).alias("SOPInstanceUID")
    labels = F.when(F.size("labels") > 0, F.col("labels")).alias("AnnotationLabels")
    return configs.select(key, F.to_json(F.struct(uid, F.lit(False).alias("GrayscaleConversion"), *raw, F.col("image_rows").alias("image_size_rows"), F.col("image_cols").alias("image_size_cols"), labels)).alias("json"))


def erode_edges(r: DataFrame, key: str, rows: int, cols: int, fraction: float) -> DataFrame:
    """The mask without the image's border, eroded by a box of the given share of the image's rows; unchanged for no share."""
    if fraction <= 0:
        return r
    inner = r.where((F.col("row") > 0) & (F.col("row") < rows - 1)).select(key, "row", F.greatest("a", F.lit(1)).alias("a"), F.least("b", F.lit(cols - 2)).alias("b")).where("a <= b")
    return erode(inner, key, int(fraction * rows))


def erode(r: DataFrame, key: str, size: int) -> DataFrame:
    """Runs of the mask eroded by a ``size`` x ``size`` box: in ``size`` neighbouring rows, and so far from both ends; an even box reaches one pixel farther up and left."""
    before, after = size // 2, size - 1 - size // 2
    lines = r.select(key, F.explode(F.sequence(F.col("row") - after, F.col("row") + before)).alias("row"), F.col("row").alias("src"), (F.col("a") + before).alias("a"), (F.col("b") - after).alias("b")).where("a <= b")
    events = lines.select(key, "row", F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("d"))))).groupBy(key, "row", "x").agg(F.sum("d").alias("d"))
    order = W.partitionBy(key, "row").orderBy("x")
    seen = events.select(key, "row", "x", F.sum("d").over(order).alias("n"), F.lead("x").over(order).alias("next"))
    return seen.where(F.col("n") == size).select(key, "row", F.col("x").alias("a"), (F.col("next") - 1).alias("b"))


def sector(x1: Column, y1: Column, x2: Column, y2: Column, cx: int, cy: int, r1: int, r2: int) -> Column:
    """Fan between the rays from a centre through two points."""
    a = lambda x, y: F.bround(F.degrees(F.atan2(y - cy, x - cx)), 6)
    none = F.lit(None).cast("int")
    return F.struct(
        F.lit("fan").alias("mask_type"), F.least(a(x1, y1), a(x2, y2)).alias("angle1"), F.greatest(a(x1, y1), a(x2, y2)).alias("angle2"),
        F.lit(cx).alias("cx"), F.lit(cy).alias("cy"), F.lit(r1).alias("radius1"), F.lit(r2).alias("radius2"), *(none.alias(c) for c in CONFIG[7:]),
    )


def rectangle_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rectangle from one point to before the other, as a configuration; points that span no pixel give one that has none."""
    none, whole = F.lit(None), lambda c: F.floor(c).cast("int")
    return F.struct(
        F.lit("rectangle").alias("mask_type"), none.cast("double").alias("angle1"), none.cast("double").alias("angle2"), *(none.cast("int").alias(c) for c in CONFIG[3:7]),
        whole(x1).alias("x_min"), (whole(x2) - 1).alias("x_max"), whole(y1).alias("y_min"), (whole(y2) - 1).alias("y_max"),
    )


def pleura_percentage(sectors: DataFrame, rows: int, cols: int) -> DataFrame:
    """Per clip and frame: share of the pleura sectors' union that B-line sectors cover, in percent; 0 without pleura.

    ``sectors`` has clip_id, frame_number, kind and the configuration of each line's sector in an image of ``rows`` x ``cols``; frames
    without a pixel in them are left out. Lines are dealt by frame before they are rasterised, so no run is shuffled; a
    frame's only sector is summed, others are swept along each pixel row.
    """
    frame, size = ["clip_id", "frame_number"], (F.lit(rows), F.lit(cols))
    counted = sectors.select(*frame, "kind", F.struct(*CONFIG).alias("c"), F.count("*").over(W.partitionBy(*frame)).alias("n"))
    alone, others = (M.rasterise(counted.where(n).select(*frame, "kind", "c.*"), *size) for n in ("n = 1", "n > 1"))
    single = alone.groupBy(*frame).agg(F.sum(F.when(F.col("kind") == "pleura", F.col("b") - F.col("a") + 1).otherwise(0)).alias("pleura"), F.lit(0).cast("long").alias("common"))
    sums = single.unionByName(_swept(others))
    return sums.withColumn("percentage", F.when(F.col("pleura") > 0, F.round(100 * F.col("common") / F.col("pleura"), 4)).otherwise(0.0))


def _swept(sectors: DataFrame) -> DataFrame:
    """(clip_id, frame_number, pleura, common) of sectors given as runs: unions are swept along each pixel row."""
    events = sectors.select("clip_id", "frame_number", "row", "kind", F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("x"), F.lit(-1).alias("d")))))
    steps = events.groupBy("clip_id", "frame_number", "row", "x").agg(F.sum(F.when(F.col("kind") == "pleura", F.col("d")).otherwise(0)).alias("p"), F.sum(F.when(F.col("kind") == "b", F.col("d")).otherwise(0)).alias("q"))
    order = W.partitionBy("clip_id", "frame_number", "row").orderBy("x")
    swept = steps.select("clip_id", "frame_number", F.sum("p").over(order).alias("p"), F.sum("q").over(order).alias("q"), (F.lead("x").over(order) - F.col("x")).alias("w"))
    return swept.groupBy("clip_id", "frame_number").agg(F.coalesce(F.sum(F.when(F.col("p") > 0, F.col("w"))), F.lit(0)).alias("pleura"), F.coalesce(F.sum(F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("w"))), F.lit(0)).alias("common"))
