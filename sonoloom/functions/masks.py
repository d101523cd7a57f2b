"""Column functions on image masks: configurations (rectangle or fan), corners, rows of pixels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from sonoloom.functions.points import intersection, line_coefficients

#: Fixed values of the mask model.
SIDE_TOLERANCE, MERGE_DISTANCE, EDGE = 0.1, 15.0, 1e-9


def corners_to_config(p: dict[str, Column], rows: Column) -> Column:
    """struct: rectangle if both sides shift less than a tenth of the height, else a fan.

    ``p`` has ul, ur, ll, lr as x and y columns (``ul_x`` ...). Without an upper right corner the upper left is
    the apex. Angles are those of the sides seen from their crossing, the smaller first; radii are means.
    """
    tolerance = F.bround(rows * SIDE_TOLERANCE)
    three = p["ur_x"].isNull()
    rectangle = ~three & (F.abs(p["ul_x"] - p["ll_x"]) < tolerance) & (F.abs(p["ur_x"] - p["lr_x"]) < tolerance)
    left = line_coefficients(p["ul_x"], p["ul_y"], p["ll_x"], p["ll_y"])
    right = line_coefficients(p["ur_x"], p["ur_y"], p["lr_x"], p["lr_y"])
    cross_x, cross_y = intersection(left, right)
    cx, cy = F.when(three, p["ul_x"]).otherwise(cross_x), F.when(three, p["ul_y"]).otherwise(cross_y)
    whole = lambda c: F.bround(c).cast("int")

    def given(k: Column) -> Column:
        angle = lambda c: F.degrees(F.atan2(p[f"{c}_y"] - k["cy"], p[f"{c}_x"] - k["cx"]))
        reach = lambda c: F.hypot(p[f"{c}_x"] - k["cx"], p[f"{c}_y"] - k["cy"])
        rectangle, fan = k["rectangle"], ~k["rectangle"]
        return F.struct(
            F.when(rectangle, "rectangle").otherwise("fan").alias("mask_type"),
            F.when(fan, F.bround(F.least(angle("ll"), angle("lr")), 6)).alias("angle1"), F.when(fan, F.bround(F.greatest(angle("ll"), angle("lr")), 6)).alias("angle2"),
            F.when(fan, whole(k["cx"])).alias("cx"), F.when(fan, whole(k["cy"])).alias("cy"),
            F.when(fan, F.when(three, F.lit(0)).otherwise(whole((reach("ul") + reach("ur")) / 2))).alias("radius1"), F.when(fan, whole((reach("ll") + reach("lr")) / 2)).alias("radius2"),
            F.when(rectangle, whole(F.least(p["ul_x"], p["ll_x"]))).alias("x_min"), F.when(rectangle, whole(F.greatest(p["ur_x"], p["lr_x"]))).alias("x_max"),
            F.when(rectangle, whole(F.least(p["ul_y"], p["ur_y"]))).alias("y_min"), F.when(rectangle, whole(F.greatest(p["ll_y"], p["lr_y"]))).alias("y_max"),
        )

    return F.transform(F.array(F.struct(cx.alias("cx"), cy.alias("cy"), rectangle.alias("rectangle"))), given)[0]  # the crossing is bound once


def config_to_corners(c: Column, rows: Column | None = None, cols: Column | None = None) -> Column:
    """struct of ul, ur, ll, lr in whole pixels: the two sides of a fan go left and right by their upper points, and to the image
    if its size is given; with an inner radius of 0 the centre is the one upper corner and the lower points decide."""
    rectangle, apex = c["mask_type"] == "rectangle", c["radius1"] == 0
    at = lambda angle, radius: {"x": F.bround(c["cx"] + c[radius] * F.cos(F.radians(c[angle]))).cast("int"), "y": F.bround(c["cy"] + c[radius] * F.sin(F.radians(c[angle]))).cast("int")}
    top, bottom = {k: at(f"angle{k}", "radius1") for k in (1, 2)}, {k: at(f"angle{k}", "radius2") for k in (1, 2)}
    first_left = F.when(apex, bottom[1]["x"] <= bottom[2]["x"]).otherwise(top[1]["x"] <= top[2]["x"])
    size, box, out = {"x": cols, "y": rows}, {"ul": ("x_min", "y_min"), "ur": ("x_max", "y_min"), "ll": ("x_min", "y_max"), "lr": ("x_max", "y_max")}, []
    for name, edges in box.items():
        points, first = (top if name[0] == "u" else bottom), (first_left if name[1] == "l" else ~first_left)
        for axis, edge in zip("xy", edges):
            fan = F.when(first, points[1][axis]).otherwise(points[2][axis])
            if name == "ul":
                fan = F.when(apex, c[f"c{axis}"]).otherwise(fan)
            if size[axis] is not None:
                fan = F.when(fan.isNotNull(), F.greatest(F.lit(0), F.least(size[axis] - 1, fan)))
            fan = F.when(~apex, fan) if name == "ur" else fan
            out.append(F.when(rectangle, c[edge]).otherwise(fan).cast("double").alias(f"{name}_{axis}"))
    return F.struct(*out)


def rectangle_error(c: Column) -> Column:
    """What is wrong with a rectangle's sides; null for none and for fans."""
    wrong = (c["mask_type"] == "rectangle") & ((c["x_min"] >= c["x_max"]) | (c["y_min"] >= c["y_max"]))
    return F.when(wrong, F.format_string("invalid rectangle: left=%d, right=%d, top=%d, bottom=%d", c["x_min"], c["x_max"], c["y_min"], c["y_max"]))


def row_span(of: Callable[[str], Column], rows: Column) -> tuple[Column, Column]:
    """First and last row of a mask inside the image; the first lies after the last where it has none. ``of`` gives a field of the configuration."""
    box = of("mask_type") == "rectangle"
    wrong = F.coalesce(box & ((of("x_min") >= of("x_max")) | (of("y_min") >= of("y_max"))), F.lit(False))
    last = F.least(rows - 1, F.when(box, of("y_max")).otherwise(of("cy") + of("radius2")))
    return F.greatest(F.lit(0), F.when(box, of("y_min")).otherwise(of("cy") + 1)), F.when(~wrong, last).otherwise(-1)


def row_runs(of: Callable[[str], Column], row: Column, cols: Column) -> list[tuple[Column, Column]]:
    """Two runs (a, b) of a mask's pixels in a row of its span, ends inclusive and clipped to the image; b is less than a in one without pixels."""
    box, dy = of("mask_type") == "rectangle", (row - of("cy")).cast("double")
    square = lambda r: F.greatest(F.lit(0.0), of(r).cast("double") * of(r) - dy * dy)
    ray = lambda angle: dy / F.tan(F.radians(of(angle)))
    wide = F.floor(F.sqrt(square("radius2")) + EDGE)
    left, right = F.greatest(F.ceil(ray("angle2") - EDGE), -wide).cast("int"), F.least(F.floor(ray("angle1") + EDGE), wide).cast("int")
    hole = F.when(of("radius1") > dy, F.ceil(F.sqrt(square("radius1")) - EDGE)).otherwise(0).cast("int")
    a, b = F.when(box, of("x_min")).otherwise(left + of("cx")), F.when(box, of("x_max")).when(hole > 0, F.least(right, -hole) + of("cx")).otherwise(right + of("cx"))
    clipped = lambda a, b: (F.greatest(F.lit(0), a), F.least(cols - 1, b))
    return [clipped(a, b), clipped(F.greatest(left, hole) + of("cx"), F.when(~box & (hole > 0), right + of("cx")).otherwise(-1))]


def rasterise(df: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """``df``, which has the fields of a configuration, with row, a, b: one row for each run of the mask's pixels.

    Ends are inclusive and clipped to the image. A fan's row ends at its rays and outer circle and may have
    a hole, the inner circle; the row of the centre is left out. An invalid rectangle (``rectangle_error``) has no pixels.
    """
    first, last = row_span(F.col, rows)
    each = df.withColumn("row", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    runs = F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in row_runs(F.col, F.col("row"), cols)))
    return each.select(*df.columns, "row", F.inline(runs)).where("a <= b")


def merge_top(p: dict[str, Column]) -> dict[str, Column]:
    """Close upper corners become one, the midpoint."""
    close = F.hypot(p["ul_x"] - p["ur_x"], p["ul_y"] - p["ur_y"]) < MERGE_DISTANCE
    out = dict(p)
    for axis in "xy":
        out[f"ul_{axis}"] = F.when(close, (p[f"ul_{axis}"] + p[f"ur_{axis}"]) / 2).otherwise(p[f"ul_{axis}"])
        out[f"ur_{axis}"] = F.when(~close, p[f"ur_{axis}"])
    return out


def order_corners(points: Column) -> Column:
    """array of 4 points (x, y structs) as UL, UR, LL, LR: by height, then left to right in each pair."""
    by_y = F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    pair = lambda a: F.array_sort(F.transform(F.slice(by_y, a, 2), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return F.when(F.size(points) == 4, F.concat(pair(1), pair(3)))


def ordered_corners(points: Column, three: Column) -> Column:
    """struct of ul, ur, ll, lr (x, y) and message: four points, or with ``three`` an apex (ul) and two; a wrong number gives the message alone."""
    wanted, four, apex = F.when(three, 3).otherwise(4), order_corners(points), order_three_corners(points)
    message = F.when(F.size(points) < wanted, F.concat(F.lit("At least "), wanted.cast("string"), F.lit(" control points are needed to define a mask"))).when(F.size(points) > wanted, F.concat(F.lit("Only "), wanted.cast("string"), F.lit(" control points are needed to define a mask")))
    pick = lambda i, j: F.when(message.isNull(), F.when(three, F.get(apex, F.lit(j)) if j is not None else F.lit(None)).otherwise(F.get(four, F.lit(i))))
    return F.struct(pick(0, 0).alias("ul"), pick(1, None).alias("ur"), pick(2, 1).alias("ll"), pick(3, 2).alias("lr"), message.alias("message"))


def redaction_height(rows: Column, top_left: Column, top_right: Column, ratio: float) -> Column:
    """Rows to blank: the share of the height, but not past the lowest upper corner inside the image."""
    base, top = F.floor(rows * ratio).cast("int"), F.floor(F.greatest(top_left, top_right)).cast("int")
    return F.least(rows - 1, F.when(top > 0, F.least(base, top)).otherwise(base))


def redaction_mode(phi_only: Column, remove_phi: Column, top_ratio: Column, has_corners: Column) -> Column:
    """Which image is written: the fan mask's in the usual mode, else top rows blanked if asked and corners are known, else untouched."""
    return F.when(~phi_only, "mask").when(remove_phi & (top_ratio > 0) & has_corners, "top").otherwise("untouched")


def denormalise(at: Column, size: Column) -> Column:
    """Pixels of a coordinate given as a share of the image."""
    return at * size


def order_three_corners(points: Column) -> Column:
    """array of 3 points (x, y structs) as apex, lower left, lower right: the highest first, the others left to right; null for another count."""
    by_y = F.array_sort(F.transform(points, lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x"))))
    apex = F.transform(F.slice(by_y, 1, 1), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rest = F.array_sort(F.transform(F.slice(by_y, 2, 2), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    return F.when(F.size(points) == 3, F.concat(apex, rest))
