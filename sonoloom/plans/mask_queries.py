"""Queries of the mask, geometry and evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoloom.functions import headers as H, masks as M, points as P
from sonoloom.operators import annotations as A, evaluate as V
from sonoloom.plans.annotation_queries import LATEST, _status_lines
from sonoloom.plans.wiring import Registry
from sonoloom.sources.views import lines, masks

R = Registry()


def _config_sql(name: str, dx: str, dy: str) -> str:
    """Configuration of a mask's corners in SQL, sides as slopes."""
    p = {f"{c}{a}": f"(gt_{c}_{a} + {dx if a == 'x' else dy})" for c in V.CORNERS for a in "xy"}
    return f"""{name} AS (SELECT *, CASE WHEN rect THEN 'rectangle' ELSE 'fan' END AS mask_type,
  CASE WHEN NOT rect THEN round_even(degrees(atan2(lry - fy, lrx - fx)), 6) END AS angle1, CASE WHEN NOT rect THEN round_even(degrees(atan2(lly - fy, llx - fx)), 6) END AS angle2,
  CASE WHEN NOT rect THEN CAST(round_even(fx, 0) AS INT) END AS cx, CASE WHEN NOT rect THEN CAST(round_even(fy, 0) AS INT) END AS cy,
  CASE WHEN NOT rect THEN CAST(round_even((sqrt((ulx - fx) ^ 2 + (uly - fy) ^ 2) + sqrt((urx - fx) ^ 2 + (ury - fy) ^ 2)) / 2, 0) AS INT) END AS radius1,
  CASE WHEN NOT rect THEN CAST(round_even((sqrt((llx - fx) ^ 2 + (lly - fy) ^ 2) + sqrt((lrx - fx) ^ 2 + (lry - fy) ^ 2)) / 2, 0) AS INT) END AS radius2,
  CASE WHEN rect THEN CAST(ulx AS INT) END AS x_min, CASE WHEN rect THEN CAST(urx AS INT) END AS x_max, CASE WHEN rect THEN CAST(uly AS INT) END AS y_min, CASE WHEN rect THEN CAST(lly AS INT) END AS y_max
  FROM (SELECT *, abs(ulx - llx) < 48 AND abs(urx - lrx) < 48 AS rect, ulx + (llx - ulx) * t AS fx, uly + (lly - uly) * t AS fy
    FROM (SELECT *, (urx - ulx) / ((llx - ulx) - (lrx - urx)) AS t FROM (SELECT v_mask.*, {', '.join(f'{e} AS {n}' for n, e in p.items())} FROM v_mask))))"""


CFG = ["mask_type", "angle1", "angle2", "cx", "cy", "radius1", "radius2", "x_min", "x_max", "y_min", "y_max"]
INSIDE = """CASE WHEN {0}.mask_type = 'rectangle' THEN x BETWEEN {0}.x_min AND {0}.x_max AND y BETWEEN {0}.y_min AND {0}.y_max
  ELSE y > {0}.cy AND x - {0}.cx >= (y - {0}.cy) / tan(radians({0}.angle2)) - 1e-9 AND x - {0}.cx <= (y - {0}.cy) / tan(radians({0}.angle1)) + 1e-9
    AND (x - {0}.cx) ^ 2 + (y - {0}.cy) ^ 2 BETWEEN {0}.radius1 ^ 2 AND {0}.radius2 ^ 2 END"""
GT, PRED = _config_sql("gt", "0", "0"), _config_sql("pred", "pred_dx", "pred_dy")
KEY = ", ".join(CFG)
PIXELS = f"""one AS (SELECT row_number() OVER () AS kid, * FROM (SELECT DISTINCT {KEY} FROM gt)), grid AS (SELECT x, y FROM (SELECT unnest(range(640)) AS x), (SELECT unnest(range(480)) AS y)),
  px AS (SELECT kid, x, y FROM one, grid WHERE {INSIDE.format('one')})"""
SAME = " AND ".join(f"{{0}}.{c} IS NOT DISTINCT FROM {{1}}.{c}" for c in CFG)
PAIRS = f"""pair AS (SELECT gt.clip_id, {', '.join(f'gt.{c} AS {c}, pred.{c} AS p_{c}' for c in CFG)} FROM gt JOIN pred ON gt.clip_id = pred.clip_id),
  kinds AS (SELECT row_number() OVER () AS kid, * FROM (SELECT DISTINCT {', '.join(f'{c}, p_{c}' for c in CFG)} FROM pair)),
  a AS (SELECT kid, {KEY} FROM kinds), b AS (SELECT kid, {', '.join(f'p_{c} AS {c}' for c in CFG)} FROM kinds), grid AS (SELECT x, y FROM (SELECT unnest(range(100, 541)) AS x), (SELECT unnest(range(40, 461)) AS y)),
  cnt AS (SELECT kid, count(*) FILTER (i) AS truth, count(*) FILTER (j) AS predicted, count(*) FILTER (i AND j) AS common FROM (SELECT a.kid, {INSIDE.format('a')} AS i, {INSIDE.format('b')} AS j FROM a JOIN b ON a.kid = b.kid, grid) GROUP BY 1),
  o AS (SELECT pair.clip_id, truth, predicted, common FROM pair JOIN kinds ON {' AND '.join(f'pair.{c} IS NOT DISTINCT FROM kinds.{c} AND pair.p_{c} IS NOT DISTINCT FROM kinds.p_{c}' for c in CFG)} JOIN cnt ON cnt.kid = kinds.kid)"""


def _configs(s, d):
    return V.with_configs(masks(s, d))


def _sectors(df):
    own = df.withColumn("c", V.sector(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 50, 0, 10, 25))
    return own.select("clip_id", "frame_number", "kind", "c.*")


def _between(df):
    """Runs of each line's sector: of a rectangle between its points in every third clip, else of a fan."""
    points = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    own = df.withColumn("c", F.when(F.col("clip_id") % 3 == 0, V.rectangle_between(*points)).otherwise(V.sector(*points, 50, 0, 10, 25)))
    return M.rasterise(own.select("clip_id", "frame_number", "line_ord", "kind", "x2", "c.*"), F.lit(128), F.lit(128))


SECTOR_PIXELS = """ang AS (SELECT *, least(round_even(degrees(atan2(y1, x1 - 50)), 6), round_even(degrees(atan2(y2, x2 - 50)), 6)) AS lo, greatest(round_even(degrees(atan2(y1, x1 - 50)), 6), round_even(degrees(atan2(y2, x2 - 50)), 6)) AS hi FROM {0}),
  g AS (SELECT x, y FROM (SELECT unnest(range(-25, 26)) AS x), (SELECT unnest(range(1, 26)) AS y) WHERE x * x + y * y BETWEEN 100 AND 625),
  spx AS (SELECT DISTINCT clip_id, frame_number, kind, x, y FROM ang, g WHERE x >= y / tan(radians(hi)) - 1e-9 AND x <= y / tan(radians(lo)) + 1e-9),
  pc AS (SELECT clip_id, frame_number, x, y, bool_or(kind = 'pleura') AS p, bool_or(kind = 'b') AS q FROM spx GROUP BY 1, 2, 3, 4)"""
PERCENT = "SELECT clip_id, frame_number, count(*) FILTER (p) AS pleura, count(*) FILTER (p AND q) AS common, CASE WHEN count(*) FILTER (p) > 0 THEN round(100.0::DOUBLE * count(*) FILTER (p AND q) / count(*) FILTER (p), 4) ELSE 0 END AS percentage FROM pc GROUP BY 1, 2"
METRICS = ["dice", "iou", "ul_error", "ur_error", "ll_error", "lr_error", "mean_error"]
METRIC_SQL = "CAST(printf('%.2f', CAST(2 * common / (truth + predicted) AS DOUBLE)) AS DOUBLE) AS dice, CAST(printf('%.2f', CAST(common / (truth + predicted - common) AS DOUBLE)) AS DOUBLE) AS iou"
ERR = "CAST(printf('%.2f', CAST(sqrt(pred_dx ^ 2 + pred_dy ^ 2) AS DOUBLE)) AS DOUBLE)"


def _metrics(s, d):
    c = V.corner_errors(_configs(s, d))
    o = V.dice_iou(V.overlap(c, "clip_id"))
    angle = P.angle_degrees(F.col("pred_dx"), F.col("pred_dy")).alias("angle")
    return c.join(o, "clip_id").select("clip_id", *(P.round_exact(F.col(m)).alias(m) for m in METRICS), angle)


def _named(s, d):
    """Configurations with the names and labels that evaluation rows and sequence documents carry."""
    clip = F.col("clip_id").cast("string")
    labels = F.when(F.col("clip_id") % 3 == 0, F.array(F.lit("Lung/A"), F.concat(F.lit("Lung/B"), clip))).when(F.col("clip_id") % 3 == 1, F.array().cast("array<string>"))
    return _configs(s, d).withColumns({"filename": F.concat(clip, F.lit(".dcm")), "input_path": F.concat(F.lit("/in/"), clip, F.lit(".dcm")), "ground_truth_path": F.concat(F.lit("/gt/"), clip, F.lit(".json")), "uid": F.when(F.col("clip_id") % 4 > 0, F.concat(F.lit("1.2."), clip)), "labels": labels})


NAMED = "CASE WHEN m.clip_id % 4 > 0 THEN '1.2.' || m.clip_id END"
LABELS = "CASE WHEN m.clip_id % 3 = 0 THEN 'Lung/A, Lung/B' || m.clip_id WHEN m.clip_id % 3 = 1 THEN '' END"
ANGLE = "CASE WHEN m.pred_dx = 0 AND m.pred_dy = 0 THEN 0 ELSE CAST(printf('%.2f', CAST((degrees(atan2(-m.pred_dy, m.pred_dx)) + 360) % 360 AS DOUBLE)) AS DOUBLE) END"


def _eval_sql() -> str:
    """The evaluation row in SQL."""
    out = ["m.clip_id || '.dcm' AS filename", "m.clip_id || '.json' AS ground_truth_filename", "'/in/' || m.clip_id || '.dcm' AS dicom_input_path", "'/gt/' || m.clip_id || '.json' AS ground_truth_path"]
    for t in ("gt", "pred"):
        out += [f"{NAMED} AS {t}_sopinstance_uid", f"0 AS {t}_grayscale_conversion", f"{LABELS} AS {t}_annotation_labels", f"m.image_rows AS {t}_image_size_rows", f"m.image_cols AS {t}_image_size_cols"]
        out += [(f"CAST(printf('%.2f', CAST({t}.{c} AS DOUBLE)) AS DOUBLE)" if c.startswith("angle") else f"{t}.{c}") + f" AS {t}_{n}" for c, n in V.FIELD_NAMES.items()]
        out += [f"CAST(printf('%.2f', CAST(m.gt_{c}_{a}{f' + m.pred_d{a}' if t == 'pred' else ''} AS DOUBLE)) AS DOUBLE) AS {t}_corners_{n}_{a}" for c, n in V.CORNER_NAMES.items() for a in "xy"]
    out += [f"{ANGLE} AS angle_{n}" for n in V.CORNER_NAMES.values()] + ["CAST(printf('%.2f', CAST(2 * common / (truth + predicted) AS DOUBLE)) AS DOUBLE) AS dice_mean", "CAST(printf('%.2f', CAST(common / (truth + predicted - common) AS DOUBLE)) AS DOUBLE) AS iou_mean"]
    out += [f"CAST(printf('%.2f', CAST(sqrt(m.pred_dx ^ 2 + m.pred_dy ^ 2) AS DOUBLE)) AS DOUBLE) AS {n}" for n in ("mean_distance_error", *(f"{n}_error" for n in V.CORNER_NAMES.values()))]
    return f"WITH {GT}, {PRED}, {PAIRS} SELECT {', '.join(out)} FROM v_mask m JOIN gt ON gt.clip_id = m.clip_id JOIN pred ON pred.clip_id = m.clip_id JOIN o ON o.clip_id = m.clip_id"


def _info_sql() -> str:
    parts = "".join(f""" || CASE WHEN gt.{c} IS NULL THEN '' ELSE ',"{n}":' || {f"'{chr(34)}' || gt.{c} || '{chr(34)}'" if c == 'mask_type' else f'gt.{c}'} END""" for c, n in V.FIELD_NAMES.items())
    labels = """CASE WHEN m.clip_id % 3 = 0 THEN ',"AnnotationLabels":["Lung/A","Lung/B' || m.clip_id || '"]' ELSE '' END"""
    return f"""WITH {GT} SELECT m.clip_id, '{{"SOPInstanceUID":"' || coalesce({NAMED}, 'None') || '","GrayscaleConversion":false'{parts} || ',"image_size_rows":' || m.image_rows || ',"image_size_cols":' || m.image_cols || {labels} || '}}' AS json FROM v_mask m JOIN gt ON gt.clip_id = m.clip_id"""


def _normal(i: int):
    return F.pmod(F.col("clip_id") + 7 * i, F.lit(97)) / 97


def _docs(s, d):
    """Sequence documents: every other clip has its mask nested, and one in five uses the older key names."""
    c = _configs(s, d).select("clip_id", "gt.*")
    new, old = F.struct("mask_type", "angle1", "angle2", "radius1", "radius2", F.col("cy").alias("center_rows_px"), F.col("cx").alias("center_cols_px"), F.lit(480).alias("image_size_rows")), F.struct(F.array("cy", "cx").alias("center_coordinate_pixel"), "mask_type", F.col("angle1").alias("angle_min_degrees"), F.col("angle2").alias("angle_max_degrees"), F.col("radius1").alias("radius_min_px"), F.col("radius2").alias("radius_max_px"))
    pick = lambda body: F.when(F.col("clip_id") % 2 == 0, F.to_json(F.struct(body.alias("MaskConfig")))).otherwise(F.to_json(body))
    return c.select("clip_id", F.when(F.col("clip_id") % 5 == 0, pick(old)).otherwise(pick(new)).alias("json"))


FIELDS = "mask_type string, angle1 double, angle2 double, radius1 int, radius2 int, angle_min_degrees double, angle_max_degrees double, radius_min_px int, radius_max_px int, center_rows_px int, center_cols_px int, center_coordinate_pixel array<int>, image_size_rows int"


def _read_config(s, d):
    nested = ",".join(f.strip().replace(" ", ":", 1) for f in FIELDS.split(","))
    doc = _docs(s, d).select("clip_id", F.from_json("json", f"MaskConfig struct<{nested}>, {FIELDS}").alias("d"))
    names = [f.strip().split()[0] for f in FIELDS.split(",")]
    return doc.select("clip_id", *(F.coalesce(F.col(f"d.MaskConfig.{n}"), F.col(f"d.{n}")).alias(n) for n in names))


def _corners(s, d, change):
    p = V.corner_columns("gt_", F.col("pred_dx"), F.col("pred_dy"))
    return masks(s, d).select("clip_id", *(v.alias(k) for k, v in change(p).items()))


def _ordered(s, d):
    """Four points, three (the upper left as apex), or a wrong number of them."""
    p = V.corner_columns("gt_")
    at = lambda *names: F.array(*(F.struct(p[f"{c}_x"].alias("x"), p[f"{c}_y"].alias("y")) for c in names))
    kind = F.col("clip_id") % 5
    points = F.when(kind == 1, at("lr", "ul")).when(kind == 2, at("lr", "ul", "ll", "ur", "ul")).when(kind == 3, at("lr", "ul", "ll")).otherwise(at("lr", "ul", "ll", "ur"))
    o = M.ordered_corners(F.col("points"), F.col("three"))
    made = masks(s, d).select("clip_id", points.alias("points"), kind.isin(1, 3).alias("three")).withColumn("o", o)
    return made.select("clip_id", "o.message", *(F.col(f"o.{c}.{a}").alias(f"{c}_{a}") for c in V.CORNERS for a in "xy"))


R.add("corners_to_config", lambda s, d: _configs(s, d).select("clip_id", "pred.*"), f"WITH {PRED} SELECT clip_id, {KEY} FROM pred")
TURN = "round_even({c} + radius{r} * {f}(radians(angle{k})), 0)"
LEFT = f"CASE WHEN {TURN.format(c='cx', r=1, f='cos', k=1)} <= {TURN.format(c='cx', r=1, f='cos', k=2)} THEN 1 ELSE 2 END"
SIDE = "CASE WHEN mask_type = 'rectangle' THEN {edge} ELSE greatest(0, least({last}, CASE WHEN (" + LEFT + ") = {own} THEN {one} ELSE {two} END)) END"


def _corner_sql(c: str, a: str) -> str:
    r, f, centre = (1 if c[0] == "u" else 2), ("cos" if a == "x" else "sin"), ("cx" if a == "x" else "cy")
    edge = f"x_{'min' if c[1] == 'l' else 'max'}" if a == "x" else f"y_{'min' if c[0] == 'u' else 'max'}"
    return SIDE.format(edge=edge, last=639 if a == "x" else 479, own=1 if c[1] == "l" else 2, one=TURN.format(c=centre, r=r, f=f, k=1), two=TURN.format(c=centre, r=r, f=f, k=2)) + f" AS {c}_{a}"


R.add("config_to_corners", lambda s, d: _configs(s, d).select("clip_id", M.config_to_corners(F.col("gt"), F.col("image_rows"), F.col("image_cols")).alias("c")).select("clip_id", "c.*"), f"WITH {GT} SELECT clip_id, " + ", ".join(_corner_sql(c, a) for c in V.CORNERS for a in "xy") + " FROM gt")
R.add("mask_errors", lambda s, d: _configs(s, d).withColumn("c", F.col("gt").withField("x_max", F.when(F.col("clip_id") % 4 == 0, F.col("gt.x_min")).otherwise(F.col("gt.x_max")))).select("clip_id", M.rectangle_error(F.col("c")).alias("error")).where("error IS NOT NULL"), f"WITH {GT} SELECT clip_id, printf('invalid rectangle: left=%d, right=%d, top=%d, bottom=%d', x_min, x_min, y_min, y_max) AS error FROM gt WHERE mask_type = 'rectangle' AND clip_id % 4 = 0")
R.add("mask_runs", lambda s, d: V.row_sizes(_configs(s, d), "clip_id", "gt"), f"WITH {GT}, {PIXELS}, r AS (SELECT kid, y, count(*) AS pixels, min(x) AS first, max(x) AS last FROM px GROUP BY kid, y) SELECT gt.clip_id, CAST(y AS INT) AS row, pixels, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM gt JOIN one ON {SAME.format('gt', 'one')} JOIN r ON r.kid = one.kid")
R.add("mask_overlap", lambda s, d: V.dice_iou(V.overlap(_configs(s, d), "clip_id")).select("clip_id", F.round("dice", 9).alias("dice"), F.round("iou", 9).alias("iou")), f"WITH {GT}, {PRED}, {PAIRS} SELECT clip_id, round(2 * common / (truth + predicted), 9) AS dice, round(common / (truth + predicted - common), 9) AS iou FROM o")
R.add("mask_confusion", lambda s, d: V.overlap(_configs(s, d), "clip_id").select("clip_id", (F.col("truth") - F.col("common")).alias("truth_only"), (F.col("predicted") - F.col("common")).alias("predicted_only"), "common"), f"WITH {GT}, {PRED}, {PAIRS} SELECT clip_id, truth - common AS truth_only, predicted - common AS predicted_only, common FROM o")
R.add("corner_errors", lambda s, d: V.corner_errors(_configs(s, d)).select("clip_id", *(F.round(m, 6).alias(m) for m in METRICS[2:])), "SELECT clip_id, " + ", ".join(f"round(sqrt(pred_dx ^ 2 + pred_dy ^ 2), 6) AS {m}" for m in METRICS[2:]) + " FROM v_mask")
R.add("angle_degrees", lambda s, d: masks(s, d).select("clip_id", P.angle_degrees(F.col("pred_dx"), F.col("pred_dy")).alias("down"), P.angle_degrees(F.col("pred_dx"), F.col("pred_dy"), False).alias("up")), "SELECT clip_id, CASE WHEN pred_dx = 0 AND pred_dy = 0 THEN 0 ELSE CAST(printf('%.2f', CAST((degrees(atan2(-pred_dy, pred_dx)) + 360) % 360 AS DOUBLE)) AS DOUBLE) END AS down, CASE WHEN pred_dx = 0 AND pred_dy = 0 THEN 0 ELSE CAST(printf('%.2f', CAST((degrees(atan2(pred_dy, pred_dx)) + 360) % 360 AS DOUBLE)) AS DOUBLE) END AS up FROM v_mask")
R.add("eval_metrics", lambda s, d: V.eval_row(_named(s, d)), _eval_sql())
R.add("write_metrics", lambda s, d: V.eval_row(_named(s, d)), _eval_sql())
R.add("round_metrics", lambda s, d: masks(s, d).select("clip_id", *(P.round_exact(F.col("clip_id") * k + F.col("pred_dx") / 8).alias(f"v{i}") for i, k in enumerate((0.001, 0.125, 1.0))), "image_rows"), "SELECT clip_id, " + ", ".join(f"CAST(printf('%.2f', CAST(clip_id * {k}::DOUBLE + pred_dx / 8 AS DOUBLE)) AS DOUBLE) AS v{i}" for i, k in enumerate((0.001, 0.125, 1.0))) + ", image_rows FROM v_mask")
R.add("report_manifest", lambda s, d: _metrics(s, d).select("clip_id", *(F.coalesce(F.when(F.col(m) > 0, F.format_string("%.3f", F.col(m))), F.lit("N/A")).alias(m) for m in METRICS)), f"WITH {GT}, {PRED}, {PAIRS}, x AS (SELECT m.clip_id, {METRIC_SQL}, " + ", ".join(f"{ERR} AS {m}" for m in METRICS[2:]) + " FROM v_mask m JOIN o ON o.clip_id = m.clip_id) SELECT clip_id, " + ", ".join(f"CASE WHEN {m} > 0 THEN printf('%.3f', {m}) ELSE 'N/A' END AS {m}" for m in METRICS) + " FROM x")
R.add("read_mask_config", lambda s, d: _read_config(s, d).select("clip_id", "mask_type", "angle1", "angle_min_degrees"), f"WITH {GT} SELECT clip_id, mask_type, CASE WHEN clip_id % 5 <> 0 THEN angle1 END AS angle1, CASE WHEN clip_id % 5 = 0 THEN angle1 END AS angle_min_degrees FROM gt")
R.add("normalise_mask_keys", lambda s, d: _read_config(s, d).select("clip_id", F.coalesce("mask_type", F.lit("fan")).alias("mask_type"), F.coalesce("angle1", "angle_min_degrees").alias("angle1"), F.coalesce("angle2", "angle_max_degrees").alias("angle2"), F.coalesce("radius1", "radius_min_px").alias("radius1"), F.coalesce("radius2", "radius_max_px").alias("radius2"), *(F.coalesce(f"center_{n}_px", F.get("center_coordinate_pixel", F.lit(i))).alias(f"center_{n}_px") for i, n in enumerate(("rows", "cols"))), F.coalesce("image_size_rows", F.lit(600)).alias("image_size_rows")), f"WITH {GT} SELECT clip_id, mask_type, angle1, angle2, radius1, radius2, cy AS center_rows_px, cx AS center_cols_px, CASE WHEN clip_id % 5 = 0 THEN 600 ELSE 480 END AS image_size_rows FROM gt")
R.add("config_columns", lambda s, d: _configs(s, d).select("clip_id", *(P.round_exact(F.col(f"gt.{c}")).alias(f"mask_{c}") if c.startswith("angle") else F.col(f"gt.{c}").alias(f"mask_{c}") for c in CFG), (F.col("gt.mask_type") == "fan").cast("int").alias("mask_is_fan")), f"WITH {GT} SELECT clip_id, " + ", ".join(f"CAST(printf('%.2f', CAST({c} AS DOUBLE)) AS DOUBLE) AS mask_{c}" if c.startswith("angle") else f"{c} AS mask_{c}" for c in CFG) + ", CASE WHEN clip_id % 3 = 0 THEN 0 ELSE 1 END AS mask_is_fan FROM gt")
R.add("write_sequence_info", lambda s, d: V.sequence_info(_named(s, d), "gt"), _info_sql())
R.add("denormalise_corners", lambda s, d: masks(s, d).select("clip_id", *(F.round(M.denormalise(_normal(2 * i + (a == "y")), F.col("image_cols" if a == "x" else "image_rows")), 6).alias(f"{c}_{a}") for i, c in enumerate(V.CORNERS) for a in "xy")), "SELECT clip_id, " + ", ".join(f"round((clip_id + {7 * (2 * i + (a == 'y'))}) % 97 * {640 if a == 'x' else 480} / 97, 6) AS {c}_{a}" for i, c in enumerate(V.CORNERS) for a in "xy") + " FROM v_mask")
R.add("corner_array", lambda s, d: masks(s, d).select("clip_id", F.posexplode(F.array(*(F.struct(F.col(f"gt_{c}_x").alias("x"), F.col(f"gt_{c}_y").alias("y")) for c in V.CORNERS))).alias("at", "p")).select("clip_id", "at", "p.x", "p.y"), " UNION ALL ".join(f"SELECT clip_id, {i} AS at, gt_{c}_x AS x, gt_{c}_y AS y FROM v_mask" for i, c in enumerate(V.CORNERS)))
R.add("merge_top_corners", lambda s, d: masks(s, d).select("clip_id", *(v.alias(k) for k, v in M.merge_top({**V.corner_columns("gt_"), "ur_x": F.col("gt_ul_x") + F.col("clip_id") % 20}).items() if k[0] == "u")), "SELECT clip_id, CASE WHEN clip_id % 20 < 15 THEN gt_ul_x + (clip_id % 20) / 2 ELSE gt_ul_x END AS ul_x, gt_ul_y AS ul_y, CASE WHEN clip_id % 20 >= 15 THEN gt_ul_x + clip_id % 20 END AS ur_x, CASE WHEN clip_id % 20 >= 15 THEN gt_ur_y END AS ur_y FROM v_mask")
R.add("order_corners", _ordered, "SELECT clip_id, CASE clip_id % 5 WHEN 1 THEN 'At least 3 control points are needed to define a mask' WHEN 2 THEN 'Only 4 control points are needed to define a mask' END AS message, "
      + ", ".join(f"CASE WHEN clip_id % 5 IN (1, 2) THEN NULL WHEN clip_id % 5 = 3 THEN {'NULL' if c == 'ur' else f'gt_{c}_{a}'} ELSE gt_{c}_{a} END AS {c}_{a}" for c in V.CORNERS for a in "xy") + " FROM v_mask")
R.add("redaction_height", lambda s, d: masks(s, d).select("clip_id", M.redaction_height(F.col("image_rows"), F.col("gt_ul_y") + 20 * F.col("pred_dy"), F.col("gt_ur_y") - 200, 0.2).alias("height")), "SELECT clip_id, CAST(CASE WHEN gt_ul_y + 20 * pred_dy > 0 THEN least(96, gt_ul_y + 20 * pred_dy) ELSE 96 END AS INT) AS height FROM v_mask")
R.add("redaction_mode", lambda s, d: masks(s, d).select("clip_id", M.redaction_mode(F.col("clip_id") % 2 == 0, F.col("clip_id") % 3 > 0, (F.col("clip_id") % 5) / 10, F.col("clip_id") % 7 > 0).alias("mode")), "SELECT clip_id, CASE WHEN clip_id % 2 = 1 THEN 'mask' WHEN clip_id % 3 = 0 OR clip_id % 5 = 0 OR clip_id % 7 = 0 THEN 'untouched' ELSE 'top' END AS mode FROM v_mask")
R.add("mask_erode", lambda s, d: V.of_each(_configs(s, d), "clip_id", ("gt",), lambda k: V.area(V.erode_edges(V.runs(k, "mask", "gt"), "mask", 480, 640, 0.0105), "mask", "pixels")), f"WITH {GT}, {PIXELS}, n AS (SELECT kid, x + i AS x, y + j AS y FROM px, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)), e AS (SELECT kid, x, y FROM n GROUP BY kid, x, y HAVING count(*) = 25), k AS (SELECT kid, count(*) AS pixels FROM e GROUP BY kid) SELECT gt.clip_id, pixels FROM gt JOIN one ON {SAME.format('gt', 'one')} JOIN k ON k.kid = one.kid")
R.add("mask_contour", lambda s, d: _contour(s, d), f"""WITH {GT}, {PIXELS}, h AS (SELECT kid, x + i AS x, y FROM px, (SELECT unnest(range(-3, 4)) AS i) GROUP BY ALL HAVING count(*) = 7), e AS (SELECT kid, x, y + j AS y FROM h, (SELECT unnest(range(-3, 4)) AS j) GROUP BY ALL HAVING count(*) = 7),
  n AS (SELECT kid, count(*) AS inside FROM e GROUP BY kid), w AS (SELECT kid, count(*) AS pixels FROM px GROUP BY kid) SELECT gt.clip_id, pixels, pixels - coalesce(inside, 0) AS rim FROM gt JOIN one ON {SAME.format('gt', 'one')} JOIN w ON w.kid = one.kid LEFT JOIN n ON n.kid = one.kid""")
R.add("sector_mask", lambda s, d: _between(lines(s, d)).groupBy("clip_id", "frame_number", "line_ord", "kind", "x2", "mask_type").agg(F.sum(F.col("b") - F.col("a") + 1).alias("pixels")),
      """WITH ang AS (SELECT *, least(round_even(degrees(atan2(y1, x1 - 50)), 6), round_even(degrees(atan2(y2, x2 - 50)), 6)) AS lo, greatest(round_even(degrees(atan2(y1, x1 - 50)), 6), round_even(degrees(atan2(y2, x2 - 50)), 6)) AS hi FROM v_line WHERE clip_id % 3 > 0),
  g AS (SELECT x, y FROM (SELECT unnest(range(-25, 26)) AS x), (SELECT unnest(range(1, 26)) AS y) WHERE x * x + y * y BETWEEN 100 AND 625),
  box AS (SELECT *, unnest(range(CAST(x1 AS BIGINT), least(128, CAST(x2 AS BIGINT)))) AS x FROM v_line WHERE clip_id % 3 = 0)
  SELECT clip_id, frame_number, line_ord, kind, x2, 'fan' AS mask_type, count(*) AS pixels FROM ang, g WHERE x >= y / tan(radians(hi)) - 1e-9 AND x <= y / tan(radians(lo)) + 1e-9 GROUP BY ALL
  UNION ALL SELECT clip_id, frame_number, line_ord, kind, x2, 'rectangle', CAST(sum(least(128, y2) - y1) AS BIGINT) FROM box WHERE x2 - x1 > 1 AND y2 - y1 > 1 GROUP BY clip_id, frame_number, line_ord, kind, x2""")
R.add("pleura_percentage", lambda s, d: V.pleura_percentage(_sectors(lines(s, d)), 128, 128), f"WITH {SECTOR_PIXELS.format('v_line')} {PERCENT}")
R.add("pleura_percentage_validated", lambda s, d: V.pleura_percentage(_sectors(_status_lines(s, d).where("status = 'validated'")), 128, 128), f"WITH {LATEST}, {SECTOR_PIXELS.format('''(SELECT * FROM sl WHERE status = 'validated')''')} {PERCENT}")
R.add("sector_corners", lambda s, d: lines(s, d).select("clip_id", "line_ord", P.sector_corners(*map(F.col, ("x1", "y1", "x2", "y2")), 50.0, -7.0, 10.0, 25.0).alias("c")).select("clip_id", "line_ord", *(F.round(f"c.{c}.{a}", 6).alias(f"{a}{i}_{r}") for c, i, r in (("ul", 1, 10), ("ll", 1, 25), ("ur", 2, 10), ("lr", 2, 25)) for a in "xy")), "SELECT clip_id, line_ord, " + ", ".join(f"round({c} + {r} * ({a}{i} - {c}) / sqrt((x{i} - 50) ^ 2 + (y{i} + 7) ^ 2), 6) AS {a}{i}_{r}" for i in (1, 2) for a, c in (("x", "50"), ("y", "(-7)")) for r in (10, 25)) + " FROM v_line")


def _contour(s, d):
    """Pixels of each mask and of its rim, three steps of a 3 x 3 erosion wide."""

    def rim(kinds):
        r = V.runs(kinds, "mask", "gt")
        e = r
        for _ in range(3):
            e = V.erode(e, "mask", 3)
        return V.area(r, "mask", "pixels").join(V.area(e, "mask", "inner"), "mask", "left").select("mask", "pixels", (F.col("pixels") - F.coalesce("inner", F.lit(0))).alias("rim"))

    return V.of_each(_configs(s, d), "clip_id", ("gt",), rim)
