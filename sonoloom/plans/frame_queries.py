"""Queries of the frame operators, over frames of 8 x 8 pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoloom.functions import points as P
from sonoloom.operators import frames as O, pixels as X
from sonoloom.plans.scratch import scratch_path
from sonoloom.plans.wiring import Registry
from sonoloom.sources import arrays, segmentations
from sonoloom.sources.views import colour_frames, frames

R = Registry()
KEY = ["clip_id", "frame_no"]


def _long(df, column, name="v", digits=None):
    out = df.select(*KEY, F.posexplode(column).alias("pos", name))
    return out if digits is None else out.withColumn(name, F.round(name, digits))


def _mask():
    """A rectangle of columns 2 to 5."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when((i % 8).between(2, 5), 1).otherwise(0))


BOUNDS = "quantile_cont(v::DOUBLE, 0.01) AS lo, quantile_cont(v::DOUBLE, 0.99) AS hi, min(v) AS mn, max(v) AS mx"


def _captured(s, d):
    return frames(s, d).where("frame_no % 3 = 0").select(*KEY, F.transform("pixels", lambda p: F.when(p > 140, 1).otherwise(0)).alias("labelmap"))


def _transforms(s, d):
    """A 4x4 matrix, row by row, for three of four frames: half a voxel a pixel, shifted by clip, a quarter a frame."""
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [F.lit(0.5), zero, zero, F.col("clip_id") % 3 * 0.25, zero, F.lit(0.5), zero, zero, zero, zero, one, F.col("frame_no") * 0.25, zero, zero, zero, one]
    return frames(s, d).where("frame_no % 4 < 3").select(*KEY, F.array(*(x.cast("double") for x in rows)).alias("m"))


def _points(s, d):
    """Every pixel of every frame at its place, through its frame's transform; the identity where there is none."""
    at = O.with_transform(frames(s, d), _transforms(s, d)).select(*KEY, "m", F.posexplode("pixels").alias("pos", "v"))
    px, py, pz = P.move(F.col("m"), F.col("pos") % 8, F.floor(F.col("pos") / 8), F.lit(0))
    return at.select(*KEY, "pos", "v", px.alias("px"), py.alias("py"), pz.alias("pz"))


def _placed(s, d):
    """Labelled pixels of the captured frames at their places."""
    return _points(s, d).where("frame_no % 3 = 0 AND v > 140").select(*KEY, "pos", "px", "py", "pz", F.lit(255).alias("v"))


R.add("apply_mask", lambda s, d: _long(frames(s, d).withColumn("m", O.apply_mask(F.col("pixels"), F.when(F.col("clip_id") % 2 == 0, _mask()))), "m"), "SELECT clip_id, frame_no, pos, CASE WHEN clip_id % 2 = 1 OR pos % 8 IN (2, 3, 4, 5) THEN v ELSE 0 END AS v FROM v_pixel")
R.add("top_redaction", lambda s, d: _long(frames(s, d).withColumn("m", O.top_redaction(F.col("pixels"), F.col("width") * F.col("channels"), F.lit(3))), "m"), "SELECT clip_id, frame_no, pos, CASE WHEN pos // 8 < 3 THEN 0 ELSE v END AS v FROM v_pixel")
R.add("threshold_frames", lambda s, d: _long(frames(s, d).withColumn("m", O.threshold(F.col("pixels"), 120)), "m").join(_long(frames(s, d).withColumn("m", O.threshold(F.col("pixels"), 120, True)), "m", "inverted"), [*KEY, "pos"]), "SELECT clip_id, frame_no, pos, CASE WHEN v >= 120 THEN v ELSE 0 END AS v, CASE WHEN v <= 120 THEN v ELSE 0 END AS inverted FROM v_pixel")
R.add("binarise_labelmap", lambda s, d: _long(_captured(s, d).withColumn("m", F.transform("labelmap", lambda x: x * 255)), "m"), "SELECT clip_id, frame_no, pos, CASE WHEN v > 140 THEN 255 ELSE 0 END AS v FROM v_pixel WHERE frame_no % 3 = 0")
R.add("skip_frames", lambda s, d: O.skip_frames(frames(s, d), 2).select(*KEY), "SELECT DISTINCT clip_id, frame_no FROM v_pixel WHERE frame_no % 3 = 0")
R.add("max_pool_frames", lambda s, d: X.max_pool(colour_frames(s, d)).select("clip_id", F.posexplode("pixels").alias("pos", "v")), "SELECT clip_id, CAST(pos * 3 + c AS INT) AS pos, max(v) AS v FROM v_colour GROUP BY ALL")
R.add("normalise_frame", lambda s, d: _normalised(s, d), f"""WITH b AS (SELECT clip_id, frame_no, {BOUNDS} FROM v_pixel GROUP BY 1, 2), c AS (SELECT clip_id, frame_no, CASE WHEN lo = hi THEN mn ELSE lo END AS lo, CASE WHEN lo = hi THEN mx ELSE hi END AS hi FROM b), k AS (SELECT clip_id, frame_no, c, min(v) AS mn, max(v) AS mx FROM v_colour GROUP BY 1, 2, 3) SELECT 1 AS channels, clip_id, frame_no, CAST(pos AS INT) AS pos, round(CASE WHEN hi > lo THEN greatest(0, least(1, (v - lo) / (hi - lo))) ELSE 0 END, 6) AS v FROM v_pixel JOIN c USING (clip_id, frame_no)
  UNION ALL SELECT 3, clip_id, frame_no, CAST(pos * 3 + c AS INT), round(CASE WHEN mx > mn THEN (v - mn) / (mx - mn) ELSE 0 END, 6) FROM v_colour JOIN k USING (clip_id, frame_no, c)""")
R.add("contrast_window", lambda s, d: O.percentile_bounds(frames(s, d), 0.02, 0.98).select(*KEY, F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round(F.aggregate("pixels", F.lit(0.0), lambda a, p: a + F.pow(p / 255, F.lit(0.7))), 6).alias("gamma_sum")), "SELECT clip_id, frame_no, round(quantile_cont(v::DOUBLE, 0.02), 6) AS low, round(quantile_cont(v::DOUBLE, 0.98), 6) AS high, round(sum((v / 255) ^ 0.7), 6) AS gamma_sum FROM v_pixel GROUP BY 1, 2")
R.add("frame_diff", lambda s, d: _long(frames(s, d).alias("a").join(frames(s, d).select("clip_id", (F.col("frame_no") - 1).alias("frame_no"), F.col("pixels").alias("after")), KEY).withColumn("m", O.frame_diff(F.col("pixels"), F.col("after"))), "m"), "SELECT a.clip_id, a.frame_no, a.pos, abs(a.v - b.v) AS v FROM v_pixel a JOIN v_pixel b ON a.clip_id = b.clip_id AND a.pos = b.pos AND b.frame_no = a.frame_no + 1")
R.add("image_attributes", lambda s, d: O.image_attributes(frames(s, d).unionByName(colour_frames(s, d).withColumn("clip_id", -1 - F.col("clip_id")))), """WITH n AS (SELECT clip_id, count(DISTINCT frame_no) AS frames FROM v_pixel GROUP BY 1)
  SELECT clip_id, frames, 8 AS height, 8 AS width, 1 AS samples, 'MONOCHROME2' AS photometric FROM n UNION ALL SELECT -1 - clip_id, frames, 8, 8, 3, 'YBR_FULL_422' FROM n""")
TAP = "CAST(greatest(0, least(7, {0})) AS DOUBLE)"
SAMPLE = """s AS (SELECT k, 1.0 + 4.5 * k / 9 AS x, 6.5 - 5.5 * k / 9 AS y FROM (SELECT unnest(range(10)) AS k)),
  tap AS (SELECT k, CAST(floor(x) + i AS INT) AS xi, CAST(floor(y) + j AS INT) AS yj, (CASE i WHEN 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) * (CASE j WHEN 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) AS w FROM s, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)),
  sm AS (SELECT clip_id, frame_no, k AS depth, sum(w * v) AS v FROM tap JOIN v_pixel ON pos = least(7, yj) * 8 + least(7, xi) GROUP BY 1, 2, 3)"""
_samples = lambda s, d: O.sample_line(frames(s, d), 5.5, 1.0, 1.0, 6.5, 10)
R.add("sample_line", lambda s, d: _sampled(s, d), f"""WITH {SAMPLE}, sc AS (SELECT clip_id, frame_no, k AS depth, c, sum(w * v) AS v FROM tap JOIN v_colour ON pos = least(7, yj) * 8 + least(7, xi) GROUP BY 1, 2, 3, 4)
  SELECT clip_id, frame_no, CAST(depth AS INT) AS depth, CAST(c AS INT) AS channel, round(v, 6) AS v FROM sc UNION ALL SELECT clip_id, frame_no, CAST(depth AS INT), -1, round(avg(v), 6) FROM sc GROUP BY 1, 2, 3""")
R.add("mmode_image", lambda s, d: O.mmode_image(_samples(s, d)).select("clip_id", "depth", F.size("row").alias("columns"), F.round(F.get("row", F.lit(0)), 6).alias("first"), F.round(F.element_at("row", -1), 6).alias("last")), f"WITH {SAMPLE} SELECT clip_id, CAST(depth AS INT) AS depth, CAST(count(*) AS INT) AS columns, round(arg_min(v, frame_no), 6) AS first, round(arg_max(v, frame_no), 6) AS last FROM sm GROUP BY 1, 2")
R.add("mmode_scale", lambda s, d: _scaled(s, d), f"""WITH {SAMPLE}, o AS (SELECT clip_id, depth, v, row_number() OVER (PARTITION BY clip_id, depth ORDER BY frame_no) - 1 AS a, count(*) OVER (PARTITION BY clip_id, depth) AS n FROM sm),
  g AS (SELECT DISTINCT clip_id, n, CAST(round_even(n * greatest(25 / 20.0::DOUBLE / (0.4::DOUBLE + clip_id % 5 * 0.6::DOUBLE), 10 / n), 0) AS BIGINT) AS m FROM o), i AS (SELECT clip_id, n, m, unnest(range(m)) AS i FROM g),
  t AS (SELECT *, CASE WHEN m > 1 THEN i * (n - 1) / (m - 1) ELSE 0 END AS src FROM i)
  SELECT t.clip_id, CAST(x.depth AS INT) AS depth, m - 1 - i AS "column", round(x.v + (coalesce(y.v, x.v) - x.v) * (src - floor(src + 1e-9)), 6) AS v FROM t JOIN o x ON x.clip_id = t.clip_id AND x.a = floor(src + 1e-9) LEFT JOIN o y ON y.clip_id = x.clip_id AND y.depth = x.depth AND y.a = x.a + 1""")
R.add("model_input_frame", lambda s, d: X.model_input(colour_frames(s, d), 5, 12).select("clip_id", F.posexplode("pixels").alias("pos", "v")), """WITH m AS (SELECT clip_id, pos, c, max(v) AS v FROM v_colour GROUP BY ALL), g AS (SELECT clip_id, pos, (sum(v * CASE c WHEN 0 THEN 19595 WHEN 1 THEN 38470 ELSE 7471 END) + 32768) // 65536 AS v FROM m GROUP BY ALL),
  t AS (SELECT r * 12 + q AS pos, greatest(0, least(70, (2 * r + 1) * 8 - 5)) AS y, greatest(0, least(168, (2 * q + 1) * 8 - 12)) AS x FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(12)) AS q)),
  w AS (SELECT pos, least(7, y // 10 + j) * 8 + least(7, x // 24 + i) AS p, (CASE i WHEN 1 THEN x % 24 ELSE 24 - x % 24 END) * (CASE j WHEN 1 THEN y % 10 ELSE 10 - y % 10 END) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
  SELECT clip_id, CAST(w.pos AS INT) AS pos, CAST((2 * sum(w * v) + 240) // 480 AS DOUBLE) AS v FROM w JOIN g ON g.pos = p GROUP BY 1, 2""")
R.add("dense_segmentation", lambda s, d: O.dense_segmentation(frames(s, d), _captured(s, d)).select(*KEY, F.aggregate("labelmap", F.lit(0), lambda a, x: a + x).alias("labelled"), F.size("labelmap").alias("n")), "SELECT clip_id, frame_no, CAST(sum(CASE WHEN frame_no % 3 = 0 AND v > 140 THEN 1 ELSE 0 END) AS INT) AS labelled, 64 AS n FROM v_pixel GROUP BY 1, 2")
R.add("capture_upsert", lambda s, d: _upserted(s, d), "SELECT clip_id, frame_no, CASE WHEN frame_no % 2 = 0 THEN 1 ELSE 0 END AS fresh, CAST(sum(CASE WHEN v > 140 THEN 1 ELSE 0 END) AS INT) AS labelled FROM v_pixel WHERE (frame_no % 3 = 0 OR frame_no % 2 = 0) AND frame_no % 10 <> 4 AND clip_id % 5 <> 2 GROUP BY 1, 2, 3")
PLACE = """CASE WHEN frame_no % 4 = 3 THEN pos % 8 ELSE pos % 8 * 0.5::DOUBLE + clip_id % 3 * 0.25::DOUBLE END AS px, CASE WHEN frame_no % 4 = 3 THEN pos // 8 ELSE pos // 8 * 0.5::DOUBLE END AS py,
  CASE WHEN frame_no % 4 = 3 THEN 0 ELSE frame_no * 0.25::DOUBLE END AS pz"""
NEAR = """near AS (SELECT clip_id, frame_no, pos, floor(px) + i AS x, floor(py) + j AS y, floor(pz) + k AS z, (CASE i WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE j WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE k WHEN 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) AS w
  FROM (SELECT clip_id, frame_no, pos, {0} FROM v_pixel {1}), (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k))"""
SLICES = f"""{NEAR.format(PLACE, '')}, vox AS (SELECT clip_id, pos % 8 AS x, pos // 8 AS y, frame_no AS z, v FROM v_pixel), sl AS (SELECT clip_id, frame_no, pos, round(sum(w * coalesce(v, 0)), 6) AS v FROM near LEFT JOIN vox USING (clip_id, x, y, z) WHERE w > 0 GROUP BY 1, 2, 3)"""
NEAR = NEAR.format(PLACE, "WHERE frame_no % 3 = 0 AND v > 140")
R.add("reconstruct_volume", lambda s, d: O.reconstruct(_placed(s, d)).withColumn("v", F.round("v", 6)), f"WITH {NEAR} SELECT clip_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(z AS INT) AS z, round(max(w) * 255, 6) AS v FROM near WHERE w > 0 GROUP BY 1, 2, 3, 4")
R.add("reslice_secondary", lambda s, d: _resliced(s, d), f"WITH {SLICES} SELECT * FROM sl")


R.add("export_arrays", lambda s, d: _exported(s, d), f"""WITH {SLICES}, sums AS (SELECT clip_id, frame_no, round(sum(v), 3) AS slice_sum FROM sl GROUP BY 1, 2),
  own AS (SELECT clip_id, frame_no, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos)) AS frame_digest, frame_no % 3 = 0 AS captured, CAST(count(*) FILTER (frame_no % 3 = 0 AND v > 140) AS INT) AS labelled FROM v_pixel GROUP BY 1, 2)
  SELECT *, CASE WHEN frame_no % 4 = 3 THEN '100,0,0,0,0,100,0,0,0,0,100,0,0,0,0,100' ELSE '50,0,0,' || CAST(clip_id % 3 * 25 AS INT) || ',0,50,0,0,0,0,100,' || CAST(frame_no * 25 AS INT) || ',0,0,0,100' END AS transform FROM own JOIN sums USING (clip_id, frame_no)""")
R.add("reslice_secondary_all", lambda s, d: _resliced_all(s, d))


def _upserted(s, d):
    """A stored table after an upsert, the removal of some frames and of some whole clips."""
    path, labels = scratch_path(s, "segmentation_table"), F.transform("pixels", lambda p: F.when(p > 140, 1).otherwise(0)).alias("labelmap")
    segmentations.create(_captured(s, d).withColumn("fresh", F.lit(0)), path)
    segmentations.upsert(frames(s, d).where("frame_no % 2 = 0").select(*KEY, labels, F.lit(1).alias("fresh")), path)
    segmentations.remove_frames(frames(s, d).where("frame_no % 10 = 4").select(*KEY), path)
    segmentations.remove_clips(frames(s, d).where("clip_id % 5 = 2").select("clip_id").distinct(), path)
    return segmentations.read(s, path).select(*KEY, "fresh", F.aggregate("labelmap", F.lit(0), lambda a, x: a + x).alias("labelled"))


def _resliced(s, d):
    """Every pixel of every frame, through its transform, sampled in its own clip's volume."""
    vox = frames(s, d).select("clip_id", F.col("frame_no").alias("z"), F.posexplode("pixels").alias("p", "v")).select("clip_id", (F.col("p") % 8).alias("x"), F.floor(F.col("p") / 8).cast("int").alias("y"), "z", "v")
    points = _points(s, d).select("clip_id", F.struct("clip_id", "frame_no", "pos").alias("key"), "px", "py", "pz")
    return O.reslice(points, vox, ("clip_id",)).select("key.*", F.round("v", 6).alias("v"))


def _exported(s, d):
    """The five aligned outputs of each frame, written and committed together, read back, arrays as digests and sums."""
    slices = _resliced(s, d).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("slice"))
    whole = O.with_transform(O.dense_segmentation(frames(s, d), _captured(s, d)).join(frames(s, d).select(*KEY, "pixels"), KEY), _transforms(s, d))
    captured = _captured(s, d).select(*KEY, F.lit(True).alias("captured"))
    path = scratch_path(s, "export")
    arrays.export_arrays(whole.join(slices, KEY).join(captured, KEY, "left").select(*KEY, "pixels", "m", "slice", "labelmap", F.coalesce("captured", F.lit(False)).alias("captured")), path)
    held = arrays.read_export(s, path)
    both = held["frames"]
    for name in list(held)[1:]:
        both = both.join(held[name], KEY)
    return both.select(
        *KEY, F.md5(F.array_join("pixels", ",")).alias("frame_digest"), F.array_join(F.transform("m", lambda x: F.round(x * 100).cast("int")), ",").alias("transform"),
        F.round(F.aggregate("slice", F.lit(0.0), lambda a, x: a + x), 3).alias("slice_sum"), F.aggregate("labelmap", F.lit(0), lambda a, x: a + x).alias("labelled"), "captured",
    )


def _resliced_all(s, d):
    """Every pixel of every frame, sampled in its own clip's volume."""
    at = frames(s, d).select(*KEY, F.posexplode("pixels").alias("pos", "v")).select(*KEY, "pos", "v", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).cast("int").alias("y"))
    points = at.select("clip_id", F.struct("clip_id", "frame_no", "pos").alias("key"), (F.col("x") * 0.5).alias("px"), (F.col("y") * 0.5).alias("py"), (F.col("frame_no") * 0.25).alias("pz"))
    vox = at.select("clip_id", "x", "y", F.col("frame_no").alias("z"), "v")
    return O.reslice(points, vox, ("clip_id",)).select("key.*", F.round("v", 6).alias("v"))


def _normalised(s, d):
    """Grey frames between percentiles and colour frames by channel."""
    long = lambda df, n: _long(X.normalise(df), "scaled", digits=6).withColumn("channels", F.lit(n))
    return long(frames(s, d), 1).unionByName(long(colour_frames(s, d), 3))


def _sampled(s, d):
    """Each channel along the line, and their mean as channel -1."""
    line = (5.5, 1.0, 1.0, 6.5, 10)
    each = O.sample_channels(colour_frames(s, d), *line).select(*KEY, "depth", F.posexplode("values").alias("channel", "v"))
    mean = O.sample_line(colour_frames(s, d), *line).withColumn("channel", F.lit(-1))
    return each.unionByName(mean).withColumn("v", F.round("v", 6))


def _scaled(s, d):
    """Spacings that give fewer and more columns than frames."""
    n = frames(s, d).groupBy("clip_id").agg(F.count("*").alias("n"))
    zoom = O.time_zoom(F.lit(25.0), 0.4 + F.col("clip_id") % 5 * 0.6, F.lit(10), F.col("n"))
    return O.zoom_in_time(_samples(s, d).join(n, "clip_id"), zoom).withColumn("v", F.round("v", 6))
