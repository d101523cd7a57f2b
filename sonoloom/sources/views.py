"""Views over the given tables in the shapes the operators take: headers, lines, masks, validations, pixels.

Each text serves Spark (tables as DataFrames) and DuckDB (tables by name) alike.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

INSTANCES = """
SELECT concat('/in/p', CAST(o_custkey AS STRING), '/s', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '_',
         CAST(l_partkey AS STRING), '_', CAST(l_suppkey AS STRING),
         CASE WHEN l_partkey % 10 = 0 THEN '.txt' WHEN l_partkey % 10 = 1 THEN '.DCM' WHEN l_partkey % 10 = 2 THEN '.dicom' ELSE '.dcm' END) AS InputPath,
  concat('P', CAST(o_custkey AS STRING)) AS PatientID,
  concat('1.2.840.', CAST(l_orderkey AS STRING)) AS StudyInstanceUID,
  concat('1.2.840.', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS SeriesInstanceUID,
  CASE WHEN l_partkey % 17 = 0 THEN '' ELSE concat('1.2.840.', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING), '.',
         CAST(l_partkey AS STRING), '.', CAST(l_suppkey AS STRING)) END AS SOPInstanceUID,
  CASE WHEN l_suppkey % 8 = 0 THEN 'CT' ELSE 'US' END AS Modality,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(floor(l_quantity) AS INT) END AS NumberOfFrames,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount END AS PhysicalDeltaX,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax END AS PhysicalDeltaY,
  replace(substr(CAST(l_shipdate AS STRING), 1, 10), '-', '') AS ContentDate,
  CASE WHEN l_suppkey % 11 = 0 THEN 'invalid' ELSE replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') END AS StudyDate,
  concat(lpad(CAST(l_suppkey % 24 AS STRING), 2, '0'), '0000') AS ContentTime,
  CASE WHEN p_partkey % 4 = 0 THEN concat(p_type, ',', CAST(p_partkey AS STRING))
       WHEN p_partkey % 4 = 1 THEN concat(p_type, chr(92), 'UNUSED') WHEN p_partkey % 4 = 2 THEN '   ' ELSE NULL END AS TransducerData,
  CASE WHEN p_size % 7 = 0 THEN 'Butterfly Network Inc' ELSE p_brand END AS Manufacturer,
  p_name AS ManufacturerModelName,
  concat(lpad(CAST(p_size * 2 AS STRING), 3, '0'), CASE WHEN p_partkey % 5 = 0 THEN 'M' ELSE 'Y' END) AS PatientAge,
  concat(CAST(1940 + o_custkey % 60 AS STRING), '0615') AS PatientBirthDate,
  CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE replace(substr(CAST(l_shipdate AS STRING), 1, 10), '-', '') END AS SeriesDate,
  CASE WHEN p_size % 6 > 0 THEN 8 END AS BitsAllocated, CASE WHEN p_size % 6 > 0 THEN 8 END AS BitsStored, CASE WHEN p_size % 6 > 0 THEN 7 END AS HighBit,
  CASE WHEN p_size % 5 > 0 THEN 0 END AS PixelRepresentation, CASE WHEN o_custkey % 3 = 0 THEN 'F' WHEN o_custkey % 3 = 1 THEN 'M' END AS PatientSex,
  CASE WHEN l_linenumber < 6 THEN CAST(l_linenumber AS STRING) END AS SeriesNumber, CASE WHEN p_size % 9 > 0 THEN concat('ST', CAST(l_suppkey % 9 AS STRING)) END AS StationName,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS StudyDescription, concat(lpad(CAST(l_orderkey % 24 AS STRING), 2, '0'), '3000') AS StudyTime,
  CASE WHEN l_partkey % 3 = 0 THEN p_type WHEN l_partkey % 3 = 1 THEN '' END AS TransducerType,
  CASE WHEN l_partkey % 19 = 0 THEN NULL WHEN l_partkey % 19 = 1 THEN '' ELSE '1.2.840.10008.5.1.4.1.1.3.1' END AS SOPClassUID,
  CASE WHEN p_size % 3 = 0 THEN 3 ELSE 1 END AS SamplesPerPixel, CASE WHEN l_returnflag = 'A' THEN 'L' END AS Laterality,
  CASE WHEN l_linestatus = 'O' THEN CAST(l_linenumber AS STRING) END AS InstanceNumber, CASE WHEN l_returnflag = 'R' THEN 'A' END AS PatientOrientation,
  CASE WHEN l_linestatus = 'F' THEN concat('DERIVED', chr(92), 'PRIMARY') END AS ImageType, CASE WHEN l_suppkey % 2 = 0 THEN 1000.0 / l_quantity END AS FrameTime,
  CASE WHEN l_suppkey % 3 = 0 THEN '00181065' END AS FrameIncrementPointer, CASE WHEN l_suppkey % 5 = 0 THEN 1 END AS PlanarConfiguration
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""
LINES = """
SELECT l_orderkey AS clip_id, l_linenumber AS frame_number, lower(l_returnflag) AS rater,
  CASE WHEN l_linestatus = 'O' THEN 'pleura' ELSE 'b' END AS kind, l_partkey * 1000 + l_suppkey AS line_ord,
  CAST(20 + l_partkey % 60 AS DOUBLE) AS x1, CAST(10 + l_suppkey % 40 AS DOUBLE) AS y1,
  CAST(20 + l_partkey % 60 + floor(l_quantity) AS DOUBLE) AS x2, CAST(10 + l_suppkey % 40 + l_linenumber AS DOUBLE) AS y2,
  CASE WHEN l_suppkey % 2 = 0 THEN 'LPS' ELSE 'RAS' END AS coordinate_space
FROM {lineitem}
"""
MASKS = """
SELECT p_partkey AS clip_id, CAST(480 AS INT) AS image_rows, CAST(640 AS INT) AS image_cols,
  CAST(250 - p_size % 9 AS DOUBLE) AS gt_ul_x, CAST(60 AS DOUBLE) AS gt_ul_y, CAST(390 + p_size % 9 AS DOUBLE) AS gt_ur_x, CAST(60 AS DOUBLE) AS gt_ur_y,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 250 - p_size % 9 ELSE 120 END AS DOUBLE) AS gt_ll_x, CAST(400 AS DOUBLE) AS gt_ll_y,
  CAST(CASE WHEN p_partkey % 3 = 0 THEN 390 + p_size % 9 ELSE 520 END AS DOUBLE) AS gt_lr_x, CAST(400 AS DOUBLE) AS gt_lr_y,
  CAST(p_partkey % 7 AS DOUBLE) - 3 AS pred_dx, CAST(p_partkey % 5 AS DOUBLE) - 2 AS pred_dy
FROM {part}
"""
STATUSES = """
SELECT user_id AS line_id, event_id, ts, concat('adj', CAST(event_id % 4 AS STRING)) AS adjudicator,
  CASE WHEN event_type = 'purchase' THEN 'validated' WHEN event_type = 'error' THEN 'invalidated' ELSE 'unadjudicated' END AS status
FROM {events}
"""
PIXELS_DUCK = """
SELECT clip_id, frame_no, i - 1 AS pos, CAST(greatest(0, least(255, floor(CAST(embedding[i] AS DOUBLE) * 255 + 128))) AS INT) AS v
FROM (SELECT vec_id // 64 AS clip_id, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS frame_no, embedding, unnest(range(1, 65)) AS i FROM embeddings)
"""


COLOUR_DUCK = f"SELECT a.clip_id, a.frame_no, a.pos, c, CASE c WHEN 0 THEN a.v WHEN 1 THEN b.v ELSE 255 - a.v END AS v FROM ({PIXELS_DUCK}) a JOIN ({PIXELS_DUCK}) b ON a.clip_id = b.clip_id AND a.frame_no = b.frame_no AND b.pos = 63 - a.pos, (SELECT unnest([0, 1, 2]) AS c)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(text: str):
    names = set(re.findall(r"\{(\w+)\}", text))
    return lambda spark, sf_dir: spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


instances, lines, masks, statuses = map(_view, (INSTANCES, LINES, MASKS, STATUSES))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: clip_id, frame_no, height, width, channels, pixels (row-major array)."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "embeddings")
    pixel = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 255 + 128))).cast("int")
    clip = F.expr("vec_id div 64")  # clips of at most 64 frames, so a window holds one clip
    number = F.row_number().over(W.partitionBy(clip).orderBy("vec_id")) - 1
    return e.select(clip.alias("clip_id"), number.alias("frame_no"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.transform("embedding", pixel).alias("pixels"))


def colour_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of three interleaved channels: a frame's pixels, the same in reverse order, and their negative."""
    mixed = F.flatten(F.zip_with("pixels", F.reverse("pixels"), lambda a, b: F.array(a, b, 255 - a)))
    return frames(spark, sf_dir).withColumns({"pixels": mixed, "channels": F.lit(3)})


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(InputPath, json): each header as a nested document by element name, with a sequence of one or two items, the second with one of its own."""
    region = lambda at, **more: F.struct(F.lit(at).alias("Region"), *(v.alias(k.replace("_", " ")) for k, v in more.items()))
    inner = F.array(F.struct(F.concat(F.lit("inner "), "Manufacturer").alias("Manufacturer")))
    none = F.lit(None)
    one, two = region("1", Modality=F.col("Modality"), Inner_Sequence=none.cast("array<struct<Manufacturer:string>>")), region("2", Modality=none.cast("string"), Inner_Sequence=inner)
    regions = F.when(F.col("NumberOfFrames").isNull(), F.array(one)).otherwise(F.array(one, two))
    fields = {"Patient ID": F.col("PatientID"), "Patient's Name": F.concat(F.lit("Doe^"), "PatientID"), "Patient's Birth Date": F.col("PatientBirthDate"), "Modality": F.col("Modality"), "Sequence of Ultrasound Regions": regions, "Manufacturer": F.col("Manufacturer"), "Pixel Data": F.lit("AAAA"), "Transducer Data": F.col("TransducerData")}
    return instances(spark, sf_dir).select("InputPath", "PatientID", "SOPInstanceUID", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("json"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select("clip_id", "frame_no", F.posexplode("pixels").alias("pos", "v"))


def duck(body: str) -> str:
    """``body`` with the views it names as common tables."""
    found = {"v_instance": INSTANCES, "v_line": LINES, "v_mask": MASKS, "v_status": STATUSES, "v_pixel": PIXELS_DUCK, "v_colour": COLOUR_DUCK}
    used = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', t)})" for n, t in found.items() if re.search(rf"\b{n}\b", body)]
    if not used:
        return body
    return f"WITH {', '.join(used)} {body}" if not body.lstrip().upper().startswith("WITH ") else f"WITH {', '.join(used)}, {body.lstrip()[5:]}"
