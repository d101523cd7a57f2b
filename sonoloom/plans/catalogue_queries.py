"""Queries of the catalogue and de-identification operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonoloom.functions import headers as H
from sonoloom.operators import catalogue as C
from sonoloom.plans.scratch import materialise, scratch_path
from sonoloom.plans.wiring import Registry
from sonoloom.sources.headers import read_headers
from sonoloom.sources.views import headers, instances, table

R = Registry()
ID = "InputPath, StudyInstanceUID, Modality"
#: Most headers in a file of them: a compressed file is read by one task.
HEADERS_PER_FILE = 200_000
#: The hash of a text as DuckDB computes it: sixteen bits at a time.
HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 16), lambda i: CAST('0x' || sha256({0})[i * 4 + 1 : i * 4 + 4] AS BIGINT))), lambda a, x: (a * 65536 + x) % {1})"
IDHASH = lambda c, n: f"lpad(CAST({HASH.format(c, 10**n)} AS VARCHAR), {n}, '0')"
EXT = "(lower(InputPath) LIKE '%.dcm' OR lower(InputPath) LIKE '%.dicom')"
IDS = "PatientID <> '' AND StudyInstanceUID <> '' AND SeriesInstanceUID <> '' AND SOPInstanceUID <> ''"
NAME = f"({IDHASH('PatientID', 10)} || '_' || {IDHASH('SOPInstanceUID', 8)} || '.dcm')"
MODEL = """coalesce(nullif(lower(trim(split_part(split_part(trim(CASE WHEN Manufacturer ILIKE '%butterfly%' THEN ManufacturerModelName ELSE TransducerData END), chr(92), 1), ',', 1))), ''), 'unknown')"""
CAT = f"""cat AS (SELECT InputPath, {NAME} AS AnonFilename, PatientID AS PatientUID, StudyInstanceUID AS StudyUID, SeriesInstanceUID AS SeriesUID, SOPInstanceUID AS InstanceUID,
  PhysicalDeltaX, PhysicalDeltaY, ContentDate, ContentTime, (PhysicalDeltaX IS NULL OR PhysicalDeltaY IS NULL) AS Patch, {MODEL} AS TransducerModel
  FROM v_instance WHERE {EXT} AND Modality = 'US' AND {IDS})"""
FILLED = """(SELECT * REPLACE (
  coalesce(PhysicalDeltaX, (SELECT arg_max(b.PhysicalDeltaX, b.InputPath) FROM cat b WHERE b.StudyUID = a.StudyUID AND b.InputPath < a.InputPath AND b.PhysicalDeltaX IS NOT NULL), (SELECT arg_min(b.PhysicalDeltaX, b.InputPath) FROM cat b WHERE b.StudyUID = a.StudyUID AND b.InputPath > a.InputPath AND b.PhysicalDeltaX IS NOT NULL)) AS PhysicalDeltaX,
  coalesce(PhysicalDeltaY, (SELECT arg_max(b.PhysicalDeltaY, b.InputPath) FROM cat b WHERE b.StudyUID = a.StudyUID AND b.InputPath < a.InputPath AND b.PhysicalDeltaY IS NOT NULL), (SELECT arg_min(b.PhysicalDeltaY, b.InputPath) FROM cat b WHERE b.StudyUID = a.StudyUID AND b.InputPath > a.InputPath AND b.PhysicalDeltaY IS NOT NULL)) AS PhysicalDeltaY) FROM cat a)"""
SERIES = "(SELECT count(*) FROM cat b WHERE b.PatientUID = a.PatientUID AND b.StudyUID = a.StudyUID AND b.InputPath <= a.InputPath)"


def _cat(s, d):
    return C.scan(instances(s, d))


def _from_files(s, d):
    """The catalogue of header files: the headers written as text, one on a line, and read by the data source."""
    i = instances(s, d)
    spacing = [F.col(c).cast("double").alias(c) for c in ("PhysicalDeltaX", "PhysicalDeltaY")]
    head = F.struct(*(c for c in i.columns if c not in ("PhysicalDeltaX", "PhysicalDeltaY")), F.array(F.struct(*spacing)).alias("SequenceOfUltrasoundRegions"))
    path = scratch_path(s, "headers")
    i.select(F.to_json(head)).write.option("maxRecordsPerFile", HEADERS_PER_FILE).text(path, compression="gzip")
    return C.scan(read_headers(s, path, lines=True)).withColumns({c: F.col(c).cast(i.schema[c].dataType) for c in ("PhysicalDeltaX", "PhysicalDeltaY")})


def _paths(s, d):
    """Paths of JSON siblings: half are header dumps, and folders repeat names."""
    p = H.stem(F.col("InputPath"))
    return instances(s, d).select(F.concat(p, F.when(F.col("Modality") == "CT", "_DICOMHeader.json").otherwise(".json")).alias("path"))


def _with_outputs(s, d):
    """The catalogue, hashed and written once, and output files of its even series, as an earlier run would have left them."""
    cat = materialise(_cat(s, d).select("InputPath", "AnonFilename", "PatientUID", "StudyUID", "ContentDate", "ContentTime"), "catalogue")
    return cat, C.series_number(cat).where("SeriesNumber % 2 = 0").select(F.col("AnonFilename").alias("name"))


def _saved(s, d):
    """Masks saved from noon on, by model and time; read twice, so written once."""
    rows = _cat(s, d).select("InputPath", F.col("TransducerModel").alias("model"), F.struct("ContentDate", "ContentTime", "InputPath").alias("seq"), F.when(F.col("ContentTime") >= "120000", F.col("AnonFilename")).alias("mask"))
    return materialise(rows, "saved")


def _results(s, d):
    i = instances(s, d)
    return i.select("PatientID", (F.col("Modality") == "CT").alias("skipped"), F.when(H.blank(F.col("SOPInstanceUID")) & (F.col("Modality") == "US"), F.concat(F.lit("no instance: "), "InputPath")).alias("error"))


def _regions(s, d):
    """Headers with none, one or two regions; the second has other deltas."""
    region = lambda f: F.struct((F.col("PhysicalDeltaX") * f).alias("PhysicalDeltaX"), (F.col("PhysicalDeltaY") * f).alias("PhysicalDeltaY"))
    return instances(s, d).select("InputPath", F.when(F.col("NumberOfFrames") % 3 == 1, F.array(region(1))).when(F.col("NumberOfFrames") % 3 == 2, F.array(region(1), region(9))).when(F.col("NumberOfFrames") % 3 == 0, F.array().cast("array<struct<PhysicalDeltaX:double,PhysicalDeltaY:double>>")).alias("regions"))


OUTPUTS = f"outs AS (SELECT DISTINCT AnonFilename FROM (SELECT AnonFilename, {SERIES} AS n FROM cat a) WHERE n % 2 = 0)"
JSON_PATH = "regexp_replace(InputPath, '[.][^.]*$', '') || CASE WHEN Modality = 'CT' THEN '_DICOMHeader.json' ELSE '.json' END"
BASE = "regexp_replace({0}, '^.*/', '')"

R.add("scan_catalogue", _cat, f"WITH {CAT} SELECT * FROM cat")
R.add("scan_header_files", lambda s, d: _from_files(s, d), f"WITH {CAT} SELECT * FROM cat")
R.add("scan_first_by_basename", lambda s, d: C.first_by_basename(instances(s, d)), f"SELECT {BASE.format('InputPath')} AS base, min(InputPath) AS InputPath FROM v_instance WHERE InputPath ILIKE '%.dcm' GROUP BY 1")
R.add("index_ground_truth", lambda s, d: C.index_ground_truth(_paths(s, d)), f"WITH f AS (SELECT {JSON_PATH} AS path FROM v_instance) SELECT {BASE.format('path')} AS name, min(path) AS path, count(*) - 1 AS duplicates FROM f WHERE path NOT ILIKE '%~_dicomheader.json' ESCAPE '~' GROUP BY 1")
R.add("collect_files", lambda s, d: C.collect_files(instances(s, d).select(F.col("InputPath").alias("path")).union(_paths(s, d))), f"WITH f AS (SELECT InputPath AS path FROM v_instance UNION ALL SELECT {JSON_PATH} FROM v_instance) SELECT {BASE.format('path')} AS name, max(path) AS path FROM f WHERE path ILIKE '%.dcm' OR path ILIKE '%.json' GROUP BY 1")
R.add("read_labels", lambda s, d: table(s, d, "part").select(F.concat_ws(",", "p_brand", F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("value")).select(F.from_csv("value", F.lit("category string, label string"), {"ignoreLeadingWhiteSpace": "true"}).alias("r")).select(F.trim("r.category").alias("category"), F.trim("r.label").alias("label")).groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("label")), "|").alias("labels")), "SELECT p_brand AS category, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS labels FROM part GROUP BY 1")
R.add("write_keys", lambda s, d: C.write_keys(C.catalogue(instances(s, d)), "/in/").select("InputPath", "AnonFilename", "PatientUID", "StudyUID", "SeriesUID", "InstanceUID", F.round(F.col("PhysicalDeltaX") * 100).cast("int").alias("dx"), F.round(F.col("PhysicalDeltaY") * 100).cast("int").alias("dy"), "ContentDate", "ContentTime", "Patch", "TransducerModel", F.col("SeriesNumber").cast("long").alias("SeriesNumber")),
      f"WITH {CAT}, a AS {FILLED} SELECT substr(InputPath, 5) AS InputPath, AnonFilename, PatientUID, StudyUID, SeriesUID, InstanceUID, CAST(round(PhysicalDeltaX * 100) AS INT) AS dx, CAST(round(PhysicalDeltaY * 100) AS INT) AS dy, ContentDate, ContentTime, Patch, TransducerModel, CAST({SERIES} AS BIGINT) AS SeriesNumber FROM a")
R.add("write_header_json", lambda s, d: C.header_json(headers(s, d), H.stem(H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID")))), f"""SELECT InputPath, '{{"Patient ID":"' || PatientID || '","Patient''s Name":"' || CASE WHEN SOPInstanceUID = '' THEN '' ELSE replace({NAME}, '.dcm', '') END || '","Patient''s Birth Date":"' || substr(PatientBirthDate, 1, 4) || '0101","Modality":"' || Modality
  || '","Sequence of Ultrasound Regions":[{{"Region":"1","Modality":"' || Modality || '"}}' || CASE WHEN NumberOfFrames IS NULL THEN '' ELSE ',{{"Region":"2","Inner Sequence":[{{"Manufacturer":"inner ' || Manufacturer || '"}}]}}' END || '],"Manufacturer":"' || Manufacturer || '"'
  || CASE WHEN TransducerData IS NULL THEN '' ELSE ',"Transducer Data":"' || replace(TransducerData, chr(92), chr(92) || chr(92)) || '"' END || '}}' AS json FROM v_instance""")
R.add("filter_modality", lambda s, d: C.filter_modality(instances(s, d)).select("InputPath", "StudyInstanceUID", "Modality"), f"SELECT {ID} FROM v_instance WHERE Modality IN ('US')")
R.add("filter_multiframe", lambda s, d: C.filter_multiframe(instances(s, d)).select("InputPath", "NumberOfFrames"), "SELECT InputPath, NumberOfFrames FROM v_instance WHERE NOT (NumberOfFrames IS NULL OR NumberOfFrames < 2)")
R.add("filter_required_ids", lambda s, d: C.filter_required_ids(instances(s, d)).select("InputPath", "SOPInstanceUID"), "SELECT InputPath, SOPInstanceUID FROM v_instance WHERE length(SOPInstanceUID) > 0 AND length(PatientID) > 0")
R.add("relative_path", lambda s, d: instances(s, d).select("InputPath", H.relative_path(F.col("InputPath"), "/in").alias("a"), H.relative_path(F.col("InputPath"), "/in/").alias("b"), H.relative_path(F.col("InputPath"), "").alias("c"), H.relative_path(F.col("InputPath"), "/elsewhere").alias("d")), "SELECT InputPath, substr(InputPath, 5) AS a, substr(InputPath, 5) AS b, InputPath AS c, InputPath AS d FROM v_instance")
R.add("output_path", lambda s, d: _cat(s, d).select("InputPath", H.output_path(F.col("InputPath"), F.col("AnonFilename"), "/in", True).alias("tree"), H.output_path(F.col("InputPath"), F.col("AnonFilename"), "/in", False).alias("flat")), f"WITH {CAT} SELECT InputPath, split_part(InputPath, '/', 3) || '/' || split_part(InputPath, '/', 4) || '/' || AnonFilename AS tree, AnonFilename AS flat FROM cat")
R.add("transducer_model", lambda s, d: instances(s, d).select("InputPath", H.transducer_model(F.col("TransducerData"), F.col("Manufacturer"), F.col("ManufacturerModelName")).alias("model")), f"SELECT InputPath, {MODEL} AS model FROM v_instance")
R.add("extract_spacing", lambda s, d: C.extract_spacing(_regions(s, d)).select("InputPath", "dx", "dy"), "SELECT InputPath, CASE WHEN NumberOfFrames % 3 > 0 THEN PhysicalDeltaX END AS dx, CASE WHEN NumberOfFrames % 3 > 0 THEN PhysicalDeltaY END AS dy FROM v_instance")
R.add("patch_flag", lambda s, d: instances(s, d).select("InputPath", C.patch_flag().alias("patch")), "SELECT InputPath, NOT (PhysicalDeltaX IS NOT NULL AND PhysicalDeltaY IS NOT NULL) AS patch FROM v_instance")
R.add("pixel_spacing", lambda s, d: instances(s, d).select("InputPath", H.pixel_spacing(F.col("PhysicalDeltaX").cast("double")).alias("mm")), "SELECT InputPath, CASE WHEN PhysicalDeltaX IS NOT NULL THEN printf('%.14f', CAST(PhysicalDeltaX AS DOUBLE) * 10) END AS mm FROM v_instance")
R.add("tag_allowlist", lambda s, d: C.tag_allowlist(instances(s, d)), "SELECT InputPath, BitsAllocated, BitsStored, HighBit, PatientAge, PatientSex, PixelRepresentation, SeriesNumber, StationName, StudyDate, StudyDescription, StudyTime, Manufacturer, coalesce(TransducerData, '') AS TransducerData, coalesce(TransducerType, '') AS TransducerType, coalesce(ManufacturerModelName, '') AS ManufacturerModelName FROM v_instance")
DIGITS = "CAST(CAST('0x' || sha256('{0}|' || InputPath)[{1}] AS UBIGINT) AS HUGEINT)"
UID = "CASE WHEN coalesce({0}, '') <> '' THEN {0} ELSE '2.25.' || ({1}) END AS {0}"
R.add("uid_passthrough", lambda s, d: C.uid_passthrough(instances(s, d)), "SELECT InputPath, " + ", ".join(UID.format(c, f"{DIGITS.format(c, '1 : 15')} * 18446744073709551616 + {DIGITS.format(c, '16 : 31')}") for c in ("SOPClassUID", "SOPInstanceUID", "SeriesInstanceUID", "StudyInstanceUID")) + " FROM v_instance")
R.add("conformance_defaults", lambda s, d: C.conformance_defaults(instances(s, d)), """SELECT InputPath, ifnull(Laterality, '') AS Laterality, ifnull(InstanceNumber, '1') AS InstanceNumber, ifnull(PatientOrientation, '') AS PatientOrientation,
  ifnull(ImageType, 'ORIGINAL' || chr(92) || 'PRIMARY' || chr(92) || 'IMAGE') AS ImageType, CASE WHEN NumberOfFrames > 1 THEN ifnull(FrameTime, 0.1) END AS FrameTime,
  CASE WHEN NumberOfFrames > 1 THEN ifnull(FrameIncrementPointer, '00181063') END AS FrameIncrementPointer, CASE WHEN SamplesPerPixel = 3 THEN ifnull(PlanarConfiguration, 0) END AS PlanarConfiguration FROM v_instance""")
R.add("series_description", lambda s, d: instances(s, d).groupBy("SeriesInstanceUID").agg(F.array_join(F.array_sort(F.collect_set("Manufacturer")), " ").alias("description")), "SELECT SeriesInstanceUID, string_agg(DISTINCT Manufacturer, ' ' ORDER BY Manufacturer) AS description FROM v_instance GROUP BY 1")
FLAT = """flat AS (SELECT InputPath, '0' AS at, 'Patient ID' AS key, PatientID AS value FROM v_instance
  UNION ALL SELECT InputPath, '1', 'Patient''s Name', 'Doe^' || PatientID FROM v_instance UNION ALL SELECT InputPath, '2', 'Patient''s Birth Date', PatientBirthDate FROM v_instance
  UNION ALL SELECT InputPath, '3', 'Modality', Modality FROM v_instance UNION ALL SELECT InputPath, '4.0.0', 'Region', '1' FROM v_instance UNION ALL SELECT InputPath, '4.0.1', 'Modality', Modality FROM v_instance
  UNION ALL SELECT InputPath, '4.1.0', 'Region', '2' FROM v_instance WHERE NumberOfFrames IS NOT NULL UNION ALL SELECT InputPath, '4.1.1.0.0', 'Manufacturer', 'inner ' || Manufacturer FROM v_instance WHERE NumberOfFrames IS NOT NULL
  UNION ALL SELECT InputPath, '5', 'Manufacturer', Manufacturer FROM v_instance UNION ALL SELECT InputPath, '7', 'Transducer Data', TransducerData FROM v_instance WHERE TransducerData IS NOT NULL)"""
R.add("flatten_header", lambda s, d: C.flatten_header(headers(s, d)).withColumn("at", F.concat_ws(".", F.col("at").cast("array<string>"))), f"WITH {FLAT} SELECT * FROM flat")
R.add("find_key", lambda s, d: C.find_keys(headers(s, d), {"found": "Manufacturer", "transducer": "Transducer Data"}), "SELECT DISTINCT InputPath, CASE WHEN NumberOfFrames IS NULL THEN Manufacturer ELSE 'inner ' || Manufacturer END AS found, coalesce(TransducerData, 'N/A') AS transducer FROM v_instance")
R.add("extract_rater_from_path", lambda s, d: instances(s, d).select("InputPath", F.lower(F.regexp_extract("InputPath", "([^/]+)/[^/]+/[^/]+$", 1)).alias("rater")), "SELECT InputPath, lower(split_part(InputPath, '/', -3)) AS rater FROM v_instance")
R.add("resume_pending", lambda s, d: C.resume_pending(*_with_outputs(s, d)).select("InputPath", "AnonFilename"), f"WITH {CAT}, {OUTPUTS} SELECT InputPath, AnonFilename FROM cat WHERE AnonFilename NOT IN (SELECT AnonFilename FROM outs)")
R.add("resume_position", lambda s, d: C.resume_position(*_with_outputs(s, d)).select("PatientUID", F.col("position").cast("long").alias("position")), f"WITH {CAT}, {OUTPUTS}, g AS (SELECT PatientUID, min(InputPath) AS p FROM cat WHERE AnonFilename NOT IN (SELECT AnonFilename FROM outs) GROUP BY 1) SELECT c.PatientUID, CASE WHEN any_value(p) IS NOT NULL THEN CAST(count(*) FILTER (InputPath < p) AS BIGINT) END AS position FROM cat c LEFT JOIN g ON c.PatientUID = g.PatientUID GROUP BY 1")
R.add("lookup_instance", lambda s, d: C.lookup_instance(C.series_number(_cat(s, d))), f"WITH {CAT} SELECT InstanceUID, InputPath AS path, CAST({SERIES} AS VARCHAR) AS series FROM cat a WHERE InputPath = (SELECT min(InputPath) FROM cat b WHERE b.InstanceUID = a.InstanceUID)")
R.add("asof_transducer_mask", lambda s, d: C.asof_transducer_mask(_saved(s, d), F.col("seq.ContentDate")).select("InputPath", "model", "mask_before"),
      f"WITH {CAT}, k AS (SELECT InputPath, TransducerModel AS model, ContentDate || ContentTime || InputPath AS seq, CASE WHEN ContentTime >= '120000' THEN AnonFilename END AS mask FROM cat), m AS (SELECT * FROM k WHERE mask IS NOT NULL) SELECT k.InputPath, k.model, m.mask AS mask_before FROM k ASOF LEFT JOIN m ON k.model = m.model AND k.seq > m.seq")
R.add("count_instances", lambda s, d: _cat(s, d).agg(F.count("*").alias("instances")), f"SELECT count(*) AS instances FROM v_instance WHERE {EXT} AND Modality = 'US' AND {IDS}")
R.add("run_summary", lambda s, d: C.run_summary(_results(s, d), "PatientID"), "SELECT PatientID, count(*) FILTER (Modality <> 'CT' AND SOPInstanceUID <> '') AS success, count(*) FILTER (Modality = 'CT') AS skipped, count(*) FILTER (Modality = 'US' AND SOPInstanceUID = '') AS failed, coalesce(string_agg('no instance: ' || InputPath, ';' ORDER BY InputPath) FILTER (Modality = 'US' AND SOPInstanceUID = ''), '') AS errors FROM v_instance GROUP BY 1")
R.add("directory_summary", lambda s, d: C.directory_summary(instances(s, d)), f"SELECT regexp_replace(InputPath, '/[^/]*$', '') AS folder, count(*) AS files, count(*) FILTER (SOPInstanceUID = '') = 0 AS ok FROM v_instance WHERE {EXT} GROUP BY 1")
R.add("series_number", lambda s, d: C.series_number(_cat(s, d)).select("InputPath", F.col("SeriesNumber").cast("long").alias("n")), f"WITH {CAT} SELECT InputPath, CAST({SERIES} AS BIGINT) AS n FROM cat a")
R.add("fill_spacing", lambda s, d: C.fill_spacing(_cat(s, d)).select("InputPath", "PhysicalDeltaX", "PhysicalDeltaY"), f"WITH {CAT} SELECT InputPath, PhysicalDeltaX, PhysicalDeltaY FROM {FILLED}")
R.add("hash_id", lambda s, d: instances(s, d).select("InputPath", H.hash_id(F.col("PatientID"), 10).alias("patient"), H.hash_id(F.col("SOPInstanceUID"), 8).alias("instance")), f"SELECT InputPath, {IDHASH('PatientID', 10)} AS patient, CASE WHEN SOPInstanceUID = '' THEN '' ELSE {IDHASH('SOPInstanceUID', 8)} END AS instance FROM v_instance")
R.add("anon_filename", lambda s, d: instances(s, d).select("InputPath", H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID")).alias("name"), H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID"), False).alias("plain")), f"SELECT InputPath, CASE WHEN SOPInstanceUID = '' THEN '' ELSE {NAME} END AS name, CASE WHEN SOPInstanceUID = '' THEN '' ELSE repeat('0', 10 - length(PatientID)) || PatientID || '_' || {IDHASH('SOPInstanceUID', 8)} || '.dcm' END AS plain FROM v_instance")
R.add("new_patient_identity", lambda s, d: C.blank_phi(instances(s, d)).select("InputPath", "PatientName", "PatientID"), f"SELECT InputPath, CASE WHEN SOPInstanceUID = '' THEN '' ELSE split_part({NAME}, '.', 1) END AS PatientName, CASE WHEN SOPInstanceUID = '' THEN '' ELSE {IDHASH('PatientID', 10)} END AS PatientID FROM v_instance")
OFF = HASH.format("'date-offset|' || PatientID", 31)
SHIFT = "CASE WHEN {0} SIMILAR TO '[0-9]{{8}}' THEN strftime(strptime({0}, '%Y%m%d') + INTERVAL 1 DAY * o, '%Y%m%d') ELSE {0} END AS {0}"
R.add("shift_dates", lambda s, d: C.shift_dates(instances(s, d)), f"SELECT InputPath, CAST(o AS INT) AS \"offset\", {SHIFT.format('StudyDate')}, {SHIFT.format('SeriesDate')}, {SHIFT.format('ContentDate')}, ContentTime FROM (SELECT * REPLACE (coalesce(SeriesDate, '19000101') AS SeriesDate), {OFF} AS o FROM v_instance)")
R.add("cap_age", lambda s, d: instances(s, d).select("InputPath", H.cap_age(F.col("PatientAge")).alias("age"), H.age_well_formed(F.col("PatientAge")).alias("ok")), "SELECT InputPath, CASE WHEN PatientAge LIKE '%Y' AND PatientAge >= '090' THEN '090Y' ELSE PatientAge END AS age, true AS ok FROM v_instance")
R.add("blank_phi", lambda s, d: C.blank_phi(instances(s, d)), f"SELECT InputPath, CASE WHEN SOPInstanceUID = '' THEN '' ELSE split_part({NAME}, '.', 1) END AS PatientName, CASE WHEN SOPInstanceUID = '' THEN '' ELSE {IDHASH('PatientID', 10)} END AS PatientID, '' AS PatientBirthDate, '' AS ReferringPhysicianName, '' AS AccessionNumber FROM v_instance")
R.add("light_header", lambda s, d: C.light_header(instances(s, d)), f"SELECT InputPath, CASE WHEN SOPInstanceUID = '' THEN '' ELSE split_part({NAME}, '.', 1) END AS PatientName, substr(PatientBirthDate, 1, 4) || '0101' AS PatientBirthDate FROM v_instance")
R.add("camel_to_snake", lambda s, d: instances(s, d).select("InputPath", H.camel_to_snake(F.concat(F.initcap("ManufacturerModelName"), F.lit("DeltaX"), F.col("Modality"))).alias("snake")), r"SELECT InputPath, lower(regexp_replace(list_aggregate(list_transform(string_split(ManufacturerModelName, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') || 'DeltaX' || Modality, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake FROM v_instance")
R.add("humanize", lambda s, d: table(s, d, "part").select("p_partkey", H.humanize(F.concat(F.lit("USScan"), F.regexp_replace(F.initcap("p_name"), " ", ""), "p_size")).alias("words")), r"SELECT p_partkey, trim(regexp_replace(regexp_replace('USScan' || list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') || p_size, '([A-Z][a-z0-9]+)', ' \1 ', 'g'), ' +', ' ', 'g')) AS words FROM part")
R.add("sort_catalogue", lambda s, d: _cat(s, d).select("InputPath", "ContentDate", "ContentTime").orderBy("InputPath", "ContentDate", "ContentTime"), f"WITH {CAT} SELECT InputPath, ContentDate, ContentTime FROM cat ORDER BY ALL")
R.add("reunite_dicom", lambda s, d: C.reunite_dicom(_paths(s, d).where("path NOT LIKE '%Header.json'"), instances(s, d).select(F.col("InputPath").alias("path"))), f"WITH f AS (SELECT {JSON_PATH} AS json FROM v_instance WHERE Modality <> 'CT'), g AS (SELECT InputPath AS dcm FROM v_instance WHERE InputPath LIKE '%.dcm') SELECT json, dcm FROM f JOIN g ON replace(json, '.json', '.dcm') = dcm")
R.add("join_ground_truth", lambda s, d: _cat(s, d).select("InputPath", F.concat(H.stem(H.base_name(F.col("InputPath"))), F.lit(".json")).alias("name")).join(C.index_ground_truth(_paths(s, d)), "name", "left").select("InputPath", "path"), f"WITH {CAT}, f AS (SELECT {JSON_PATH} AS path FROM v_instance WHERE Modality <> 'CT'), g AS (SELECT {BASE.format('path')} AS name, min(path) AS path FROM f GROUP BY 1) SELECT InputPath, g.path FROM cat LEFT JOIN g ON g.name = regexp_replace({BASE.format('InputPath')}, '[.][^.]*$', '.json')")
