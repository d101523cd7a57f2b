"""Catalogue of header records: scans, filters, numbering, de-identification and the tables built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sonoloom.functions import headers as H

#: Tags that pass de-identification where present, and those written in any case, blank when missing.
COPIED = ("BitsAllocated", "BitsStored", "HighBit", "PatientAge", "PatientSex", "PixelRepresentation", "SeriesNumber", "StationName", "StudyDate", "StudyDescription", "StudyTime", "Manufacturer")
ALWAYS = ("TransducerData", "TransducerType", "ManufacturerModelName")
UIDS = ("SOPClassUID", "SOPInstanceUID", "SeriesInstanceUID", "StudyInstanceUID")
#: Conformance defaults; the pointer is the tag of the frame time.
IMAGE_TYPE, FRAME_TIME, FRAME_TIME_TAG = "ORIGINAL\\PRIMARY\\IMAGE", 0.1, "00181063"
NAME, BIRTH_DATE, PIXELS = "Patient's Name", "Patient's Birth Date", "Pixel Data"
REQUIRED = ("PatientID", "StudyInstanceUID", "SeriesInstanceUID", "SOPInstanceUID")


def is_dicom(path):
    return F.lower(H.base_name(path)).rlike(r"\.(dcm|dicom)$")


def filter_modality(df: DataFrame, modality: str = "US") -> DataFrame:
    return df.where(F.col("Modality") == modality)


def filter_multiframe(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("NumberOfFrames", F.lit(0)) >= 2)


def filter_required_ids(df: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for c in REQUIRED:
        keep = keep & ~H.blank(F.col(c))
    return df.where(keep)


def scan(df: DataFrame, hashed: bool = True) -> DataFrame:
    """Catalogue rows of the header records that are DICOM files, ultrasound, and fully identified."""
    kept = filter_required_ids(filter_modality(df.where(is_dicom(F.col("InputPath")))))
    return kept.select(
        "InputPath", H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID"), hashed).alias("AnonFilename"),
        F.col("PatientID").alias("PatientUID"), F.col("StudyInstanceUID").alias("StudyUID"), F.col("SeriesInstanceUID").alias("SeriesUID"), F.col("SOPInstanceUID").alias("InstanceUID"),
        "PhysicalDeltaX", "PhysicalDeltaY", F.coalesce("ContentDate", F.lit(H.DEFAULT_DATE)).alias("ContentDate"), F.coalesce("ContentTime", F.lit("000000")).alias("ContentTime"),
        patch_flag().alias("Patch"), H.transducer_model(F.col("TransducerData"), F.col("Manufacturer"), F.col("ManufacturerModelName")).alias("TransducerModel"),
    )


def extract_spacing(df: DataFrame) -> DataFrame:
    """Deltas of the first of a header's ``regions``, null where there is none."""
    first = F.try_element_at("regions", F.lit(1))
    return df.select("*", first["PhysicalDeltaX"].alias("dx"), first["PhysicalDeltaY"].alias("dy"))


def patch_flag():
    return F.col("PhysicalDeltaX").isNull() | F.col("PhysicalDeltaY").isNull()


def series_number(cat: DataFrame) -> DataFrame:
    """1, 2, ... inside a patient's study, by path, date and time."""
    order = W.partitionBy("PatientUID", "StudyUID").orderBy("InputPath", "ContentDate", "ContentTime")
    return cat.withColumn("SeriesNumber", F.row_number().over(order))


def fill_spacing(cat: DataFrame) -> DataFrame:
    """Missing spacing from the nearest earlier row of the study, else the nearest later one."""
    order = W.partitionBy("StudyUID").orderBy("InputPath", "ContentDate", "ContentTime")
    back, ahead = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)) for c in ("PhysicalDeltaX", "PhysicalDeltaY")}
    return cat.withColumns(filled)


def catalogue(df: DataFrame) -> DataFrame:
    """Scan, number and fill: the table every later step starts from."""
    return fill_spacing(series_number(scan(df)))


def write_keys(cat: DataFrame, root: str) -> DataFrame:
    """The mapping of original to anonymised files, paths below ``root``."""
    return cat.withColumn("InputPath", H.relative_path(F.col("InputPath"), root))


def first_by_basename(df: DataFrame) -> DataFrame:
    base = H.base_name(F.col("InputPath"))
    ranked = df.where(F.lower(base).endswith(".dcm")).select(base.alias("base"), "InputPath").withColumn("rn", F.row_number().over(W.partitionBy("base").orderBy("InputPath")))
    return ranked.where("rn = 1").drop("rn")


def index_ground_truth(files: DataFrame) -> DataFrame:
    """First path of each JSON name but header dumps, with the number of further paths of that name."""
    named = files.select(H.base_name(F.col("path")).alias("name"), "path").where(F.lower("name").endswith(".json") & ~F.lower("name").endswith("_dicomheader.json"))
    return named.groupBy("name").agg(F.min("path").alias("path"), (F.count("*") - 1).alias("duplicates"))


def collect_files(files: DataFrame) -> DataFrame:
    """A tree flattened by base name: the last path in order stays."""
    return files.select(H.base_name(F.col("path")).alias("name"), "path").where(F.lower("name").rlike(r"\.(dcm|json)$")).groupBy("name").agg(F.max("path").alias("path"))


def reunite_dicom(documents: DataFrame, files: DataFrame) -> DataFrame:
    """(json, dcm): the DICOM files of each document (``path`` in both) by folder and the name before its first dot."""
    named = lambda df, out: df.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.substring_index(H.base_name(F.col("path")), ".", 1).alias("prefix"), F.col("path").alias(out))
    dicom = files.where(F.endswith("path", F.lit(".dcm")))
    return named(documents, "json").join(named(dicom, "dcm"), ["folder", "prefix"]).select("json", "dcm")


def tag_allowlist(df: DataFrame) -> DataFrame:
    """The tags that may pass: copied ones stay null where missing, the others become blank."""
    return df.select("InputPath", *COPIED, *(F.coalesce(c, F.lit("")).alias(c) for c in ALWAYS))


def uid_passthrough(df: DataFrame) -> DataFrame:
    """UIDs as they are; a missing one becomes a number derived from the path and the UID's name."""
    made = lambda c: H.hash_uid(F.concat(F.lit(f"{c}|"), F.col("InputPath")))
    return df.select("InputPath", *(F.when(H.blank(F.col(c)), made(c)).otherwise(F.col(c)).alias(c) for c in UIDS))


def conformance_defaults(df: DataFrame) -> DataFrame:
    """Required attributes: what is present stays; frame time and pointer for several frames only, planar configuration for colour only."""
    many, colour = F.coalesce("NumberOfFrames", F.lit(1)) > 1, F.col("SamplesPerPixel") == 3
    given = lambda c, default: F.coalesce(c, F.lit(default))
    return df.select(
        "InputPath", given("Laterality", "").alias("Laterality"), given("InstanceNumber", "1").alias("InstanceNumber"), given("PatientOrientation", "").alias("PatientOrientation"), given("ImageType", IMAGE_TYPE).alias("ImageType"),
        F.when(many, given("FrameTime", FRAME_TIME)).alias("FrameTime"), F.when(many, given("FrameIncrementPointer", FRAME_TIME_TAG)).alias("FrameIncrementPointer"),
        F.when(colour, given("PlanarConfiguration", 0)).alias("PlanarConfiguration"),
    )


def shift_dates(df: DataFrame) -> DataFrame:
    """Study, series and content dates moved by one offset per patient; times stay."""
    offset = H.date_offset(F.col("PatientID"))
    return df.select("InputPath", offset.alias("offset"), *(H.shift_date(F.col(c), offset).alias(c) for c in ("StudyDate", "SeriesDate", "ContentDate")), "ContentTime")


def blank_phi(df: DataFrame) -> DataFrame:
    """New identity from the anonymised name; direct identifiers blank."""
    name = H.stem(H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID")))
    return df.select("InputPath", name.alias("PatientName"), F.substring_index(name, "_", 1).alias("PatientID"), *(F.lit("").alias(c) for c in ("PatientBirthDate", "ReferringPhysicianName", "AccessionNumber")))


def light_header(df: DataFrame) -> DataFrame:
    name = H.stem(H.anon_filename(F.col("PatientID"), F.col("SOPInstanceUID")))
    return df.select("InputPath", name.alias("PatientName"), F.concat(F.substring("PatientBirthDate", 1, 4), F.lit("0101")).alias("PatientBirthDate"))


def resume_pending(cat: DataFrame, outputs: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows without an output file of their name; with ``overwrite`` all rows."""
    return cat if overwrite else cat.join(outputs.select(F.col("name").alias("AnonFilename")).distinct(), "AnonFilename", "left_anti")


def resume_position(cat: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per patient: outputs present before the first gap in path order; null when all are."""
    done = cat.join(outputs.select(F.col("name").alias("AnonFilename"), F.lit(True).alias("done")).distinct(), "AnonFilename", "left")
    ranked = done.withColumn("rn", F.row_number().over(W.partitionBy("PatientUID").orderBy("InputPath")))
    return ranked.groupBy("PatientUID").agg((F.min(F.when(F.col("done").isNull(), F.col("rn"))) - 1).alias("position"))


def lookup_instance(cat: DataFrame) -> DataFrame:
    """First path and series number of each instance UID; number '1' where none is known."""
    return cat.groupBy("InstanceUID").agg(F.min("InputPath").alias("path"), F.coalesce(F.min_by("SeriesNumber", "InputPath").cast("string"), F.lit("1")).alias("series"))


def asof_transducer_mask(saved: DataFrame, coarse: Column) -> DataFrame:
    """Each row's model with the mask saved last before it for that model.

    ``coarse`` never falls as ``seq`` rises, such as its date. A model's rows are ordered inside one value of it; across
    values only each one's last mask is carried on, as a row before its first, so no task holds a model and no row is joined.
    """
    ranged = saved.withColumn("_range", coarse)
    last = ranged.groupBy("model", "_range").agg(F.max_by("mask", F.when(F.col("mask").isNotNull(), F.col("seq"))).alias("_last"))
    before = W.partitionBy("model").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("model", "_range", F.last("_last", ignorenulls=True).over(before).alias("mask"), F.lit(True).alias("_head")).where("mask IS NOT NULL")
    inside = W.partitionBy("model", "_range").orderBy(F.desc("_head"), "seq").rowsBetween(W.unboundedPreceding, -1)
    rows = ranged.withColumn("_head", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return rows.withColumn("mask_before", F.last("mask", ignorenulls=True).over(inside)).where(~F.col("_head")).select(*saved.columns, "mask_before")


def run_summary(results: DataFrame, by: str) -> DataFrame:
    """Counts and the errors in order, for each ``by``."""
    return results.groupBy(by).agg(
        F.count_if(F.col("error").isNull() & ~F.col("skipped")).alias("success"), F.count_if("skipped").alias("skipped"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.array_join(F.array_sort(F.collect_list("error")), ";").alias("errors"),
    )


def directory_summary(df: DataFrame) -> DataFrame:
    """DICOM files of each folder, and whether all of them are fully identified; folders without any are left out."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & ~H.blank(F.col(c))
    folder = F.regexp_replace("InputPath", "/[^/]*$", "")
    return df.where(is_dicom(F.col("InputPath"))).groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.bool_and(ok).alias("ok"))


def _nested(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\[\s*\{"), F.lit(False))


def _opened(level: Column) -> Column:
    """The elements inside the sequences of ``level``, one level down."""
    items = lambda e: F.flatten(F.transform(F.from_json(e["value"], "array<string>"), lambda text, i: F.coalesce(_elements(text, F.array_append(e["at"], i)), F.filter(level, lambda _: F.lit(False)))))
    return F.flatten(F.transform(F.filter(level, lambda e: _nested(e["value"])), items))


def _elements(text: Column, above: Column) -> Column:
    listed = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e, i: F.struct(F.array_append(above, i).alias("at"), e["key"].alias("key"), e["value"].alias("value")))
    return F.filter(listed, lambda e: e["key"] != PIXELS)


def elements_of(header: Column, depth: int = 4) -> Column:
    """array(struct(at, key, value)): the elements of a nested header, pixel data left out; see ``flatten_header``."""

    def whole(level: Column, left: int) -> Column:
        if not left:
            return level
        below = F.transform(F.array(_opened(level)), lambda next_level: whole(next_level, left - 1))[0]  # bound once
        return F.when(F.exists(level, lambda e: _nested(e["value"])), F.flatten(F.array(F.filter(level, lambda e: ~_nested(e["value"])), below))).otherwise(level)

    return F.transform(F.array(_elements(header, F.array().cast("array<int>"))), lambda level: whole(level, depth - 1))[0]


def all_elements_of(header: Column) -> Column:
    """``elements_of`` to the last level: what is still a sequence after the usual levels is opened level by level, as often as its text can be nested.

    A sequence inside another begins with a bracket, or with an escape where it is inside a string, so their number bounds the levels.
    """

    def rest(found: Column) -> Column:
        levels = F.array_max(F.transform(F.filter(found, lambda e: _nested(e["value"])), lambda e: F.regexp_count(e["value"], F.lit(r"\[|\\u"))))
        deeper = lambda level, _: F.when(F.exists(level, lambda e: _nested(e["value"])), F.flatten(F.array(F.filter(level, lambda e: ~_nested(e["value"])), _opened(level)))).otherwise(level)
        return F.when(F.exists(found, lambda e: _nested(e["value"])), F.aggregate(F.sequence(F.lit(1), levels), found, deeper)).otherwise(found)

    return F.transform(F.array(elements_of(header)), rest)[0]


def flatten_header(df: DataFrame, depth: int = 4) -> DataFrame:
    """(InputPath, at, key, value): the elements of a nested header ``json``, pixel data left out.

    ``at`` gives the place on each level, an item's place in its sequence between; its order is depth first. Items of
    sequences are opened ``depth`` levels deep, all inside the row, so that the source is read once and each text parsed once; an element below that keeps its text.
    """
    return df.select("InputPath", F.inline(elements_of(F.col("json"), depth)))


def find_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """First value of each key in each header ``json``, depth first, at any depth, N/A where there is none; ``keys`` is by column.

    A header is searched inside its row, and only what was found is shuffled: one row for each header, not one for each element. A text with
    brackets over 1,000 deep, so 500 levels of sequences, is none that Spark's JSON reader reads, as one that is cut off.
    """
    first = lambda found, key: F.array_min(F.transform(F.filter(found, lambda e: e["key"] == key), lambda e: F.struct(e["at"].alias("at"), e["value"].alias("value"))))
    seen = df.select("InputPath", F.inline(F.transform(F.array(all_elements_of(F.col("json"))), lambda found: F.struct(*(first(found, key).alias(column) for column, key in keys.items())))))
    return seen.groupBy("InputPath").agg(*(F.coalesce(F.min(column)["value"], F.lit("N/A")).alias(column) for column in keys))


def find_key(df: DataFrame, key: str) -> DataFrame:
    return find_keys(df, {"found": key})


def header_json(df: DataFrame, stem: Column) -> DataFrame:
    """(InputPath, json): the header as it is, but for the pixel data, the name (``stem``) and the birth date (its year)."""
    given = F.from_json("json", "map<string,string>")
    changed = F.transform_values(F.map_filter(given, lambda k, v: k != PIXELS), lambda k, v: F.when(k == NAME, stem).when(k == BIRTH_DATE, F.concat(F.substring(v, 1, 4), F.lit("0101"))).otherwise(v))
    nested = lambda v: v.rlike(r"^\[\s*\{")
    text = F.transform(F.map_entries(changed), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.when(nested(e["value"]), e["value"]).otherwise(_quoted(e["value"]))))
    return df.select("InputPath", F.concat(F.lit("{"), F.array_join(text, ","), F.lit("}")).alias("json"))


def _quoted(c: Column) -> Column:
    """A JSON string literal; most texts have nothing to escape."""
    return F.when(~c.rlike(r'["\\\x00-\x1f]'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1))
