"""Header files from a folder to the key table, and array exports that come whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sonoloom.operators import catalogue as C
from sonoloom.sources import arrays, files, headers

HEAD = {"PatientID": "P1", "StudyInstanceUID": "1.1", "SeriesInstanceUID": "1.1.1", "SOPInstanceUID": "1.1.1.1", "Modality": "US", "NumberOfFrames": 3, "ImageType": ["A", "B"], "Unknown": [1], "PixelData": "AA"}
NAMED = {"Patient ID": "P2", "Study Instance UID": "2.1", "Series Instance UID": "2.1.1", "SOP Instance UID": "2.1.1.1", "Modality": "US", "Patient's Birth Date": "19800229", "Manufacturer's Model Name": "m", "Sequence of Ultrasound Regions": [{"Physical Delta X": "0.25", "Physical Delta Y": 0.5}, {"Physical Delta X": 9}]}


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text))

    put("a/one.json", HEAD)
    put("a/two.dicom.json", NAMED)
    put("b/three_DICOMHeader.json", HEAD | {"SOPInstanceUID": "1.1.1.2", "Modality": "CT"})
    put("b/bad.json", "{")
    put("b/list.json", "[]")
    put("b/count.json", HEAD | {"NumberOfFrames": "many"})
    put("b/._fork.json", "{")
    put("b/notes.txt", "x")
    return tmp_path / "in"


def test_headers_from_folder_to_keys(spark, folder, tmp_path):
    rows = {os.path.basename(r.InputPath): r for r in headers.read_headers(spark, str(folder)).collect()}
    assert set(rows) == {"one.dcm", "two.dicom", "three.dcm", "bad.dcm", "list.dcm", "count.dcm"}
    assert {n for n, r in rows.items() if r.error} == {"bad.dcm", "list.dcm", "count.dcm"}
    two = rows["two.dicom"]
    assert (two.PatientBirthDate, two.ManufacturerModelName, two.PhysicalDeltaX, two.PhysicalDeltaY, two.error) == ("19800229", "m", 0.25, 0.5, None)
    assert rows["one.dcm"].ImageType == "A\\B" and rows["one.dcm"].NumberOfFrames == 3 and json.loads(rows["one.dcm"].json) == {k: v for k, v in HEAD.items() if k != "PixelData"}
    found = headers.read_headers(spark, str(folder))
    assert headers.header_errors(found).count() == 3
    keys = C.write_keys(C.catalogue(found), str(folder))
    files.write_table(keys, str(tmp_path / "keys"))
    back = {r.InputPath: r for r in spark.read.option("header", "true").csv(str(tmp_path / "keys")).collect()}
    assert set(back) == {"a/one.dcm", "a/two.dicom"} and back["a/one.dcm"].AnonFilename.endswith(".dcm") and back["a/two.dicom"].PhysicalDeltaX == "0.25"
    for operator in (C.tag_allowlist, C.conformance_defaults, C.shift_dates, C.uid_passthrough, C.blank_phi, C.light_header):
        assert operator(found.where("error IS NULL")).count() == 3
    assert {r.key for r in C.flatten_header(found.where("PatientID = 'P2'")).collect()} >= {"PatientID", "PhysicalDeltaX"}


def test_partitions_follow_bytes_and_files(folder):
    size = lambda **o: [len(p.paths) for p in headers.HeaderReader({"path": str(folder), **o}).partitions()]
    assert size() == [6] and size(partitionfiles="4") == [4, 2] and size(partitionbytes="1") == [1] * 6
    assert headers.HeaderReader({"path": f"file://{folder}/a/one.json"}).partitions()[0].paths == [f"{folder}/a/one.json"]


def test_headers_on_lines(spark, tmp_path):
    (tmp_path / "part-0.txt").write_text("\n".join(json.dumps(HEAD | {"InputPath": f"/in/{i}.dcm"}) for i in range(2500)) + "\n{")
    found = headers.read_headers(spark, str(tmp_path), lines=True)
    assert found.where("error IS NULL").select("InputPath").distinct().count() == 2500 and headers.header_errors(found).count() == 1


def whole(spark, fail=False):
    row = spark.range(40).select((F.col("id") % 4).alias("clip_id"), F.floor(F.col("id") / 4).alias("frame_no"), F.array(F.col("id").cast("int")).alias("pixels"), F.array(F.lit(1.0)).alias("m"), F.array(F.col("id") * 0.5).alias("slice"), F.array(F.lit(0)).alias("labelmap"), (F.col("id") % 3 == 0).alias("captured"))
    late = F.when(F.lit(fail) & (F.col("clip_id") == 3) & (F.col("frame_no") == 9), F.raise_error(F.lit("late"))).otherwise(F.col("captured"))
    return row.repartition(4, "clip_id").withColumn("captured", late.cast("boolean"))


def test_export_is_aligned_and_whole_or_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(Exception, match="late"):
        arrays.export_arrays(whole(spark, fail=True), path)
    assert [f for _, _, names in os.walk(path) for f in names] == []
    with pytest.raises(FileNotFoundError):
        arrays.read_export(spark, path)
    arrays.export_arrays(whole(spark), path)
    got = arrays.read_export(spark, path)
    assert set(got) == set(arrays.OUTPUTS) and all(df.count() == 40 for df in got.values())
    orders = []
    for name in arrays.OUTPUTS:  # files of a name hold the same frames in the same order
        orders.append({f: [tuple(r) for r in spark.read.parquet(f"{path}/{name}/{f}").select("clip_id", "frame_no").collect()] for f in sorted(os.listdir(f"{path}/{name}")) if not f.startswith(".")})
    assert all(o == orders[0] for o in orders)
    assert {r.frame_no: r.slice for r in got["secondary"].where("clip_id = 1").collect()}[2] == [4.5]
    assert json.loads(open(f"{path}/_export.json").read())["rows"] == 40 and not [d for d in os.listdir(path) if d.startswith("_staging")]
    with pytest.raises(Exception, match="holds an export"):
        arrays.export_arrays(whole(spark), path)
    arrays.export_arrays(whole(spark).where("clip_id = 0"), path, overwrite=True)
    assert arrays.read_export(spark, path)["frames"].count() == 10
    with pytest.raises(Exception, match="columns are missing"):
        arrays.export_arrays(whole(spark).drop("m"), str(tmp_path / "other"))
