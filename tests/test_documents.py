"""Annotation documents in the form of files: a folder read, written, checked and read again; the older form converted."""

import json

import pytest
from pyspark.sql import functions as F

from sonoloom.operators import annotations as A, documents as D
from sonoloom.sources import files

LINE = {"rater": "Ann ", "line": {"points": [[1.5, 2, 3], [4, 5.25, 6]]}, "validation": {"status": "validated", "adjudicator": "z", "timestamp": "2024-01-02T03:04:05"}, "color": "red", "deep": {"a": [1, None]}}
OTHER = {"rater": "bob", "line": {"points": [[-1, -2, 0], [7, 8, 9]]}}
DOC = {
    "SOPInstanceUID": "1.2.3", "GrayscaleConversion": False, "radius1": 7, "labels": ["x/y"], "note": {"kept": [1, 2.5]},
    "frame_annotations": [
        {"frame_number": 12, "coordinate_space": "LPS", "pleura_lines": [LINE, OTHER], "b_lines": []},
        {"frame_number": "3", "pleura_lines": [], "b_lines": [OTHER]},
    ],
}


@pytest.fixture
def folder(tmp_path):
    def put(name, text):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text, indent=1))

    put("a/1/clip.json", DOC)
    put("a/1/._clip.json", "{")
    put("a/2/cut.json", json.dumps(DOC)[:-9])
    put("a/2/list.json", "[1]")
    put("a/3/none.json", {"SOPInstanceUID": "1"})
    put("a/3/numberless.json", {"frame_annotations": [{"pleura_lines": []}]})
    put("a/4/pointless.json", {"frame_annotations": [{"frame_number": 1, "b_lines": [{"rater": "a", "line": {}}]}]})
    put("a/5/empty.json", {"SOPInstanceUID": "9", "frame_annotations": []})
    return tmp_path / "in"


def test_folder_of_files_comes_back_as_it_was(spark, folder, tmp_path):
    docs = files.read_texts(spark, str(folder)).withColumn("name", F.substring_index("path", "/", -1)).drop("path")
    heads, lines, errors = D.read_documents(docs)
    assert {r["name"]: r["message"] for r in errors.collect()} == {"cut.json": "not a JSON object", "list.json": "not a JSON object", "none.json": "no list of frames", "numberless.json": "a frame without number", "pointless.json": "a line without points"}
    rows = {(r["frame_key"], r["kind"], r["line_ord"]): r for r in lines.collect()}
    assert set(rows) == {("12", "pleura", 0), ("12", "pleura", 1), ("3", "b", 0)}
    first = rows["12", "pleura", 0]
    assert first["points"] == [[-1.5, -2.0, 3.0], [-4.0, -5.25, 6.0]] and (first["x1"], first["y2"], first["frame_number"]) == (-1.5, -5.25, 12)  # LPS to RAS
    assert first["validation"].status == "validated" and json.loads(first["extra"]) == {"color": "red", "deep": {"a": [1, None]}}
    assert rows["3", "b", 0]["points"] == [[-1.0, -2.0, 0.0], [7.0, 8.0, 9.0]]  # no tag: RAS
    assert rows["3", "b", 0]["validation"] is None

    written = D.write_documents(lines, ["name"], heads, keep_empty=True)
    assert A.validate_documents(written).count() == 0
    files.write_documents(written.withColumn("rater", F.lit("all")), str(tmp_path / "out"))
    again = D.read_documents(spark.read.text(str(tmp_path / "out")).select(F.col("value").alias("json")).withColumn("name", F.when(F.col("json").contains('"1.2.3"'), "clip.json").otherwise("empty.json")))
    assert again.errors.count() == 0
    both = ["name", "frame_number", "frame_key", "kind", "line_ord", "rater", "points", "validation", "extra"]
    assert sorted(map(str, again.lines.select(both).collect())) == sorted(map(str, lines.select(both).collect()))
    assert sorted(map(str, again.heads.select("name", "labels", "head").collect())) == sorted(map(str, heads.select("name", "labels", "head").collect()))
    got = json.loads(written.where("name = 'clip.json'").first().json)
    assert [f["frame_number"] for f in got["frame_annotations"]] == [3, 12] and {f["coordinate_space"] for f in got["frame_annotations"]} == {"LPS"}
    assert got["note"] == DOC["note"] and got["labels"] == ["x/y"] and got["frame_annotations"][1]["pleura_lines"][0] == LINE | {"line": {"points": [[1.5, 2.0, 3.0], [4.0, 5.25, 6.0]]}}


def test_rater_and_adjudication_files(spark, folder):
    heads, lines, _ = D.read_documents(files.read_texts(spark, str(folder)).select(F.lit("clip").alias("clip"), "json").where(F.col("json").contains("1.2.3")))
    one = D.write_rater(lines, "clip", " ANN", heads).collect()
    assert [r["file"] for r in one] == ["clip.ann.json"]
    frames = json.loads(one[0]["json"])["frame_annotations"]
    assert len(frames) == 1 and [x["rater"] for x in frames[0]["pleura_lines"]] == ["Ann "] and frames[0]["b_lines"] == []
    assert D.write_rater(lines, "clip", "eve", heads).count() == 0
    assert json.loads(D.write_rater(lines, "clip", "eve", heads, changed=True).first().json)["frame_annotations"] == []
    whole = D.write_adjudication(lines, "clip", heads).first()
    assert whole["file"] == "clip.adjudication.json"
    entries = json.loads(whole["json"])["frame_annotations"][1]["pleura_lines"]
    assert entries[0]["validation"]["status"] == "validated" and "validation" not in entries[1]


def test_older_form(spark):
    bare = [[[1, 2, 0], [3, 4, 0]], [], [[5, 6, 7], [8, 9, 1]]]
    old = {"SOPInstanceUID": "7", "radius1": 2, "frame_annotations": {"10": {"pleura_lines": bare, "depth": 4}, "2": {"annotation": {"b_lines": bare[:1], "mark": "m"}}, " 5": {"b_lines": []}}}
    rows = [("/d/RaterX/s/c.json", json.dumps(old)), ("/d/Y/s/n.json", json.dumps(DOC)), ("/d/Y/s/k.json", json.dumps({"frame_annotations": {"one": {}}})), ("/d/Y/s/b.json", "{")]
    docs = spark.createDataFrame(rows, "path string, json string")
    heads, lines, errors = D.read_legacy(docs)
    assert {(r.path, r.message) for r in errors.collect()} == {("/d/Y/s/k.json", "a frame key that is no number"), ("/d/Y/s/b.json", "not a JSON object")}
    got = [(r.frame_key, r.frame_number, r.kind, r.line_ord, r.rater, r.x1, r.y2) for r in lines.orderBy("frame_at", "kind", "line_ord").collect()]
    assert got == [("2", 2, "b", 0, "raterx", 1.0, 4.0), ("10", 10, "pleura", 0, "raterx", 1.0, 4.0), ("10", 10, "pleura", 1, "raterx", 5.0, 9.0)]
    done, wrong = D.convert_legacy(docs)
    out = {r.file: json.loads(r.json) for r in done.collect()}
    assert set(out) == {"/d/RaterX/s/c.raterx.json", "/d/Y/s/n.y.json"} and wrong.count() == 2
    assert out["/d/Y/s/n.y.json"] == DOC
    frames = out["/d/RaterX/s/c.raterx.json"]["frame_annotations"]
    assert [f["frame_number"] for f in frames] == [2, " 5", 10] and frames[0]["mark"] == "m" and frames[2]["depth"] == 4
    assert frames[2]["pleura_lines"] == [{"rater": "raterx", "line": {"points": [[-1.0, -2.0, 0.0], [-3.0, -4.0, 0.0]]}}, {"rater": "raterx", "line": {"points": [[-5.0, -6.0, 7.0], [-8.0, -9.0, 1.0]]}}]
    assert A.validate_documents(done.select("path", "json")).count() == 0


def test_one_text_has_all_its_faults(spark):
    """Every place of a document in one pass: a fault of each kind, beside kinds that look alike."""
    frames = [{"frame_number": 1.5, "coordinate_space": 7, "pleura_lines": {}, "b_lines": [{"line": "x"}, 4, {"rater": 1, "line": {"points": 2}}]}, "frame", {"frame_number": None, "pleura_lines": [{"rater": "a", "line": {"points": [[1, "2", 3], [1], "p", [1, 2, None]]}}], "b_lines": None}]
    texts = {"all": json.dumps({"labels": ["a", 1], "radius1": None, "frame_annotations": frames}), "list": "[1]", "text": '"x"', "cut": "{", "none": None, "no list": '{"SOPInstanceUID": "1", "frame_annotations": {"1": []}}', "sound": json.dumps(DOC)}
    found = A.validate_documents(spark.createDataFrame(list(texts.items()), "name string, json string"))
    at = "frame_annotations"
    assert {(r["at"], r["message"]) for r in found.where("name = 'all'").collect()} == {
        ("", "SOPInstanceUID is required"), ("labels", "not of kind strings"), ("radius1", "not of kind integer"), (f"{at}/0/frame_number", "not of kind text or integer"), (f"{at}/0/coordinate_space", "not one of LPS, RAS"), (f"{at}/0/pleura_lines", "not of kind array"),
        (f"{at}/0/b_lines/0", "rater is required"), (f"{at}/0/b_lines/0/line", "not of kind object"), (f"{at}/0/b_lines/0/line", "points is required"), (f"{at}/0/b_lines/1", "rater is required"), (f"{at}/0/b_lines/1", "line is required"),
        (f"{at}/0/b_lines/2/rater", "not of kind string"), (f"{at}/0/b_lines/2/line/points", "not of kind array"), (f"{at}/1", "frame_number is required"), (f"{at}/1", "pleura_lines is required"), (f"{at}/1", "b_lines is required"),
        (f"{at}/2/frame_number", "not of kind text or integer"), (f"{at}/2/b_lines", "not of kind array"), (f"{at}/2/pleura_lines/0/line/points/0", "not of kind number"), (f"{at}/2/pleura_lines/0/line/points/1", "not 3 items"),
        (f"{at}/2/pleura_lines/0/line/points/2", "not 3 items"), (f"{at}/2/pleura_lines/0/line/points/3", "not of kind number"),
    }
    rest = sorted((r["name"], r["at"], r["message"]) for r in found.where("name <> 'all'").collect())
    assert rest == sorted([("cut", "", "not readable"), ("none", "", "not readable"), *((n, "", f"{k} is required") for n in ("list", "text") for k in ("SOPInstanceUID", "frame_annotations")), ("no list", at, "not of kind array")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tryParseJson") + plan.count("parseJson") + plan.count("parse_json") == 1, plan  # parsed once, whatever the number of checks


def parses(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("parseJson")


def test_a_text_is_parsed_once(spark):
    """Whatever is asked for: no filter and no later column repeats the parsing."""
    docs = spark.createDataFrame([("/d/Y/s/n.json", json.dumps(DOC))], "path string, json string")
    assert [parses(df) for df in D.read_documents(docs)] == [1, 1, 1]


def test_an_older_text_is_parsed_once(spark):
    docs = spark.createDataFrame([("/d/Y/s/n.json", json.dumps(DOC))], "path string, json string")
    assert [parses(df) for df in D.read_legacy(docs)] == [1, 1, 1]
    assert [parses(df) for df in D.convert_legacy(docs)] == [1, 1]


def test_rows_of_a_document_are_dealt_once(spark):
    lines = spark.range(40).selectExpr("id % 4 AS clip", "id AS line_ord", "int(id % 3) AS frame_number", "'a' AS rater", "'b' AS kind", "1D AS x1", "2D AS y1", "3D AS x2", "4D AS y2")
    plan = D.write_documents(lines, ["clip"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_sound_texts_are_known_by_their_form(spark):
    """What matches has no fault when it is parsed; what nearly matches is parsed."""
    point, line = "[-1.0,2,0.5E-3]", '{"rater":"a","line":{"points":[[-1.0,2,0.5E-3],[1,2,3]]}}'
    text = lambda frame, more="": f'{{"SOPInstanceUID":"1.2"{more},"frame_annotations":[{frame}]}}'
    frame = lambda lines, number="4", space="LPS", more="": f'{{"frame_number":{number},"coordinate_space":"{space}","pleura_lines":[{lines}],"b_lines":[]{more}}}'
    sound = [text(""), text(frame("")), text(",".join([frame(f"{line},{line}", '" 5"', "RAS", ',"depth":[1,{"a":null}]')] * 900)), text(frame(line), ',"radius1":3,"note":[1,{"a":null}],"labels":["a","b"]')]
    near = [
        text(frame(line, "1.5")), text(frame(line, "4", "XYZ")), text(frame(line.replace(point, "[1,2]"))), text(frame(line.replace("-1.0", '"1"', 1))), text(frame(line.replace('"a"', "1"))), text(frame("4")), text(frame(line, more=',"b_lines":[]')),
        text(frame(line, more=',"a":1,"a":2')), text("", ',"radius1":2.5'), text("", ',"radius1":1,"radius1":2'), text("", ',"labels":["a",1]'), text("", ',"angle1":"x"'), text(frame(line))[:-1], text(frame(line.replace("2,", "02,"))),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(sound + near)], "n int, json string")
    got = {r.n: (r.form, r.faults) for r in df.select("n", F.col("json").rlike(A.SOUND).alias("form"), F.size(A.faults(F.col("json"))).alias("faults")).collect()}
    assert {i: (form, n > 0) for i, (form, n) in got.items()} == {i: (i < len(sound), i >= len(sound)) for i in range(len(sound + near))}
    spaced = df.where(F.col("n") < len(sound)).withColumn("json", F.concat(F.lit(" "), "json"))  # no such form: parsed
    assert spaced.where(F.col("json").rlike(A.SOUND)).count() == 0 and A.validate_documents(spaced).count() == 0


def test_a_nested_list_counts_where_it_is_none(spark):
    """As before lines were asked for as lists: a nested value that is no list hides the one beside it."""
    line = [[[1, 2, 0], [3, 4, 0]]]
    frames = {"1": {"annotation": {"b_lines": "x"}, "b_lines": line}, "2": {"annotation": {"pleura_lines": None}, "pleura_lines": line}, "3": {"annotation": {}, "b_lines": line}, "4": {"annotation": {"b_lines": line}, "b_lines": []}}
    docs = spark.createDataFrame([("/d/R/s/c.json", json.dumps({"frame_annotations": frames}))], "path string, json string")
    out = json.loads(D.convert_legacy(docs)[0].first().json)["frame_annotations"]
    assert [(len(f["pleura_lines"]), len(f["b_lines"])) for f in out] == [(0, 0), (0, 0), (0, 1), (0, 1)]
    assert [r.frame_key for r in D.read_legacy(docs).lines.orderBy("frame_at").collect()] == ["3", "4"]
