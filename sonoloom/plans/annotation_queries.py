"""Queries of the annotation, adjudication and line operators."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from sonoloom.functions import headers as H, points as P
from sonoloom.operators import annotations as A, documents as D, scenes as C
from sonoloom.plans.wiring import Registry
from sonoloom.sources.views import instances, lines, statuses, table

R = Registry()
LINE = "clip_id, frame_number, rater, kind, line_ord, x1, y1, x2, y2"
COLS = LINE.split(", ")


def _mode():
    """A word with few values, for want of a column of words."""
    return F.concat(F.lit("m"), (F.col("l_suppkey") % 7).cast("string"))


def _held(s, d):
    """Lines as documents hold them: of a rater's file, some with a validation, some with a key that nobody knows."""
    n, none = F.col("line_ord"), F.lit(None).cast(D.VALIDATION)
    judged = F.struct(F.lit("validated").alias("status"), F.concat(F.lit("adj"), (n % 3).cast("string")).alias("adjudicator"), F.lit("2024-05-06T07:08:09").alias("timestamp"))
    extra = F.when(n % 2 == 1, F.concat(F.lit('{"note":{"of":['), (n % 5).cast("string"), F.lit("]}}"))).otherwise(F.lit("{}"))
    return lines(s, d).withColumns({"owner": F.col("rater"), "validation": F.when(n % 4 == 0, judged).otherwise(none), "extra": extra})


def _heads(s, d, *keys):
    """What a document holds besides its lines."""
    head = F.concat(F.lit('{"SOPInstanceUID":"1.2.'), F.col("clip_id").cast("string"), F.lit('","radius1":'), (F.col("clip_id") % 9).cast("string"), F.lit(',"note":[1,{"a":null}]}'))
    return lines(s, d).withColumn("owner", F.col("rater")).select(*keys).distinct().withColumns({"head": head, "labels": F.array(F.concat(F.lit("c/"), (F.col("clip_id") % 4).cast("string")))})


def _docs(s, d):
    """Documents by clip and rater's file: one clip in thirteen has its text cut off, one in three no tag of the space."""
    docs = D.write_documents(_held(s, d), ["clip_id", "owner"], _heads(s, d, "clip_id", "owner"))
    text = F.when(F.col("clip_id") % 13 == 0, F.expr("left(json, length(json) - 5)")).when(F.col("clip_id") % 3 == 0, F.replace("json", F.lit('"coordinate_space":"LPS",'), F.lit(""))).otherwise(F.col("json"))
    return docs.withColumn("json", text)


#: The form of a written document, told to Spark's own JSON reader.
FORM = "SOPInstanceUID string, radius1 int, labels array<string>, note array<string>, frame_annotations array<struct<frame_number:int,coordinate_space:string,{0}>>"
FORM = FORM.format(",".join(f"{k}:array<struct<rater:string,line:struct<points:array<array<double>>>,validation:{D.VALIDATION},note:struct<of:array<int>>>>" for k in D.KINDS.values()))


def _written(docs, *keys):
    """The lines of written documents, as another reader finds them; a document that the schema check finds a fault in has none."""
    found = F.transform(F.array("json"), lambda text: F.struct(F.size(A.faults(text)).alias("faults"), F.from_json(text, FORM).alias("d")))
    each = docs.select(*keys, F.inline(F.filter(found, lambda x: x["faults"] == 0))).select(*keys, "d.SOPInstanceUID", "d.radius1", F.col("d.labels")[0].alias("label"), F.posexplode("d.frame_annotations").alias("frame_at", "f"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"f.{name}").alias("entries")) for k, name in D.KINDS.items()))
    entry = each.select("*", "f.frame_number", "f.coordinate_space", F.inline(kinds)).select(*keys, "SOPInstanceUID", "radius1", "label", "frame_at", "frame_number", "coordinate_space", "kind", F.posexplode("entries").alias("line_ord", "e"))
    ends = D.with_ends(entry.withColumn("points", F.col("e.line.points")))
    return ends.select(*keys, "SOPInstanceUID", "radius1", "label", "frame_at", "frame_number", "coordinate_space", "kind", "line_ord", "e.rater", "x1", "y1", "x2", "y2", F.col("e.validation.adjudicator").alias("adjudicator"), F.col("e.note.of")[0].alias("note"))


def _old_docs(s, d):
    """Documents of the older form; every other frame has its lines in a nested object, one clip in eleven a frame that is no number."""
    n = lines(s, d).withColumn("root", F.upper("rater")).repartition("clip_id", "root").withColumn("points", F.array(F.array("x1", "y1", F.lit(0.5)), F.array("x2", "y2", F.lit(0.0))))
    frame = n.groupBy("clip_id", "root", "frame_number").agg(F.array_sort(F.collect_list(F.struct("line_ord", "kind", "points"))).alias("l"))
    bare = lambda kind: F.concat(F.array(F.array().cast("array<array<double>>")), F.transform(F.filter("l", lambda x: x["kind"] == kind), lambda x: x["points"]))
    plain = F.to_json(F.struct(bare("pleura").alias("pleura_lines"), bare("b").alias("b_lines"), (F.col("frame_number") * 2).alias("depth")))
    text = F.when(F.col("frame_number") % 2 == 0, F.concat(F.lit('{"annotation":'), plain, F.lit("}"))).otherwise(plain)
    key = F.when((F.col("clip_id") % 11 == 0) & (F.col("frame_number") == 1), "first").when(F.col("frame_number") == 3, "03").otherwise(F.col("frame_number").cast("string"))
    entry = F.concat(F.lit('"'), key, F.lit('":'), text)
    doc = frame.groupBy("clip_id", "root").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("frames"))
    return doc.select(F.concat(F.lit("/data/"), "root", F.lit("/x/"), F.col("clip_id").cast("string"), F.lit(".json")).alias("path"), F.concat(F.lit('{"SOPInstanceUID":"1.2.'), F.col("clip_id").cast("string"), F.lit('","frame_annotations":{'), "frames", F.lit("}}")).alias("json"))


PLACE = "CAST(row_number() OVER (PARTITION BY clip_id, rater, frame_number, kind ORDER BY line_ord) - 1 AS INT)"
HELD = f"SELECT *, {PLACE} AS place, CASE WHEN line_ord % 4 = 0 THEN 'adj' || (line_ord % 3) END AS judge, CASE WHEN line_ord % 2 = 1 THEN CAST(line_ord % 5 AS INT) END AS of FROM v_line"
OLD = f"SELECT *, '/data/' || upper(rater) || '/x/' || clip_id || '.json' AS path, {PLACE} AS place FROM v_line WHERE NOT (clip_id % 11 = 0 AND (clip_id, rater) IN (SELECT clip_id, rater FROM v_line WHERE frame_number = 1))"


def _status_lines(s, d):
    """Lines with the validation event of their line number, where there is one."""
    v = A.latest_validation(statuses(s, d))
    n = lines(s, d).withColumn("line_id", F.col("line_ord") % 997)
    return n.join(v, "line_id", "left")


def _files(s, d):
    """Documents of a clip by path with scalar values and label lists, as several raters would leave them."""
    o = table(s, d, "lineitem")
    return o.select(
        F.col("l_orderkey").alias("clip_id"), F.concat(F.lit("/a/"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("_"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string")).alias("path"),
        F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(_mode()).alias("mask_type"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_returnflag")).alias("owner"),
        F.array("l_returnflag", F.col("l_linestatus"), _mode()).alias("labels"),
    )


FILES = """f AS (SELECT l_orderkey AS clip_id, '/a/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '_' || l_partkey || '_' || l_suppkey AS path, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE ('m' || (l_suppkey % 7)) END AS mask_type,
  CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END AS owner, [l_returnflag, l_linestatus, ('m' || (l_suppkey % 7))] AS labels FROM lineitem)"""
LATEST = "lv AS (SELECT line_id, arg_max(status, (ts, event_id)) AS status, arg_max(adjudicator, (ts, event_id)) AS adjudicator, strftime(arg_max(ts, (ts, event_id)), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM v_status GROUP BY 1), sl AS (SELECT l.*, line_ord % 997 AS line_id, status, adjudicator, timestamp FROM v_line l LEFT JOIN lv ON lv.line_id = line_ord % 997)"


def _read(s, d):
    found = D.read_documents(_docs(s, d)).lines
    return found.select("clip_id", "owner", "frame_number", "kind", "line_ord", "rater", "x1", "y1", "x2", "y2", F.col("points")[1][2].alias("z2"), F.col("validation.adjudicator").alias("adjudicator"), F.get_json_object("extra", "$.note.of[0]").cast("int").alias("note"))


R.add("read_annotations", _read, f"""WITH h AS ({HELD}) SELECT clip_id, rater AS owner, frame_number, kind, place AS line_ord, rater, CASE WHEN clip_id % 3 = 0 THEN -x1 ELSE x1 END AS x1, CASE WHEN clip_id % 3 = 0 THEN -y1 ELSE y1 END AS y1,
  CASE WHEN clip_id % 3 = 0 THEN -x2 ELSE x2 END AS x2, CASE WHEN clip_id % 3 = 0 THEN -y2 ELSE y2 END AS y2, 0.0::DOUBLE AS z2, judge AS adjudicator, of AS note FROM h WHERE clip_id % 13 <> 0""")
R.add("annotation_errors", lambda s, d: D.read_documents(_docs(s, d)).errors, "SELECT DISTINCT clip_id, rater AS owner, 'not a JSON object' AS message FROM v_line WHERE clip_id % 13 = 0")
R.add("read_legacy_annotations", lambda s, d: D.read_legacy(_old_docs(s, d)).lines.select("path", "rater", "frame_key", "frame_number", "kind", "line_ord", "x1", "y1", "x2", "y2", F.col("points")[0][2].alias("z1")), f"""WITH o AS ({OLD})
  SELECT path, rater, CASE WHEN frame_number = 3 THEN '03' ELSE CAST(frame_number AS VARCHAR) END AS frame_key, frame_number, kind, place AS line_ord, x1, y1, x2, y2, 0.5::DOUBLE AS z1 FROM o""")
R.add("legacy_errors", lambda s, d: D.read_legacy(_old_docs(s, d)).errors, "SELECT DISTINCT '/data/' || upper(rater) || '/x/' || clip_id || '.json' AS path, 'a frame key that is no number' AS message FROM v_line WHERE clip_id % 11 = 0 AND frame_number = 1")
R.add("convert_legacy", lambda s, d: _written(D.convert_legacy(_old_docs(s, d))[0].select("file", "json"), "file").drop("radius1", "label", "adjudicator", "note", "frame_at"), f"""WITH o AS ({OLD})
  SELECT '/data/' || upper(rater) || '/x/' || clip_id || '.' || rater || '.json' AS file, '1.2.' || clip_id AS SOPInstanceUID, frame_number, 'LPS' AS coordinate_space, kind, place AS line_ord, rater, -x1 AS x1, -y1 AS y1, -x2 AS x2, -y2 AS y2 FROM o""")
R.add("write_rater_annotations", lambda s, d: _written(D.write_rater(_held(s, d), "clip_id", " R ", _heads(s, d, "clip_id")), "clip_id", "file"), f"""WITH h AS ({HELD}) SELECT clip_id, clip_id || '.r.json' AS file, '1.2.' || clip_id AS SOPInstanceUID, CAST(clip_id % 9 AS INT) AS radius1, 'c/' || (clip_id % 4) AS label,
  CAST(dense_rank() OVER (PARTITION BY clip_id ORDER BY frame_number) - 1 AS INT) AS frame_at, frame_number, 'LPS' AS coordinate_space, kind, place AS line_ord, rater, -x1 AS x1, -y1 AS y1, -x2 AS x2, -y2 AS y2, judge AS adjudicator, of AS note FROM h WHERE rater = 'r'""")
R.add("write_adjudication", lambda s, d: _written(D.write_adjudication(_held(s, d), "clip_id", _heads(s, d, "clip_id")), "clip_id", "file"), f"""WITH h AS ({HELD}) SELECT clip_id, clip_id || '.adjudication.json' AS file, '1.2.' || clip_id AS SOPInstanceUID, CAST(clip_id % 9 AS INT) AS radius1, 'c/' || (clip_id % 4) AS label,
  CAST(dense_rank() OVER (PARTITION BY clip_id ORDER BY frame_number) - 1 AS INT) AS frame_at, frame_number, 'LPS' AS coordinate_space, kind, CAST(row_number() OVER (PARTITION BY clip_id, frame_number, kind ORDER BY line_ord) - 1 AS INT) AS line_ord,
  rater, -x1 AS x1, -y1 AS y1, -x2 AS x2, -y2 AS y2, judge AS adjudicator, of AS note FROM h""")
R.add("filter_rater_lines", lambda s, d: A.frame_counts(A.filter_rater(lines(s, d), "A")), "SELECT clip_id, frame_number, count(*) FILTER (kind = 'pleura') AS n_pleura, count(*) FILTER (kind = 'b') AS n_b FROM v_line WHERE rater = 'a' GROUP BY 1, 2")
R.add("filter_selected_raters", lambda s, d: A.filter_selected(lines(s, d), ["a", "n"]).select(*COLS), f"SELECT {LINE} FROM v_line WHERE rater <> 'r'")
R.add("filter_validated", lambda s, d: A.filter_validated(_status_lines(s, d)).select(*COLS), f"WITH {LATEST} SELECT {LINE} FROM sl WHERE status = 'validated'")
R.add("filter_visible", lambda s, d: A.filter_visible(_status_lines(s, d)).select(*COLS), f"WITH {LATEST} SELECT {LINE} FROM sl WHERE status IS DISTINCT FROM 'invalidated'")
R.add("filter_min_points", lambda s, d: A.filter_min_points(lines(s, d).withColumn("points", F.when(F.col("line_ord") % 5 == 0, F.array(F.array("x1", "y1"))).otherwise(F.array(F.array("x1", "y1"), F.array("x2", "y2"))))).select(*COLS), f"SELECT {LINE} FROM v_line WHERE line_ord % 5 <> 0 AND NOT (x1 = x2 AND y1 = y2)")
R.add("clean_nested_lines", lambda s, d: lines(s, d).select("clip_id", "line_ord", F.to_json(A.clean_nested(_nested())).alias("kept")), "SELECT clip_id, line_ord, '[' || concat_ws(',', CASE WHEN line_ord % 2 = 0 THEN '[' || x1 || ']' END, CASE WHEN line_ord % 3 = 0 THEN '[' || y1 || ',' || y2 || ']' END, '[' || x2 || ']') || ']' AS kept FROM v_line")
R.add("drop_frame", lambda s, d: A.drop_frame(lines(s, d), 3).select(*COLS), f"SELECT {LINE} FROM v_line WHERE frame_number <> 3")
R.add("check_duplicate_frames", lambda s, d: lines(s, d).groupBy("clip_id", "frame_number").agg(F.count("*").alias("n")).where("n > 1"), "SELECT clip_id, frame_number, count(*) AS n FROM v_line GROUP BY 1, 2 HAVING count(*) > 1")
R.add("validate_documents", lambda s, d: A.validate_documents(_faulty(s, d)), """WITH f AS (SELECT clip_id, line_ord, unnest([
  CASE WHEN line_ord % 7 = 0 THEN {'at': 'SOPInstanceUID', 'message': 'not of kind string'} END, CASE WHEN line_ord % 11 = 0 THEN {'at': 'radius1', 'message': 'not of kind integer'} END,
  CASE WHEN line_ord % 5 = 0 THEN {'at': 'frame_annotations/0', 'message': 'frame_number is required'} END, CASE WHEN line_ord % 3 = 0 THEN {'at': 'frame_annotations/0/coordinate_space', 'message': 'not one of LPS, RAS'} END,
  CASE WHEN line_ord % 13 = 0 THEN {'at': 'frame_annotations/0/pleura_lines/0/line/points/1', 'message': 'not 3 items'} END, CASE WHEN line_ord % 19 = 0 THEN {'at': 'frame_annotations/0/pleura_lines/0/line/points/0', 'message': 'not of kind number'} END,
  CASE WHEN line_ord % 23 = 0 THEN {'at': 'frame_annotations/0/pleura_lines/0', 'message': 'rater is required'} END]) AS x FROM v_line WHERE line_ord % 17 <> 0)
  SELECT clip_id, line_ord, x['at'] AS at, x['message'] AS message FROM f WHERE x IS NOT NULL UNION ALL SELECT clip_id, line_ord, '', 'not readable' FROM v_line WHERE line_ord % 17 = 0""")
R.add("validate_fields", lambda s, d: instances(s, d).select("InputPath", F.lower("InputPath").endswith(".dcm").alias("dcm"), F.when(F.col("StudyDate").rlike("^[0-9]{8}$"), F.try_to_timestamp("StudyDate", F.lit("yyyyMMdd"))).isNotNull().alias("date"), F.length("Manufacturer").between(1, 10).alias("maker"), F.coalesce(F.col("NumberOfFrames") >= 0, F.lit(False)).alias("frames")), "SELECT InputPath, suffix(lower(InputPath), '.dcm') AS dcm, try_strptime(StudyDate, '%Y%m%d') IS NOT NULL AS date, length(Manufacturer) BETWEEN 1 AND 10 AS maker, NumberOfFrames IS NOT NULL AS frames FROM v_instance")
R.add("frame_line_counts", lambda s, d: A.frame_counts(lines(s, d)).orderBy("clip_id", "frame_number"), "SELECT clip_id, frame_number, sum(CASE kind WHEN 'pleura' THEN 1 ELSE 0 END)::BIGINT AS n_pleura, sum(CASE kind WHEN 'b' THEN 1 ELSE 0 END)::BIGINT AS n_b FROM v_line GROUP BY ALL")
R.add("max_lines_per_clip", lambda s, d: A.max_lines(lines(s, d)), "WITH c AS (SELECT clip_id, frame_number, count(*) FILTER (kind = 'pleura') AS p, count(*) FILTER (kind = 'b') AS b FROM v_line GROUP BY 1, 2) SELECT clip_id, least(10, greatest(2, max(p))) AS max_pleura, least(10, greatest(2, max(b))) AS max_b FROM c GROUP BY 1")
R.add("distinct_raters", lambda s, d: A.distinct_raters(lines(s, d), "n").select("clip_id", F.array_join("raters", ",").alias("raters"), "n_real"), "SELECT clip_id, 'n,__all__,__adjudicated__' || coalesce(',' || string_agg(DISTINCT rater, ',' ORDER BY rater) FILTER (rater <> 'n'), '') AS raters, CAST(count(DISTINCT rater) AS INT) AS n_real FROM v_line GROUP BY 1")
R.add("latest_validation", lambda s, d: A.latest_validation(statuses(s, d)), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY ts DESC, event_id DESC) AS n FROM v_status) SELECT line_id, status, adjudicator, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM r WHERE n = 1")
R.add("last_line_of_rater", lambda s, d: A.last_line(lines(s, d)).select("clip_id", "frame_number", "kind", "rater", "line_ord"), "SELECT clip_id, frame_number, kind, rater, max(line_ord) AS line_ord FROM v_line GROUP BY 1, 2, 3, 4")
R.add("merge_annotations", lambda s, d: A.merge_scalars(_files(s, d), "clip_id", ["mask_type", "owner"]).join(A.merge_labels(_files(s, d), "clip_id"), "clip_id").select("clip_id", "mask_type", "owner", F.array_join("labels", ",").alias("labels")), f"WITH {FILES}, l AS (SELECT clip_id, label, min((path, p)) AS seen FROM (SELECT clip_id, path, unnest(labels) AS label, unnest(range(3)) AS p FROM f) GROUP BY 1, 2), g AS (SELECT clip_id, string_agg(label, ',' ORDER BY seen) AS labels FROM l GROUP BY 1) SELECT f.clip_id, arg_min(mask_type, path) FILTER (mask_type IS NOT NULL) AS mask_type, arg_min(owner, path) FILTER (owner IS NOT NULL) AS owner, any_value(g.labels) AS labels FROM f JOIN g ON f.clip_id = g.clip_id GROUP BY 1")
R.add("merge_conflicts", lambda s, d: A.merge_conflicts(_files(s, d), "clip_id", "owner"), f"WITH {FILES}, k AS (SELECT clip_id, arg_min(owner, path) FILTER (owner IS NOT NULL) AS kept FROM f GROUP BY 1) SELECT f.clip_id, path, owner AS value, kept FROM f JOIN k ON f.clip_id = k.clip_id WHERE owner <> kept")
R.add("toggle_label", lambda s, d: _files(s, d).select("clip_id", "path", F.array_join(A.toggle_label(F.col("labels"), F.lit("R")), ",").alias("labels")), f"WITH {FILES} SELECT clip_id, path, CASE WHEN list_contains(labels, 'R') THEN array_to_string(list_filter(labels, lambda x: x <> 'R'), ',') ELSE array_to_string(labels, ',') || ',R' END AS labels FROM f")
R.add("replace_rater_lines", lambda s, d: A.replace_lines(lines(s, d).select(*COLS), lines(s, d).where("rater = 'n' AND line_ord % 2 = 0").select(*COLS[:-1], (F.col("y2") + 5).alias("y2")), ["clip_id", "frame_number", "rater"]), f"WITH n AS (SELECT * REPLACE (y2 + 5 AS y2) FROM v_line WHERE rater = 'n' AND line_ord % 2 = 0) SELECT {LINE} FROM v_line v WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.clip_id = v.clip_id AND n.frame_number = v.frame_number AND n.rater = v.rater) UNION ALL SELECT {LINE} FROM n")
R.add("replace_frame_lines", lambda s, d: A.replace_lines(lines(s, d).select(*COLS), lines(s, d).where("kind = 'pleura' AND frame_number < 3").select(*COLS), ["clip_id", "frame_number"]), f"SELECT {LINE} FROM v_line v WHERE NOT EXISTS (SELECT 1 FROM v_line n WHERE n.kind = 'pleura' AND n.frame_number < 3 AND n.clip_id = v.clip_id AND n.frame_number = v.frame_number) UNION ALL SELECT {LINE} FROM v_line WHERE kind = 'pleura' AND frame_number < 3")
R.add("delete_own_lines", lambda s, d: A.delete_own(lines(s, d).select(*COLS), lines(s, d).select(*COLS).where("frame_number <= 2"), "a"), f"SELECT {LINE} FROM v_line WHERE NOT (frame_number <= 2 AND rater = 'a')")
R.add("copy_lines", lambda s, d: A.copy_lines(lines(s, d).where("frame_number = 1"), F.col("frame_number") + 1, "me").select(*COLS), "SELECT clip_id, 2 AS frame_number, 'me' AS rater, kind, line_ord, x1, y1, x2, y2 FROM v_line WHERE frame_number = 1")
R.add("paste_dedup", lambda s, d: A.paste_new(lines(s, d).where("line_ord % 2 = 0"), lines(s, d).select("clip_id", "frame_number", "kind", F.col("x2").alias("x1"), F.col("y2").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"))), "SELECT p.clip_id, p.frame_number, p.kind, p.x2 AS x1, p.y2 AS y1, p.x1 AS x2, p.y1 AS y2 FROM v_line p WHERE NOT EXISTS (SELECT 1 FROM v_line e WHERE e.line_ord % 2 = 0 AND e.clip_id = p.clip_id AND e.frame_number = p.frame_number AND e.kind = p.kind AND ((e.x1 = p.x1 AND e.y1 = p.y1 AND e.x2 = p.x2 AND e.y2 = p.y2) OR (e.x1 = p.x2 AND e.y1 = p.y2 AND e.x2 = p.x1 AND e.y2 = p.y1)))")
R.add("nearest_line", lambda s, d: A.nearest_line(lines(s, d), lines(s, d).select("clip_id", "frame_number", ((F.col("x1") + F.col("x2")) / 2 + 1).alias("px"), F.col("y1").alias("py")).distinct()).select("clip_id", "frame_number", "px", "py", "line_ord", F.round("d2", 6).alias("d2")), """WITH q AS (SELECT DISTINCT clip_id, frame_number, (x1 + x2) / 2 + 1 AS px, y1 AS py FROM v_line), m AS (SELECT q.*, line_ord, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, least(1, greatest(0, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) AS t FROM q JOIN v_line USING (clip_id, frame_number)),
  e AS (SELECT clip_id, frame_number, px, py, line_ord, (px - x1 - t * dx) ^ 2 + (py - y1 - t * dy) ^ 2 AS d2 FROM m) SELECT clip_id, frame_number, px, py, arg_min(line_ord, (d2, line_ord)) AS line_ord, round(min(d2), 6) AS d2 FROM e WHERE d2 < 4 GROUP BY 1, 2, 3, 4""")
R.add("match_validation", lambda s, d: A.match_validation(lines(s, d), lines(s, d).where("line_ord % 3 = 0").select("clip_id", "frame_number", "rater", "x1", "y1", "x2", "y2", F.concat_ws("_", "clip_id", "frame_number", "line_ord").alias("validation_id"))), "WITH v AS (SELECT *, clip_id || '_' || frame_number || '_' || line_ord AS validation_id FROM v_line WHERE line_ord % 3 = 0), m AS (SELECT validation_id, l.line_ord, l.kind, row_number() OVER (PARTITION BY validation_id ORDER BY l.kind DESC, l.line_ord) AS n FROM v JOIN v_line l USING (clip_id, frame_number, rater, x1, y1, x2, y2)) SELECT validation_id, line_ord, kind FROM m WHERE n = 1")
R.add("validate_bulk", lambda s, d: A.validate_bulk(_status_lines(s, d), "me", F.lit("2024-05-06 07:08:09").cast("timestamp")).groupBy("clip_id").agg(F.max("timestamp").alias("latest"), F.min("timestamp").alias("earliest"), F.count_if("changed").alias("lines"), F.count_distinct(F.when(F.col("changed"), F.col("frame_number"))).alias("frames"), F.count_if(F.col("status") == "validated").alias("validated")), f"WITH {LATEST}, sb AS (SELECT *, CASE WHEN coalesce(status, 'unadjudicated') = 'unadjudicated' THEN '2024-05-06T07:08:09' ELSE timestamp END AS t FROM sl) SELECT clip_id, max(t) AS latest, min(t) AS earliest, count(*) FILTER (coalesce(status, 'unadjudicated') = 'unadjudicated') AS lines, count(DISTINCT frame_number) FILTER (coalesce(status, 'unadjudicated') = 'unadjudicated') AS frames, count(*) FILTER (status IS DISTINCT FROM 'invalidated') AS validated FROM sb GROUP BY 1")
R.add("toggle_validation", lambda s, d: _status_lines(s, d).select("clip_id", "frame_number", "line_ord", "status", A.toggled(F.col("status")).alias("next")), f"WITH {LATEST} SELECT clip_id, frame_number, line_ord, status, CASE coalesce(status, '') WHEN 'validated' THEN 'invalidated' WHEN 'invalidated' THEN 'unadjudicated' ELSE 'validated' END AS next FROM sl")
R.add("reset_validation", lambda s, d: A.reset_validation(_status_lines(s, d), 1).select("clip_id", "frame_number", "line_ord", "status"), f"WITH {LATEST} SELECT clip_id, frame_number, line_ord, CASE WHEN frame_number = 1 THEN 'unadjudicated' ELSE status END AS status FROM sl")
R.add("prefer_adjudication", lambda s, d: A.replace_lines(lines(s, d).select(*COLS), lines(s, d).where("clip_id % 4 = 0 AND rater = 'r'").select(*COLS), ["clip_id"]), f"SELECT {LINE} FROM v_line v WHERE NOT (clip_id % 4 = 0 AND rater <> 'r' AND clip_id IN (SELECT clip_id FROM v_line WHERE rater = 'r'))")
R.add("resolve_annotation_file", lambda s, d: _resolved(s, d), "WITH b AS (SELECT clip_id, bool_or(rater = 'a') AS own, bool_or(rater = 'n') AS plain FROM v_line GROUP BY 1) SELECT clip_id, CASE WHEN own THEN clip_id || '.a.json' WHEN plain THEN clip_id || '.json' ELSE clip_id || '.a.json' END AS file, own OR plain AS found FROM b")
R.add("next_unlabeled", lambda s, d: _next(s, d, "SOPInstanceUID", 2), "WITH c AS (SELECT PatientID AS PatientUID, SOPInstanceUID AS u, row_number() OVER (PARTITION BY PatientID ORDER BY InputPath) - 1 AS i FROM v_instance) SELECT PatientUID, min(i) FILTER (i >= 2 AND NOT (u <> '' AND hash_odd)) AS next FROM (SELECT *, length(u) % 2 = 1 AS hash_odd FROM c) GROUP BY 1")
R.add("next_unadjudicated", lambda s, d: _next(s, d, "SeriesInstanceUID", 0), "WITH c AS (SELECT PatientID AS PatientUID, SeriesInstanceUID AS u, row_number() OVER (PARTITION BY PatientID ORDER BY InputPath) - 1 AS i FROM v_instance) SELECT PatientUID, min(i) FILTER (length(u) % 2 = 0) AS next FROM c GROUP BY 1")
R.add("labels_in_vocabulary", lambda s, d: _vocabulary(s, d), f"WITH {FILES}, v AS (SELECT DISTINCT ('m' || (l_suppkey % 7)) AS label FROM lineitem WHERE l_quantity > 49), u AS (SELECT clip_id, unnest(labels) AS label FROM f) SELECT clip_id, count(*) FILTER (label IN (SELECT label FROM v)) AS known, count(*) FILTER (label NOT IN (SELECT label FROM v)) AS unknown FROM u GROUP BY 1")
R.add("ras_lps", lambda s, d: lines(s, d).select("clip_id", "line_ord", P.ras_lps(F.array(F.array("x1", "y1", F.lit(7.0))), F.col("coordinate_space"), "LPS").alias("p")).select("clip_id", "line_ord", F.col("p")[0][0].alias("x"), F.col("p")[0][1].alias("y"), F.col("p")[0][2].alias("z")), "SELECT clip_id, line_ord, CASE coordinate_space WHEN 'RAS' THEN -x1 ELSE x1 END AS x, CASE coordinate_space WHEN 'RAS' THEN -y1 ELSE y1 END AS y, 7.0::DOUBLE AS z FROM v_line")
R.add("line_length", lambda s, d: lines(s, d).select("clip_id", "line_ord", F.format_string("%.3f", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length")), "SELECT clip_id, line_ord, printf('%.3f', sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2)) AS length FROM v_line")
R.add("append_measurement", lambda s, d: A.measurements(lines(s, d).join(table(s, d, "orders").select(F.col("o_orderkey").alias("clip_id"), F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("PatientID"), F.col("o_orderdate").alias("at")), "clip_id").withColumns({"PatientName": F.concat(F.lit("Doe^"), "PatientID"), "DicomInstanceUID": F.concat(F.lit("1.2.840."), F.col("clip_id").cast("string"), F.lit("."), F.col("line_ord").cast("string")), "image": F.concat(F.lit("/out/"), F.col("clip_id").cast("string"), F.lit("_"), F.col("frame_number").cast("string"), F.lit(".png"))})),
      "SELECT 'Doe^P' || o_custkey AS PatientName, 'P' || o_custkey AS PatientID, '1.2.840.' || clip_id || '.' || line_ord AS DicomInstanceUID, strftime(o_orderdate, '%Y-%m-%d_%H:%M:%S') AS Timestamp, printf('%.3f', sqrt((x2 - x1) ^ 2 + (y2 - y1) ^ 2)) AS Length, clip_id || '_' || frame_number || '.png' AS ImageFilename FROM v_line JOIN orders ON o_orderkey = clip_id")
R.add("line_coefficients", lambda s, d: _crossings(s, d), "SELECT clip_id, line_ord, y2 - y1 AS a, x1 - x2 AS b, x1 * y2 - x2 * y1 AS c, CASE WHEN x1 <> x2 THEN round(x1 + (x2 - x1) * (20 - y1) / (y2 - y1), 6) ELSE x1 END AS x_at_20 FROM v_line")
R.add("apply_affine", lambda s, d: lines(s, d).select("clip_id", "line_ord", P.apply_affine(F.array(*map(F.lit, (-2.0, 0.0, 0.0, 640.0, 0.0, 1.5, 0.0, 10.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))), F.col("x1"), F.col("y1"), F.lit(0.0)).alias("p")).select("clip_id", "line_ord", F.col("p")[0].alias("i"), F.col("p")[1].alias("j")), "SELECT clip_id, line_ord, CAST(640 - 2 * x1 AS INT) AS i, CAST(round_even(1.5 * y1 + 10, 0) AS INT) AS j FROM v_line")
def _palette_sql() -> str:
    """Two colours for each rater, saturation 0.95."""
    channel = lambda h, n: f"round(1 - 0.95 * greatest(0, least(({n} + {h}) % 6, 4 - ({n} + {h}) % 6, 1)), 6)"
    none = {"pleura": (1, 0, 0), "b": (1, 0.5, 0)}
    cols = ", ".join(f"CASE WHEN rater = '' THEN {none[kind][i]} ELSE {channel(kind + '_h', n)} END AS {kind}_{c}" for kind in ("pleura", "b") for i, (c, n) in enumerate((("red", 5), ("green", 3), ("blue", 1))))
    rater = "CASE WHEN l_suppkey % 7 = 6 THEN '' ELSE 'm' || (l_suppkey % 7) END"
    return f"WITH r AS (SELECT {rater} AS rater, dense_rank() OVER (ORDER BY {rater}) - 1 AS k FROM lineitem GROUP BY 1), h AS (SELECT rater, ((0.66::DOUBLE + k * (sqrt(5) - 1) / 2) % 1) * 6 AS pleura_h, ((0.33::DOUBLE + k * (sqrt(5) - 1) / 2) % 1) * 6 AS b_h FROM r) SELECT rater, {cols} FROM h"


R.add("rater_palette", lambda s, d: _palette(s, d), _palette_sql())
R.add("sort_frames", lambda s, d: lines(s, d).select(F.col("frame_number").cast("string").alias("frame"), "clip_id").distinct().orderBy(F.col("frame").cast("int"), "clip_id"), "SELECT DISTINCT CAST(frame_number AS VARCHAR) AS frame, clip_id FROM v_line")
R.add("sort_frame_table", lambda s, d: A.frame_counts(lines(s, d)).orderBy(F.desc("n_pleura"), "clip_id", "frame_number"), "SELECT clip_id, frame_number, count(*) FILTER (kind = 'pleura') AS n_pleura, count(*) FILTER (kind = 'b') AS n_b FROM v_line GROUP BY 1, 2 ORDER BY 3 DESC")
R.add("prune_orphans", lambda s, d: C.prune_orphans(*_scenes(s, d))[0], """WITH n AS (SELECT o_custkey AS scene, 'l' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS node, ['Sequence', 'Model', 'MarkupsFiducial', 'MarkupsCurve', 'MarkupsROI', 'Text'][1 + l_suppkey % 6] AS class,
    CASE WHEN l_partkey % 3 = 0 THEN 'my Reconstructor ' ELSE 'node ' END || l_partkey AS name, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  c AS (SELECT o_custkey AS scene, min(o_orderkey) AS first FROM orders WHERE o_custkey % 7 > 0 GROUP BY 1),
  a AS (SELECT scene, max(node) FILTER (class = 'Model' AND scene % 3 > 0) AS atlas, max(node) FILTER (class = 'MarkupsFiducial' AND scene % 4 > 0) AS landmark FROM n GROUP BY 1)
  SELECT DISTINCT n.scene, node, class, CASE WHEN node = atlas THEN 'P' || n.scene || '_axial_AtlasModel' WHEN node = landmark THEN 'P' || n.scene || '_axial_Landmarks' ELSE name END AS name,
    CASE class WHEN 'Sequence' THEN 'referenced' WHEN 'MarkupsROI' THEN 'named' WHEN 'Text' THEN 'other' WHEN 'Model' THEN CASE WHEN atlas IS NULL THEN 'none chosen' ELSE 'chosen' END ELSE CASE WHEN landmark IS NULL THEN 'none chosen' ELSE 'chosen' END END AS why
  FROM n JOIN c USING (scene) LEFT JOIN a USING (scene) WHERE class = 'Text' OR (class = 'Sequence' AND o_orderkey = first) OR (class = 'MarkupsROI' AND name LIKE '%Reconstructor%') OR (class = 'Model' AND node = coalesce(atlas, node)) OR (class = 'MarkupsFiducial' AND node = coalesce(landmark, node))
  UNION ALL SELECT scene, 'b' || first, 'SequenceBrowser', 'browser', 'chosen' FROM c""")
R.add("scene_errors", lambda s, d: C.prune_orphans(*_scenes(s, d))[1], "SELECT DISTINCT o_custkey AS scene, 'no sequence browser is chosen' AS error FROM orders WHERE o_custkey % 7 = 0")


def _resolved(s, d):
    files = lines(s, d).select("clip_id", F.when(F.col("rater") == "a", 1).when(F.col("rater") == "n", 2).alias("priority")).distinct()
    own, plain = (F.concat(F.col("clip_id").cast("string"), F.lit(x)) for x in (".a.json", ".json"))
    best = files.groupBy("clip_id").agg(F.min("priority").alias("p"))
    return best.select("clip_id", F.when(F.coalesce("p", F.lit(1)) == 1, own).otherwise(plain).alias("file"), F.col("p").isNotNull().alias("found"))


def _next(s, d, uid, cursor):
    order = W.partitionBy("PatientID").orderBy("InputPath")
    at = instances(s, d).select(F.col("PatientID").alias("PatientUID"), F.col(uid).alias("InstanceUID"), (F.row_number().over(order) - 1).cast("long").alias("index"))
    return A.next_unlabeled(at, at.where("length(InstanceUID) % 2 = 1"), F.lit(cursor))


def _vocabulary(s, d):
    return A.labels_in_vocabulary(_files(s, d), table(s, d, "lineitem").where("l_quantity > 49").select(_mode().alias("label")))


def _crossings(s, d):
    own = P.line_coefficients(*map(F.col, ("x1", "y1", "x2", "y2")))
    level = P.line_coefficients(F.lit(0.0), F.lit(20.0), F.lit(1.0), F.lit(20.0))
    return lines(s, d).select("clip_id", "line_ord", own[0].alias("a"), own[1].alias("b"), own[2].alias("c"), F.round(P.intersection(own, level)[0], 6).alias("x_at_20"))


def _palette(s, d):
    raters = table(s, d, "lineitem").select(F.when(F.col("l_suppkey") % 7 == 6, "").otherwise(_mode()).alias("rater")).distinct()
    ranks = raters.agg(F.array_sort(F.collect_set("rater")).alias("all")).select(F.posexplode("all").alias("k", "rater"))
    pleura, b = P.rater_colors(F.col("rater"), F.col("k"))
    return ranks.withColumns({"pleura": pleura, "b": b}).select("rater", *(F.round(F.col(kind)[i], 6).alias(f"{kind}_{n}") for kind in ("pleura", "b") for i, n in enumerate(("red", "green", "blue"))))


def _faulty(s, d):
    """A document for each line, with faults of each kind in some."""
    n = F.col("line_ord")
    pick = lambda k, wrong, right: F.when(n % k == 0, F.lit(wrong)).otherwise(F.lit(right))
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("{"), pick(23, "", '"rater":"a",'), F.lit('"line":{"points":[['), F.when(n % 19 == 0, F.concat(F.lit('"'), number("x1"), F.lit('"'))).otherwise(number("x1")), F.lit(","), number("y1"), F.lit(",0],["), number("x2"), F.lit(","), number("y2"), pick(13, "", ",0.5"), F.lit("]]}}"))
    frame = F.concat(F.lit("{"), F.when(n % 5 == 0, "").otherwise(F.concat(F.lit('"frame_number":'), number("frame_number"), F.lit(","))), F.lit('"coordinate_space":"'), pick(3, "XYZ", "LPS"), F.lit('","pleura_lines":['), line, F.lit('],"b_lines":[]}'))
    text = F.concat(F.lit('{"SOPInstanceUID":'), pick(7, "5", '"1.2"'), F.lit(',"GrayscaleConversion":false,"angle1":1.5,"labels":["A"],"radius1":'), pick(11, "2.5", "3"), F.lit(',"frame_annotations":['), frame, F.lit("]}"))
    return lines(s, d).repartition("clip_id").select("clip_id", "line_ord", F.when(n % 17 == 0, "{broken").otherwise(text).alias("json"))


def _nested():
    """Line lists with empty and missing elements between the others."""
    none = F.array().cast("array<double>")
    return F.array(F.when(F.col("line_ord") % 2 == 0, F.array("x1")).otherwise(none), F.lit(None).cast("array<double>"), F.when(F.col("line_ord") % 3 == 0, F.array("y1", "y2")), F.array("x2"))


def _scenes(s, d):
    """A customer's scene: an order is a browser of the sequences among its lines; other lines are nodes of other classes."""
    orders = table(s, d, "orders").select(F.col("o_custkey").alias("scene"), "o_orderkey")
    of = F.element_at(F.array(*map(F.lit, (C.SEQUENCE, C.MODEL, C.FIDUCIAL, C.CURVE, C.ROI, "Text"))), (F.col("kind") + 1).cast("int"))
    text = lambda *cs: F.concat(*(F.col(c).cast("string") if c[0] != "-" else F.lit(c[1:]) for c in cs))
    lined = table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("scene", "l_orderkey", "o_orderkey", "l_linenumber", "l_partkey", (F.col("l_suppkey") % 6).alias("kind"))
    each = lined.distinct().select("scene", text("-l", "l_orderkey", "-_", "l_linenumber", "-_", "l_partkey").alias("node"), of.alias("class"), F.concat(F.when(F.col("l_partkey") % 3 == 0, "my Reconstructor ").otherwise("node "), text("l_partkey")).alias("name"), text("-b", "o_orderkey").alias("browser"))
    nodes = each.drop("browser").unionByName(orders.select("scene", text("-b", "o_orderkey").alias("node"), F.lit(C.BROWSER).alias("class"), F.lit("browser").alias("name")))
    refs = each.where(F.col("class") == C.SEQUENCE).select("scene", F.col("browser").alias("source"), F.col("node").alias("target"))
    browser = orders.groupBy("scene").agg(F.min("o_orderkey").alias("o_orderkey")).select("scene", F.when(F.col("scene") % 7 > 0, text("-b", "o_orderkey")).alias("browser"))
    picked = each.groupBy("scene").agg(F.max(F.when((F.col("class") == C.MODEL) & (F.col("scene") % 3 > 0), F.col("node"))).alias("atlas"), F.max(F.when((F.col("class") == C.FIDUCIAL) & (F.col("scene") % 4 > 0), F.col("node"))).alias("landmark"))
    return nodes, refs, browser.join(picked, "scene", "left").withColumns({"patient": F.concat(F.lit("P"), F.col("scene").cast("string")), "scan": F.lit("axial")})
