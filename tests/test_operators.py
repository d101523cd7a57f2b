"""Literal cases and properties of the operators, and of the queries without SQL."""

import math
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonoloom.functions import headers as H, masks as M, points as P
from sonoloom.operators import documents as D, evaluate as V, scenes
from sonoloom.plans import scratch
from sonoloom.plans.ranking import gapless_rank
from sonoloom.plans.scratch import materialise, scratch_path
from sonoloom.sources import files, headers, segmentations, views

SF = "/root/testdata/sf0.001"


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("data", "maker", "model", "want"), [("SC6-1s,02597", "x", None, "sc6-1s"), ("S4-1U\\UNUSED\\UNUSED", "x", None, "s4-1u"), ("", "x", None, "unknown"), (None, "x", None, "unknown"), ("   ", None, None, "unknown"), (None, "Butterfly Network", "IQ3", "iq3"), ("a", "butterfly", None, "unknown")])
def test_transducer_model(spark, data, maker, model, want):
    assert one(spark, H.transducer_model(F.col("d"), F.col("m"), F.col("n")), d=data, m=maker, n=model) == want


def test_hash_id(spark):
    import hashlib

    for text in ("TEST123", "é", "1.2.840.1"):
        for n in (8, 10):
            assert one(spark, H.hash_id(F.col("t"), n), t=text) == str(int(hashlib.sha256(text.encode()).hexdigest(), 16) % 10**n).zfill(n)
    assert one(spark, H.hash_id(F.col("t"), 10), t="TEST123") == "4657494024"
    assert one(spark, H.anon_filename(F.col("t"), F.lit("")), t="a") == "" and one(spark, H.anon_filename(F.col("t"), F.lit("i")), t=None) == ""


@pytest.mark.parametrize(("age", "want"), [("090Y", "090Y"), ("091Y", "090Y"), ("089Y", "089Y"), ("120M", "120M"), ("99Y", "99Y"), ("abc", "abc"), (None, None), ("", "")])
def test_cap_age(spark, age, want):
    assert one(spark, H.cap_age(F.col("a")), a=age) == want


@pytest.mark.parametrize(("date", "want"), [("20240229", "20240305"), ("invalid", "invalid"), ("", "19000106"), (None, "19000106"), ("20241399", "20241399")])
def test_shift_date(spark, date, want):
    assert one(spark, H.shift_date(F.col("d"), F.lit(5)), d=date) == want


def test_relative_path(spark):
    for root, want in (("/in", "a/b.dcm"), ("/in/", "a/b.dcm"), ("", "/in/a/b.dcm"), ("/i", "/in/a/b.dcm")):
        assert one(spark, H.relative_path(F.col("p"), root), p="/in/a/b.dcm") == want


def test_names(spark):
    assert one(spark, H.camel_to_snake(F.col("t")), t="meanDistanceUpperLeft2X") == "mean_distance_upper_left2_x"
    assert one(spark, H.humanize(F.col("t")), t="PleuraLineUSScan2") == "Pleura Line US Scan2"


def test_corners_round_trip(spark):
    df = V.with_configs(views.masks(spark, SF)).where("gt.mask_type = 'fan'").select("clip_id", M.config_to_corners(F.col("gt")).alias("c"), *(F.col(f"gt_{c}_{a}") for c in V.CORNERS for a in "xy"))
    rows = df.collect()
    assert rows
    for r in rows:
        assert all(abs(r.c[f"{c}_{a}"] - r[f"gt_{c}_{a}"]) <= 2 for c in V.CORNERS for a in "xy")


def test_a_mask_overlaps_itself_whole(spark):
    df = V.with_configs(views.masks(spark, SF)).withColumn("pred", F.col("gt"))
    assert {(r.dice, r.iou) for r in V.dice_iou(V.overlap(df, "clip_id")).collect()} == {(1.0, 1.0)}


def test_ras_lps_twice_is_identity(spark):
    df = spark.createDataFrame([([[1.0, -2.0, 3.0]],)], "p array<array<double>>")
    turned = P.ras_lps(P.ras_lps(F.col("p"), F.lit("RAS"), "LPS"), F.lit("LPS"), "RAS")
    assert df.select(turned.alias("p")).first().p == [[1.0, -2.0, 3.0]]


def test_three_point_fan_has_an_apex(spark):
    cols = {"ul_x": 50.0, "ul_y": 5.0, "ll_x": 10.0, "ll_y": 90.0, "lr_x": 90.0, "lr_y": 90.0}
    p = {k: F.lit(v) for k, v in cols.items()} | {"ur_x": F.lit(None).cast("double"), "ur_y": F.lit(None).cast("double")}
    c = spark.range(1).select(M.corners_to_config(p, F.lit(100)).alias("c")).first().c
    assert (c.mask_type, c.cx, c.cy, c.radius1, c.radius2) == ("fan", 50, 5, 0, round(math.hypot(40, 85)))


def test_gapless_rank_with_a_hot_group(spark):
    df = materialise(spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), "id"), "ranks")
    by = {}
    for r in gapless_rank(df, "g", ["id"], "n", 3000).collect():
        by.setdefault(r.g, []).append(r.n)
    assert len(by) == 8 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_files_round_trip(spark):
    folder = scratch_path(spark, "files")
    given = views.lines(spark, SF)
    docs = D.write_documents(given, ["clip_id", "rater"])
    files.write_documents(docs, f"{folder}/docs")
    back = spark.read.text(f"{folder}/docs").select("rater", F.col("value").alias("json"))
    assert D.read_documents(back.withColumnRenamed("rater", "file")).lines.count() == given.count()
    files.write_table(docs.select("clip_id", "rater"), f"{folder}/keys")
    assert spark.read.option("header", "true").csv(f"{folder}/keys").columns == ["clip_id", "rater"]
    for _ in range(2):
        files.append_measurements(docs.select("clip_id"), f"{folder}/m")
    assert spark.read.parquet(f"{folder}/m").count() == 2 * docs.count()


def test_rounding_is_by_the_exact_value(spark):
    """Decimal ties that no double holds, true ties, both signs, large and missing numbers."""
    values = [0.125, 0.375, 2.675, 1.005, 1.115, 2.5, -0.125, -2.675, 0.285, 1e-9, 0.0, 123456.785, 1e8 + 0.005, 1e300, float("inf"), None]
    values += [n / 1000 for n in range(-3000, 3000, 5)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", P.round_exact(F.col("v")).alias("two"), P.round_exact(F.col("v"), 0).alias("none")).collect()
    for r in rows:
        assert (r.two, r.none) == ((r.v, r.v) if r.v is None or math.isinf(r.v) else (round(r.v, 2), round(r.v, 0))), r.v


def test_corners_by_number_of_points(spark):
    at = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    rows = [(1, at((9, 9), (1, 1), (2, 8), (8, 2)), False), (2, at((9, 9), (5, 1), (2, 8)), True), (3, at((1, 1)), False), (4, at(*[(1, 1)] * 5), False), (5, at(*[(1, 1)] * 4), True)]
    df = spark.createDataFrame(rows, "id int, points array<struct<x:double,y:double>>, three boolean")
    got = {r.id: r.o for r in df.select("id", M.ordered_corners(F.col("points"), F.col("three")).alias("o")).collect()}
    assert [tuple(got[1][c]) for c in ("ul", "ur", "ll", "lr")] == [(1, 1), (8, 2), (2, 8), (9, 9)] and got[1].message is None
    assert tuple(got[2].ul) == (5, 1) and got[2].ur is None and tuple(got[2].lr) == (9, 9)
    assert got[3].message.startswith("At least 4") and got[4].message.startswith("Only 4") and got[5].message.startswith("Only 3") and got[5].ul is None


def test_made_uids_differ(spark):
    made = spark.range(20000).select(H.hash_uid(F.col("id").cast("string")).alias("u"))
    assert made.distinct().count() == 20000 and all(re.fullmatch(r"2\.25\.[1-9][0-9]{30,37}", r.u) for r in made.limit(50).collect())


def test_stored_segmentations_rewrite_their_parts_only(spark, tmp_path):
    path = str(tmp_path / "table")
    captured = spark.range(400).select((F.col("id") % 40).alias("clip_id"), F.floor(F.col("id") / 40).cast("int").alias("frame_no"), F.array(F.col("id").cast("int")).alias("labelmap"))
    segmentations.create(captured, path)
    stamps = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = stamps()
    one = spark.createDataFrame([(3, 2, [7]), (3, 99, [8]), (3, 99, [8])], "clip_id long, frame_no int, labelmap array<int>")
    segmentations.upsert(one, path)
    now = {(r.clip_id, r.frame_no): r.labelmap for r in segmentations.read(spark, path).collect()}
    assert len(now) == 401 and now[3, 2] == [7] and now[3, 99] == [8] and now[4, 2] == [84]
    assert len(set(before) & set(stamps())) == len(before) - 1
    segmentations.remove_frames(one, path)
    segmentations.remove_clips(spark.createDataFrame([(5,), (77,)], "clip_id long"), path)
    left = {(r.clip_id, r.frame_no) for r in segmentations.read(spark, path).collect()}
    assert len(left) == 399 - 10 and (3, 2) not in left and not any(c == 5 for c, _ in left)
    segmentations.remove_clips(spark.range(40).select(F.col("id").alias("clip_id")), path)
    assert [f for f in stamps()] == []


def test_scene_cleanup(spark):
    nodes = [("s", n, c, n) for n, c in [("b1", "SequenceBrowser"), ("b2", "SequenceBrowser"), ("q1", "Sequence"), ("q2", "Sequence"), ("m1", "Model"), ("m2", "Model"), ("f1", "MarkupsFiducial"), ("c1", "MarkupsCurve"), ("my Reconstructor", "MarkupsROI"), ("r", "MarkupsROI"), ("v", "Volume")]]
    nodes += [("t", "q1", "Sequence", "q1")]
    refs = [("s", "b1", "q1"), ("s", "b2", "q2"), ("t", "b1", "q2")]
    chosen = [("s", "b1", "m1", None, "P", "axial"), ("t", None, None, None, "P", "axial")]
    make = spark.createDataFrame
    kept, errors = scenes.prune_orphans(make(nodes, "scene string, node string, class string, name string"), make(refs, "scene string, source string, target string"), make(chosen, "scene string, browser string, atlas string, landmark string, patient string, scan string"))
    assert {(r.node, r.name) for r in kept.collect()} == {("b1", "b1"), ("q1", "q1"), ("m1", "P_axial_AtlasModel"), ("f1", "f1"), ("my Reconstructor", "my Reconstructor"), ("v", "v")}
    assert [r.scene for r in errors.collect()] == ["t"]


def test_readers_and_writers_on_real_folders(spark, tmp_path):
    (tmp_path / "in/a").mkdir(parents=True)
    (tmp_path / "in/a/one.json").write_text('{"PatientID": "P1",\n "Modality": "US", "NumberOfFrames": 3, "Unknown": [1]}')
    (tmp_path / "in/two.json").write_text("no json")
    (tmp_path / "in/._two.json").write_text("fork")
    heads = {r.InputPath.rsplit("/", 1)[-1]: r for r in headers.read_headers(spark, f"{tmp_path}/in/a").collect()}
    assert heads["one.dcm"].PatientID == "P1" and heads["one.dcm"].NumberOfFrames == 3 and heads["one.dcm"].StudyDate is None
    texts = {r.path.rsplit("/", 1)[-1]: r.json for r in files.read_texts(spark, f"{tmp_path}/in").collect()}
    assert set(texts) == {"one.json", "two.json"} and texts["two.json"] == "no json"
    (tmp_path / "labels.csv").write_text("Lung, A-lines \nLung,B\n Heart ,C\n")
    assert sorted(map(tuple, files.read_labels(spark, f"{tmp_path}/labels.csv").collect())) == [("Heart", "C"), ("Lung", "A-lines"), ("Lung", "B")]


def test_scratch_tables_can_be_cleared(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    made, scratch._made[:] = list(scratch._made), [path]
    scratch.clear(spark)
    assert not os.path.exists(path) and not scratch._made
    scratch._made[:] = [p for p in made if p != path]


def test_three_corners_and_modes(spark):
    points = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9.0, 8.0), (5.0, 1.0), (2.0, 7.0))))
    got = spark.range(1).select(M.order_three_corners(points).alias("p"), M.order_three_corners(F.slice(points, 1, 2)).alias("none")).first()
    assert [tuple(p) for p in got.p] == [(5.0, 1.0), (2.0, 7.0), (9.0, 8.0)] and got.none is None


def test_queries_without_sql(spark):
    q = entry.queries()
    for r in q["camel_to_snake"](spark, SF).limit(50).collect():
        assert r.snake == r.snake.lower() and re.search("_x", r.snake)
    for r in q["humanize"](spark, SF).limit(50).collect():
        assert r.words.startswith("US Scan ")
    for r in q["line_length"](spark, SF).join(views.lines(spark, SF), ["clip_id", "line_ord"]).limit(200).collect():
        assert re.fullmatch(r"\d+\.\d{3}", r.length)
    rows = q["mask_contour"](spark, SF).collect()
    assert rows and all(0 < r.rim < r.pixels for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_masks_are_compared_once_for_each_kind(spark):
    """Equal configurations, nulls in them included, are one kind; every row gets its measure, one without pixels too."""
    one = views.masks(spark, SF).where("clip_id < 40")
    many = one.unionByName(one.withColumn("clip_id", F.col("clip_id") + 1000)).unionByName(one.withColumn("clip_id", F.col("clip_id") + 2000))
    seen = []

    def measure(kinds):
        seen.append(kinds.count())
        return kinds.select("mask", F.lit(1).alias("m"))

    configs = V.with_configs(many)
    assert V.of_each(configs, "clip_id", ("gt", "pred"), measure).count() == many.count()
    assert seen == [V.with_configs(one).select("gt", "pred", "image_rows", "image_cols").distinct().count()]
    gone = configs.withColumn("pred", F.col("pred").withField("x_max", F.col("pred.x_min")))
    assert V.overlap(gone.where("pred.mask_type = 'rectangle'"), "clip_id").where("predicted = 0 AND common = 0 AND truth > 0").count() == many.where("clip_id % 1000 % 3 = 0").count()


def test_no_run_of_a_sector_is_shuffled(spark):
    """Lines are dealt by frame before they are rasterised: above the shuffle of lines there is none."""
    from sonoloom.plans.mask_queries import _sectors

    plan = V.pleura_percentage(_sectors(views.lines(spark, SF)), 128, 128)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(clip_id" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "row#" in x]


def test_metrics_of_every_clip_are_written(spark):
    """Those of fans too, not of rectangles only."""
    written = entry.queries()["write_metrics"](spark, SF)
    assert written.count() == views.masks(spark, SF).count() and {r.gt_mask_type for r in written.collect()} == {"fan", "rectangle"}
