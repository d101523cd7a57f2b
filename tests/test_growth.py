"""What lets queries grow no faster than their tables: nothing hashed, joined, shuffled or written more than needed."""

import glob
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonoloom.functions import headers as H
from sonoloom.operators import catalogue as C
from sonoloom.plans import scratch
from sonoloom.sources import headers


@pytest.fixture
def shuffled(spark):
    """Joins as large tables get them."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", ["resume_pending", "resume_position"])
def test_resumed_catalogue_is_hashed_once(spark, sf, key):
    assert "sha2" not in optimised(entry.queries()[key](spark, sf))


def test_masks_are_carried_without_a_join(spark, sf):
    plan = optimised(entry.queries()["asof_transducer_mask"](spark, sf))
    assert "Join" not in plan and "sha2" not in plan


def test_masks_across_days_and_models(spark):
    rows = [("a", 1, 1, None), ("a", 1, 2, "m1"), ("a", 1, 3, None), ("a", 2, 4, None), ("a", 2, 5, "m2"), ("a", 4, 6, None), ("b", 2, 1, None), (None, 1, 1, "n"), (None, 3, 2, None)]
    saved = spark.createDataFrame(rows, "model string, day int, seq int, mask string")
    got = {(r.model, r.seq): r.mask_before for r in C.asof_transducer_mask(saved, F.col("day")).collect()}
    assert got == {("a", 1): None, ("a", 2): None, ("a", 3): "m1", ("a", 4): "m1", ("a", 5): "m1", ("a", 6): "m2", ("b", 1): None, (None, 1): None, (None, 2): "n"}


def test_scene_nodes_are_shuffled_once(shuffled, sf):
    plan = entry.queries()["prune_orphans"](shuffled, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "class#" in x and "name#" in x], plan


def test_keys_are_found_inside_the_row(spark, sf):
    deep = {"Manufacturer": None, "S": [{"T": [{"Key": "deep"}]}, {"Key": "later"}], "Key": "last", "Pixel Data": "x"}
    df = spark.createDataFrame([("a", json.dumps(deep)), ("b", "{}"), ("c", "{"), ("a", json.dumps({"Key": "first"}))], "InputPath string, json string")
    got = {r.InputPath: (r.k, r.m) for r in C.find_keys(df, {"k": "Key", "m": "Manufacturer"}).collect()}
    assert got["a"] == ("first", "N/A") and got["b"] == ("N/A", "N/A")
    assert C.find_key(df.limit(1), "Key").first().found == "deep"
    plan = optimised(entry.queries()["find_key"](spark, sf))
    assert "inline" not in plan.split("Aggregate")[0] and "min_by" not in plan


def test_keys_are_found_at_any_depth(spark):
    """Behind any number of sequences, depth first, and inside a text that holds a sequence."""

    def inside(levels, leaf):
        for _ in range(levels):
            leaf = {"S": [{"a": 1}, leaf], "Other": "o"}
        return leaf

    leaf = {"Pixel Data": "x", "S": [{"Key": "first"}], "Key": "second"}
    texts = {str(n): json.dumps(inside(n, leaf)) for n in (0, 3, 4, 5, 9, 300)}
    texts["text"] = json.dumps({"S": [{"S": json.dumps([inside(7, leaf)])}]}).replace('"[', '"\\u005b')
    df = spark.createDataFrame(list(texts.items()), "InputPath string, json string")
    assert {r.InputPath: (r.k, r.o) for r in C.find_keys(df, {"k": "Key", "o": "None"}).collect()} == dict.fromkeys(texts, ("first", "N/A"))


def test_header_texts_are_quoted_as_json(spark):
    head = {"A": 'say "x"', "B": "back\\slash", "C": "line\nfeed", "D": "ä中\x7f", "E": None, "F": "", "Patient's Name": "n", "Patient's Birth Date": "19800229"}
    df = spark.createDataFrame([("p", json.dumps(head))], "InputPath string, json string")
    assert json.loads(C.header_json(df, F.lit("stem")).first().json) == head | {"Patient's Name": "stem", "Patient's Birth Date": "19800101"}


def test_hash_is_the_whole_digest(spark):
    import hashlib

    texts = [f"P{i}" for i in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", H.hash_number(F.col("t"), 10**10).alias("a"), H.hash_number(F.col("t"), 31).alias("b"))
    number = lambda t: int(hashlib.sha256(t.encode()).hexdigest(), 16)
    assert all((r.a, r.b) == (number(r.t) % 10**10, number(r.t) % 31) for r in got.collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("conv(") <= 8  # four a hash


def test_header_lines_are_written_compressed(spark, sf):
    df = entry.queries()["scan_header_files"](spark, sf)
    path = [p for p in scratch._made if "/headers-" in p][-1]
    assert glob.glob(f"{path}/part-*.txt.gz") and not glob.glob(f"{path}/part-*.txt")
    assert df.count() == entry.queries()["scan_catalogue"](spark, sf).count()


def test_header_lines_are_a_stream(tmp_path):
    """Line ends of all kinds, and an end without one, as before; the file is not held whole."""
    import gzip

    with gzip.open(tmp_path / "h.txt.gz", "wb") as out:
        out.write(b'{"InputPath":"a"}\r\n{"InputPath":"b"}\r{"InputPath":"c"}\n\n{"InputPath":"d"}')
    reader = headers.HeaderReader({"path": str(tmp_path), "lines": "true"})
    rows = [r for p in reader.partitions() for r in reader._rows(p.paths)]
    assert [r["InputPath"] for r in rows if not r.get("error")] == ["a", "b", "c", "d"] and len(rows) == 5
